"""The catalogue's queries again as plain SQL, to check the Spark results by.

Each text is built from the small expression builders below; the builders take SQL
expressions and return SQL expressions.
"""

from scanweave import constants as K
from scanweave.plans import recipes

ORACLES = {}


# --- expression builders ---------------------------------------------------------------
def quote(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join("NULL" if v is None else quote(v) for v in values) + "]"


def pick(values, index) -> str:
    return f"({strings(values)})[({index}) + 1]"


def upper(e) -> str:
    return f"replace(upper({e}), 'ẞ', 'SS')"


def rx(e, pattern, to="") -> str:
    return f"regexp_replace({e}, {quote(pattern)}, {quote(to)}, 'g')"


def squeeze(e) -> str:
    return f"trim({rx(e, ' +', ' ')})"


def fold_ascii(e) -> str:
    e = rx(e, r"[\x09-\x0D\x1C-\x1F\x{85}\x{A0}\p{Z}]", " ")
    e = rx(e, r"[^\x00-\x7F\p{M}\p{P}\p{S}\p{Z}\p{C}]", "q")
    return rx(e, r"[^\x00-\x7F]", "-")


def base_clean(e) -> str:
    e = fold_ascii(upper(f"coalesce({e}, '')"))
    e = rx(e, r"\b(" + "|".join(K.PRINTED_LABEL_WORDS) + r")\b")
    e = rx(e, r"\b([A-Z0-9])\s+([A-Z0-9])\b", r"\1\2")
    return rx(e, "[^A-Z0-9 /]", " ")


def clean_generic(e) -> str:
    return squeeze(base_clean(e))


def tr(e, table) -> str:
    return f"translate({e}, {quote(table[0])}, {quote(table[1])})"


def words(e) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def long_words(e) -> str:
    letters = rx(tr(e, K.DIGIT_TO_LETTER), "[^A-Z ]")
    return f"array_to_string(list_filter(string_split({letters}, ' '), lambda w: len(w) > 2), ' ')"


def clean_name(e) -> str:
    return long_words(base_clean(e))


def to_digits(e) -> str:
    return rx(tr(upper(e), K.LETTER_TO_DIGIT), "[^0-9]")


def address_line_steps(source, keys, text) -> str:
    """CTEs that bring ``text`` of ``source`` to an address line ``line``, keeping ``keys``."""
    return f"""
    al0 as (select {keys}, {words(clean_generic(text))} w from {source}),
    al1 as (select {keys}, case when len(w) > 1 and len(w[-1]) = 1
        and len(array_to_string(w[1:-2], '')) >= 4 then w[1:-2] else w end w from al0),
    al2 as (select {keys}, case when replace(w[1], '/', '') in ({", ".join(map(quote, K.RELATION_TOKENS))})
        then list_concat([left(replace(w[1], '/', ''), 1) || '/O'], w[2:]) else w end w from al1),
    al as (select {keys}, case
        when len(w) = 2 and len(w[1]) = 1 and len(w[2]) >= 4 then array_to_string(w, '')
        when len(w) >= 3 and len(list_filter(w, lambda t: len(t) <= 1)) >= greatest(2, len(w) // 2)
          then array_to_string(w, '')
        else array_to_string(w, ' ') end line from al2)"""


def pin_digits(e) -> str:
    """Of an expression that already is upper-case; write it as a plain column name."""
    compact = rx(e, "[^A-Z0-9|!]")
    even, odd = rx(compact, "(.).?", r"\1"), rx(compact, ".(.?)", r"\1")

    def weak(x):
        return rx(tr(x, K.PIN_WEAK), "[^0-9]")

    def strong(x):
        return rx(tr(x, K.PIN_STRONG), "[^0-9]")

    def lane(sep, dig):
        count = f"(len({sep}) - len(translate({sep}, 'IL|!', '')))"
        return (f"case when len({compact}) >= 10 and {count} * 1.0 / len({sep}) >= 0.6 and len({dig}) >= 6 "
                f"and len({weak(dig)}) >= 6 then left({weak(dig)}, 6) end")

    token = (f"case when len({strong('t')}) = 6 then {strong('t')} "
             f"when len({strong('t')}) > 6 and regexp_full_match(t, '[0-9]+') then left({strong('t')}, 6) "
             f"when len({weak('t')}) = 6 then {weak('t')} end")
    tokens = f"list_filter(list_transform(regexp_extract_all({e}, '[A-Z0-9|!]+'), lambda t: {token}), lambda d: d is not null)[1]"
    joined = rx(e, "[^0-9]")
    return (f"coalesce({lane(even, odd)}, {lane(odd, even)}, {tokens}, "
            f"case when len({joined}) >= 6 then left({joined}, 6) end, '')")


def year_of(y, now=2026) -> str:
    def pivot(s):
        return f"case when cast({s} as int) <= {now % 100} then 2000 + cast({s} as int) else 1900 + cast({s} as int) end"

    return (f"case when len({y}) >= 4 and cast(left({y}, 4) as int) between 1900 and {now} then left({y}, 4) "
            f"when len({y}) >= 4 and left({y}, 1) in ('1', '2') then cast({pivot(f'substr({y}, 3, 2)')} as varchar) "
            f"when len({y}) = 3 and left({y}, 1) in ('1', '2') then cast({pivot(f'right({y}, 2)')} as varchar) "
            f"when len({y}) = 2 then cast({pivot(y)} as varchar) else '' end")


def dob_of(d, m, y) -> str:
    """Of digit strings."""
    text = f"left({d}, 2) || '/' || left({m}, 2) || '/' || ({year_of(y)})"
    return (f"case when len({d}) >= 2 and len({m}) >= 2 and len({year_of(y)}) = 4 "
            f"and try_strptime({text}, '%d/%m/%Y') is not null then {text} else '' end")


def dob_text_of(e) -> str:
    """Of a digit string column."""
    at = f"strpos({e}, regexp_extract({e}, '19[0-9][0-9]|20[0-9][0-9]'))"
    has = f"regexp_matches({e}, '19[0-9][0-9]|20[0-9][0-9]') and {at} >= 5"
    around = dob_of(f"substr({e}, {at} - 4, 2)", f"substr({e}, {at} - 2, 2)", f"substr({e}, {at}, 4)")
    straight = dob_of(f"substr({e}, 1, 2)", f"substr({e}, 3, 2)", f"substr({e}, 5)")
    return (f"coalesce(case when {has} then nullif({around}, '') end, "
            f"case when len({e}) >= 7 then {straight} end, '')")


def ordinal() -> str:
    return ("((((l_orderkey * 8 + l_linenumber) * 64 + l_suppkey % 64) * 64 + l_partkey % 64) * 64 "
            "+ cast(l_quantity as bigint))")


def replace_letter(e, at, letter) -> str:
    return f"(substr({e}, 1, {at}) || '{letter}' || substr({e}, ({at}) + 2))"


def even4(e) -> str:
    return f"round_even({e}, 4)"


LINES = """
    doc_lines as (select doc_id, unnest(string_split(text, chr(10))) as text,
        unnest(range(len(string_split(text, chr(10))))) as line_no from documents),
    geo as (select doc_id, cast(line_no as int) line_no, text,
        ((doc_id * 31 + line_no * 17) % 128) / 128.0::double as score, (doc_id + line_no) % 17 <> 0 as boxed,
        (line_no * 131 + doc_id * 7) % 900 as x1, (line_no // 3) * 40 + (doc_id * 7 + line_no * 5) % 23 as y1
        from doc_lines),
    lines as (select *, x1 + 60 + len(text) % 500 as x2, y1 + 18 + (doc_id + line_no) % 7 as y2 from geo)"""


def gestalt_steps(pairs) -> str:
    """CTEs from ``pairs`` (a, b) to ``g`` (a, b, ratio): the longest common block of two texts,
    the first of equals, then the same for what lies before and behind it.  Needs "recursive".
    Texts from 200 symbols on would also need the rule about popular symbols; none are so long."""
    return f"""
    g_pairs as (select distinct a, b from {pairs} where a <> b),
    g_parts as (
        select a, b, a as x, b as y, 0::bigint as matched from g_pairs
        union all
        select a, b, unnest([x[:i - 1], x[i + k:]]), unnest([y[:j - 1], y[j + k:]]), unnest([k, 0])
        from (select *, strpos(y, x[i:i + k - 1]) as j from (
            select *, list_max(sizes) as k, list_position(sizes, list_max(sizes)) as i from (
                select a, b, x, y, list_transform(range(1, len(x) + 1), lambda p: len(list_filter(
                    range(1, len(x) - p + 2), lambda n: contains(y, x[p:p + n - 1])))) as sizes
                from g_parts where x <> '' and y <> '')))
        where k > 0),
    g as (select a, b, 2.0::double * sum(matched) / (len(a) + len(b)) as ratio from g_parts group by a, b
        union all select distinct a, b, 1.0::double from {pairs} where a = b)"""


def row_steps(items) -> str:
    """CTEs from ``items`` (doc_id, text, norm, x1, y1, x2, y2, cy, line_no) to ``rows``, numbered
    down the page.  The step reads one item of every page at a time."""
    return f"""
    s as (select *, row_number() over (partition by doc_id order by cy, x1, line_no) as n from {items} where norm <> ''),
    folded as (select doc_id, n, y1, y2, 1 as r from s where n = 1
      union all
      select s.doc_id, s.n, case when near then least(o.y1, s.y1) else s.y1 end, case when near then greatest(o.y2, s.y2) else s.y2 end,
        case when near then o.r else o.r + 1 end
      from folded o join s on s.doc_id = o.doc_id and s.n = o.n + 1,
      lateral (select abs(s.cy - (o.y1 + o.y2) / 2.0) <= 17 as near)),
    rows as (select doc_id, r, string_agg(text, ' ' order by x1, n) as text, string_agg(norm, ' ' order by x1, n) as norm,
      min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, (min(y1) + max(y2)) / 2.0::double as cy
      from (select s.*, o.r from s join folded o on o.doc_id = s.doc_id and o.n = s.n) group by doc_id, r)"""


# --- intake ------------------------------------------------------------------------------
ORACLES["intake_validation"] = f"""
with p as (select page_id, len(html) * (page_id % 1201) as length, {pick(recipes.MIMES, 'page_id % 6')} as mime from pages)
select *, case when length = 0 then 'No image provided.'
  when length > {K.MAX_UPLOAD_BYTES} then 'Image too large. Max 10MB allowed.'
  when mime <> '' and lower(mime) not in ({', '.join(map(quote, K.ALLOWED_MIME_TYPES))}) then 'Unsupported image format.'
  end as error from p"""

_payload = f"{pick(recipes.PAYLOADS, f'event_id % {len(recipes.PAYLOADS)}')}"


def _mapped(table) -> str:
    per = ", ".join(
        f"case when list_contains(sel, {quote(k)}) then {strings(v)} else [] end" for k, v in table.items())
    return f"list_filter({strings(K.ENGINE_FIELDS)}, lambda f: list_contains(flatten([{per}]), f))"


FIELD_STEPS = f"""
    items as (select id, p, kind, case when p is null or trim(p) = '' then {strings(K.OUTPUT_FIELDS)}
        when kind = 'VARCHAR' then [json_extract_string(p, '$')]
        when kind = 'ARRAY' then json_extract_string(p, '$[*]')
        when kind is null then string_split(p, ',') end as raw,
        case when kind = 'ARRAY' then list_transform(json_extract(p, '$[*]'), lambda j: json_type(j) = 'VARCHAR') end as texts
        from (select *, case when json_valid(p) then json_type(p) end as kind from payloads)),
    trimmed as (select id, p, raw is null as unusable,
        list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> '') as xs,
        texts from items),
    checked as (select *, list_filter(xs, lambda x: not list_contains({strings(K.OUTPUT_FIELDS)}, x)) as bad,
        list_filter(xs, lambda x, i: list_contains({strings(K.OUTPUT_FIELDS)}, x) and list_position(xs, x) = i) as good from trimmed),
    answered as (select id, case when unusable then 'Invalid fields payload.'
        when len(bad) > 0 then 'Unsupported fields: ' || array_to_string(bad, ', ')
        when not list_has_any(good, {strings(K.PRIMARY_FIELDS)}) then 'Select at least one extraction field.' end as error, good from checked),
    parsed as (select id, error, case when error is null then good end as fields,
        case when error is null then list_filter({strings(K.PRIMARY_FIELDS)}, lambda f: list_contains(good, f)) end as sel from answered)"""

ORACLES["requested_fields"] = f"""
with payloads as (select event_id as id, {_payload} as p from events), {FIELD_STEPS}
select id as event_id, array_to_string(fields, ',') as fields, error, array_to_string(sel, ',') as selected,
  case when sel is not null then array_to_string({_mapped(K.PUBLIC_ENGINE_FIELDS)}, ',') end as public_fields,
  case when sel is not null then array_to_string({_mapped(K.REQUIRED_ENGINE_FIELDS)}, ',') end as required_fields
from parsed"""

ACCOUNTS = """
    accounts as (select cast(100000000 + c_custkey as varchar) as account_number, upper(p_name) as account_holder_name
        from customer join part on p_partkey = c_custkey * 7 % (select count(*) from part))"""
ORACLES["account_search"] = f"""
with {ACCOUNTS}
select * from accounts where lower(account_holder_name) like '%widget%'
union all select * from accounts where account_number like '%0012%'"""

ORACLES["recogniser_lines"] = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents
    where doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 17 <> 0),
k as (select *, (doc_id + i) % 23 = 0 as broken, (doc_id + i) % 5 <> 0 as boxed, (i * 131 + doc_id * 7) % 900 as x from l)
select doc_id, cast(i as int) as line_no, case when not broken then trim({upper('text')}) end as text, case when not broken then ((doc_id * 31 + i * 17) % 128) / 128.0::double end as score,
  cast(case when boxed and not broken then x end as int) as x1, cast(case when boxed and not broken then i * 40 end as int) as y1,
  cast(case when boxed and not broken then x + 60 end as int) as x2, cast(case when boxed and not broken then i * 40 + 18 end as int) as y2,
  case when broken then 'Not a line.' end as fault from k
union all select doc_id, null, null, null, null, null, null, null, case when doc_id % 11 = 0 then 'Not JSON.' else 'Not a page.' end from documents where doc_id % 11 = 0 or doc_id % 13 = 0"""

# --- text -----------------------------------------------------------------------------------
ORACLES["clean_generic"] = f"with {LINES} select doc_id, line_no, {clean_generic('text')} as clean_text from lines"
ORACLES["clean_name"] = f"with {LINES} select doc_id, line_no, {clean_name('text')} as clean_text from lines"
ORACLES["clean_address_line"] = f"""
with {LINES}, {address_line_steps('lines', 'doc_id, line_no', 'text')}
select doc_id, line_no, line as clean_text from al"""
ORACLES["label_text"] = f"""
with {LINES} select doc_id, line_no,
  {squeeze(rx(tr(upper('text'), K.ANCHOR_LETTERS), r'[^\p{L}\p{N}]+', ' '))} as anchor_text,
  {squeeze(rx(upper('text'), r'[^\p{L}\p{N}]+', ' '))} as plain_text from lines"""

_pin_forms = [
    "code", "translate(code, '01', 'OL')", "'Pin Code ' || code", rx("code", "(.)", r"I\1"),
    "translate(code, '5826', 'SBZG') || ' x'", "substr(code, 1, 3) || '-' || substr(code, 4, 3)",
]
ORACLES["pin_extract"] = f"""
with codes as (select o_orderkey, cast(100000 + (o_orderkey * 7919 + o_custkey) % 900000 as varchar) as code from orders),
t as (select o_orderkey as doc_id, ([{', '.join(_pin_forms)}])[o_orderkey % 6 + 1] as text from codes),
u as (select *, {base_clean('text')} as c from t)
select doc_id, text, {pin_digits('c')} as pin from u"""
ORACLES["pin_lines"] = f"""
with {LINES}, u as (select doc_id, line_no, {base_clean('text')} as c from lines)
select doc_id, line_no, {pin_digits('c')} as pin from u"""
ORACLES["pin_raw"] = f"""
with {LINES}, u as (select doc_id, line_no, {upper('text')} as c from lines)
select doc_id, line_no, {pin_digits('c')} as pin from u"""


def _noisy(e) -> str:
    e = f"case when o_orderkey % 3 = 0 then translate({e}, '0', 'O') else {e} end"
    return f"case when o_orderkey % 4 = 0 then translate({e}, '1', 'I') else {e} end"


DOB_PARTS = f"""
    raw_parts as (select o_orderkey, strftime(o_orderdate, '%d') as d,
        case when o_orderkey % 11 = 0 then '13' else strftime(o_orderdate, '%m') end as m,
        case when o_orderkey % 7 = 0 then right(strftime(o_orderdate, '%Y'), 2)
             when o_orderkey % 5 = 0 then '1' || right(strftime(o_orderdate, '%Y'), 2)
             else strftime(o_orderdate, '%Y') end as y from orders),
    dob_parts as (select o_orderkey as doc_id, {_noisy('d')} as day, {_noisy('m')} as month, {_noisy('y')} as year from raw_parts)"""
ORACLES["dob_parts"] = f"""
with {DOB_PARTS}, digits as (select *, {to_digits('day')} as dd, {to_digits('month')} as dm, {to_digits('year')} as dy from dob_parts)
select doc_id, day, month, year, {dob_of('dd', 'dm', 'dy')} as dob from digits"""
ORACLES["dob_text"] = f"""
with {DOB_PARTS}, t as (select doc_id, 'X ' || day || '-' || month || '-' || year as text from dob_parts),
digits as (select *, {to_digits(base_clean('text'))} as g from t)
select doc_id, text, {dob_text_of('g')} as dob from digits"""
ORACLES["dob_lines"] = f"""
with {LINES}, digits as (select doc_id, line_no, {to_digits(base_clean('text'))} as g from lines)
select doc_id, line_no, {dob_text_of('g')} as dob from digits"""
ORACLES["account_number"] = rf"""
with runs as (select doc_id, regexp_extract_all({fold_ascii('text')}, '\b[0-9]{{9,18}}\b') as r from documents)
select doc_id, coalesce(list_filter(r, lambda x: len(x) = list_max(list_transform(r, lambda y: len(y))))[1], '') as account_number
from runs"""
_letters = rx(rx(upper("text"), r"[\x09-\x0D\x1C-\x1F\x{85}\x{A0}\p{Z}]", " "), "[^A-Z ]")
ORACLES["holder_name"] = f"""
select conv_id, turn, array_to_string(list_filter(string_split({_letters}, ' '),
  lambda w: len(w) > 2 and not list_contains({strings(K.HOLDER_NOISE_WORDS)}, w))[1:2], ' ') as holder_name
from conversations"""
_state_rows = ", ".join(f"({i}, {quote(c)}, {quote(c.replace(' ', '').replace('-', ''))})" for i, c in enumerate(K.STATES))
ORACLES["state_match"] = f"""
with recursive s as (select o_orderkey as doc_id, {pick(K.STATES, 'o_orderkey % 36')} as state from orders),
t as (select *, case when doc_id % 3 = 0 then {replace_letter('state', 'doc_id % len(state)', 'X')} else state end as text from s),
cleaned as (select *, {clean_name('text')} as c from t),
choices(place, choice, compact) as (values {_state_rows}),
offers as (select distinct c, replace(replace(c, ' ', ''), '-', '') as a, place, choice, compact as b from cleaned cross join choices),
pairs as (select a, b from offers),
{gestalt_steps('pairs')},
nearest as (select c, choice from (select *, row_number() over (partition by c order by ratio desc, place) as k from offers join g using (a, b)) where k = 1 and ratio >= {K.STATE_MIN_RATIO})
select doc_id, text, case when c in (select choice from choices) then c else coalesce(choice, c) end as state from cleaned left join nearest using (c)"""

# --- reads and votes ---------------------------------------------------------------------------
_TOP = "case when boxed then y1 else 0 end, case when boxed then x1 else 0 end, line_no"
ORACLES["read_assembly"] = f"""
with {LINES}
select doc_id, coalesce(string_agg(nullif(trim({upper('text')}), ''), ' ' order by {_TOP}), '') as raw_text,
  {even4('avg(score)')} as confidence, count(*) as line_count from lines group by doc_id"""
ORACLES["expected_reads"] = f"""
with {LINES}, r as (select doc_id, coalesce(string_agg(nullif(trim({upper('text')}), ''), ' ' order by {_TOP}), '') as raw_text,
  {even4('avg(score)')} as confidence from lines where boxed group by doc_id)
select d.doc_id, coalesce(raw_text, '') as raw_text, coalesce(confidence, 0.0) as confidence
from documents d left join r on r.doc_id = d.doc_id"""
ORACLES["document_text"] = f"""
with {LINES} select doc_id, string_agg({upper('text')}, ' ' order by line_no) as text from lines group by doc_id"""

CONSENSUS = f"""
    ocr_reads as (select l_partkey as doc_id, {pick(['dob', 'state', 'pin', 'address'], 'l_linenumber % 4')} as field,
        {ordinal()} as ordinal, l_returnflag || l_linestatus || ' ' || (l_orderkey % 5) as raw_text,
        case when l_linestatus = 'O' and l_quantity % 2 = 0 then '' else l_returnflag || l_linestatus end as clean_text,
        l_quantity / 64 as confidence from lineitem),
    marked as (select *, row_number() over (partition by doc_id, field, clean_text order by confidence desc, ordinal desc) as late,
        row_number() over (partition by doc_id, field order by confidence desc, ordinal) as early from ocr_reads),
    buckets as (select doc_id, field, clean_text, count(*) as support, sum(confidence) as total, min(ordinal) as first_seen,
        max(case when late = 1 then raw_text end) as raw_text from marked where clean_text <> '' group by all),
    best_bucket as (select *, row_number() over (partition by doc_id, field
        order by support desc, total desc, len(clean_text) desc, first_seen) as r from buckets),
    consensus as (select m.doc_id, m.field, coalesce(b.raw_text, m.raw_text) as raw_text,
        coalesce(b.clean_text, '') as clean_text,
        case when b.doc_id is not null then {even4('b.total / b.support')} else m.confidence end as confidence
        from marked m left join best_bucket b on b.doc_id = m.doc_id and b.field = m.field and b.r = 1 where m.early = 1)"""
ORACLES["consensus_vote"] = f"with {CONSENSUS} select * from consensus"
ORACLES["review_flags"] = f"""
with {CONSENSUS} select doc_id, field, round_even(confidence * 100, 2) as score_percentage, confidence < 0.9 as needs_review from consensus"""

_name = "case when l_linenumber % 3 = 0 then " + replace_letter("name", "l_orderkey % len(name)", "X") + " else name end"
ORACLES["name_vote"] = f"""
with recursive named as (select lineitem.*, upper(p_name) as name from lineitem join part on p_partkey = l_partkey),
reads as (select l_orderkey as doc_id, {pick(K.NAME_FIELDS, 'l_linenumber % 2')} as field, {ordinal()} as ordinal, {_name} as t, l_quantity / 64 as c from named),
buckets as (select doc_id, field, t, count(*) as support, round(sum(c), 9) as total, max(c) as best, min(ordinal) as first_seen from reads group by all),
stated as (select *, max(support) over (partition by doc_id, field) as most, row_number() over (partition by doc_id, field
    order by support desc, total desc, len(t) desc, first_seen) as k from buckets),
pairs as (select x.doc_id, x.field, x.t as a, y.t as b, y.total as w from stated x join stated y on x.doc_id = y.doc_id and x.field = y.field
    where x.most = 1),
{gestalt_steps('pairs')},
votes as (select doc_id, field, a as t, round(sum(ratio * w), 9) as vote from pairs join g using (a, b) group by all),
ranked as (select *, row_number() over (partition by doc_id, field order by vote desc, best desc, len(t), first_seen) as place
    from stated join votes using (doc_id, field, t))
select doc_id, field, t as raw_text, t as clean_text, {even4('total / support')} as confidence from stated where most > 1 and k = 1
union all select doc_id, field, t, t, best from ranked where place = 1"""

ORACLES["address_fallback"] = f"""
with {LINES}, l0 as (select *, line_no % 2 as ordinal, trim(text) as t from lines),
{address_line_steps('l0', 'doc_id, line_no, ordinal', 't')},
j as (select l0.*, al.line from l0 join al using (doc_id, line_no)),
r as (select doc_id, ordinal, count(case when len(line) > 2 then 1 end) as a, sum(case when len(line) > 2 then len(line) else 0 end) as b,
  count(case when len(line) between 1 and 2 then 1 end) as c, {even4('avg(score)')} as confidence,
  coalesce(string_agg(nullif(trim({upper('text')}), ''), ' ' order by {_TOP}), '') as raw_text,
  string_agg(nullif(line, ''), ' ' order by {_TOP}) as clean, coalesce(string_agg(nullif(line, ''), '|' order by {_TOP}), '') as address_lines
  from j group by all),
w as (select *, row_number() over (partition by doc_id order by a desc, b desc, c, confidence desc, ordinal) as k from r)
select doc_id, raw_text, coalesce(clean, {clean_generic('raw_text')}) as clean_text, confidence, address_lines from w where k = 1"""

_WEIGHTS = ", ".join(
    f"({quote(ch)}, {i}, {quote(dg)}, {w}::double)"
    for ch, ws in ({d: {d: 1.0} for d in '0123456789'} | K.BOX_DIGIT_WEIGHTS).items()
    for i, (dg, w) in enumerate(ws.items()))


def box_steps(reads) -> str:
    return f"""
    weights(ch, pos, digit, weight) as (values {_WEIGHTS}),
    told as (select *, regexp_extract(upper(raw_text), '[0-9OQDILTJ|!:;ZSBGYVX]') as ch,
        left({rx('upper(raw_text)', '[^A-Z0-9]')}, 1) as lead from {reads}),
    cast_votes as (select doc_id, box_set, box_idx, w.digit, confidence * w.weight as s, 0 as late, ordinal, w.pos
          from told join weights w using (ch) where kind = 'vote'
        union all select doc_id, box_set, box_idx, case when lead = 'X' then '4' else '7' end, confidence * 4, 1, ordinal, 0
          from told where kind = 'hint' and box_idx = 7 and lead in ('Y', 'V', 'X')),
    tally as (select doc_id, box_set, box_idx, digit, round(sum(s), 9) as score, min(late) as late,
        min((ordinal, pos)) filter (where late = 0) as seen, min((ordinal, pos)) as any_seen,
        count(case when late = 0 then 1 end) as votes from cast_votes group by all),
    ranked as (select *, row_number() over (partition by doc_id, box_set, box_idx
        order by score desc, late, coalesce(seen, any_seen)) as k, sum(votes) over (partition by doc_id, box_set, box_idx) as all_votes,
        max(case when digit = '7' then score end) over (partition by doc_id, box_set, box_idx) as seven from tally),
    boxes as (select doc_id, box_set, box_idx,
        case when box_idx = 7 and digit = '4' and seven > 0 and seven >= score * 0.55 then '7' else digit end as digit,
        case when box_idx = 7 and digit = '4' and seven > 0 and seven >= score * 0.55 then seven else score end as score
        from ranked where k = 1 and all_votes > 0)"""


ORACLES["digit_votes"] = f"""
with box_reads as (select l_suppkey as doc_id, l_linenumber % 2 as box_set, cast(l_partkey % 8 as int) as box_idx, {ordinal()} as ordinal,
    case when l_orderkey % 10 = 3 then 'hint' else 'vote' end as kind,
    '-' || substr('0123456789OQDILTJ|!:;ZSBGYVX', l_orderkey % 28 + 1, 1) as raw_text, l_quantity / 64 as confidence from lineitem),
{box_steps('box_reads')} select * from boxes"""

DATED = f"""
    dated0 as (select o_orderkey as doc_id, strftime(o_orderdate, '%d%m%Y') as digits, unnest(range(8)) as i from orders),
    dated as (select doc_id, 0 as box_set, cast(i as int) as box_idx, i as ordinal, 'vote' as kind,
        case when doc_id % 4 = 1 and i = 5 then '?' when (doc_id + i) % 3 = 0 then translate(substr(digits, i + 1, 1), '01258', 'OIZSB')
          else substr(digits, i + 1, 1) end as raw_text, (doc_id % 32 + 32) / 16.0::double as confidence from dated0),
    {box_steps('dated')},
    eight as (select doc_id, box_set, string_agg(digit, '' order by box_idx) as g, least(0.99, avg(score) / 6) as c
        from boxes group by all having count(*) = 8),
    boxed as (select doc_id, box_set, left(g, 2) || ' ' || substr(g, 3, 2) || ' ' || right(g, 4) as raw_text,
        {dob_of('left(g, 2)', 'substr(g, 3, 2)', 'right(g, 4)')} as clean_text, {even4('c')} as confidence from eight)"""
ORACLES["boxed_dob"] = f"with {DATED} select * from boxed where clean_text <> ''"

_TAILS = ["1Y", "195Y", "19 5 V", "194X", "1954", "1957", "--", "195 7."]
TAIL = f"""
    tails as (select l_orderkey as doc_id, {ordinal()} as ordinal, right({rx(pick(_TAILS, 'l_partkey % 8'), '[^A-Z0-9]')}, 1) as t,
        l_quantity / 64 as c from lineitem),
    scored as (select doc_id, round(sum(case when t in ('Y', 'V') then c * 1.8 when t = '7' then c else 0 end), 9) as score_7,
        round(sum(case when t = 'X' then c * 1.5 when t = '4' then c else 0 end), 9) as score_4,
        arg_max(t, ordinal) filter (where t in ('Y', 'V')) as letter from tails group by doc_id),
    hints as (select doc_id, score_7, score_4, case when score_7 > score_4 and letter is not null then '7' else '' end as hint_digit,
        case when score_7 > score_4 and letter is not null then letter else '' end as hint_letter from scored)"""
ORACLES["tail_hint"] = f"with {TAIL} select * from hints"

_seg = "cast(l_partkey % (case when l_linenumber % 3 = 2 then 100000 else 1000 end) as varchar)"
SEGMENTS = f"""
    seg0 as (select l_orderkey as doc_id, {pick(['day', 'month', 'year'], 'l_linenumber % 3')} as segment, {ordinal()} as ordinal,
        case when l_suppkey % 2 = 0 then translate({_seg}, '015', 'OIS') else {_seg} end as raw_text, l_quantity / 64 as confidence from lineitem),
    seg1 as (select *, {to_digits('raw_text')} as digits from seg0),
    seg2 as (select *, row_number() over (partition by doc_id, segment order by
        least(len(digits), case when segment = 'year' then 4 else 2 end) desc, confidence desc, len(digits) desc, ordinal) as k from seg1),
    segments as (select doc_id, segment, raw_text, digits, confidence from seg2 where k = 1)"""
ORACLES["segment_pick"] = f"with {SEGMENTS} select * from segments"

ORACLES["dob_cascade"] = f"""
with {DATED}, {TAIL}, {SEGMENTS}, {DOB_PARTS},
stage1 as (select b.doc_id, 0 as rank, case when fix and right(raw_text, 1) = '4' then left(raw_text, len(raw_text) - 1) || letter else raw_text end as raw_text,
    case when fix then left(clean_text, len(clean_text) - 1) || '7' else clean_text end as clean_text, confidence
  from (select boxed.*, coalesce(hint_digit = '7' and clean_text like '%/1954', false) as fix, coalesce(nullif(hint_letter, ''), 'Y') as letter
        from boxed left join hints using (doc_id) where clean_text <> '') b),
wide as (select d.doc_id, d.raw_text || ' ' || m.raw_text || ' ' || y.raw_text as raw_text, d.digits as dd, m.digits as md, y.digits as yd,
    {even4('(d.confidence + m.confidence + y.confidence) / 3')} as confidence
  from segments d join segments m on m.doc_id = d.doc_id and m.segment = 'month' join segments y on y.doc_id = d.doc_id and y.segment = 'year'
  where d.segment = 'day'),
stage2 as (select doc_id, 10 as rank, raw_text, {dob_of('dd', 'md', 'yd')} as clean_text, confidence from wide),
whole as (select doc_id, day || ' ' || month || ' ' || year as raw_text, {to_digits(base_clean("day || ' ' || month || ' ' || year"))} as g from dob_parts),
stage3 as (select doc_id, 20 as rank, raw_text, {dob_text_of('g')} as clean_text, 0.5::double as confidence from whole),
offers as (select * from stage1 union all select * from stage2 where clean_text <> '' union all select * from stage3)
select doc_id, raw_text, clean_text, confidence from (select *, row_number() over (partition by doc_id order by rank) as k from offers) where k = 1"""

ORACLES["dob_boxes"] = """
with recursive c0 as (select distinct l_suppkey as doc_id, cast((l_partkey * 7) % 780 as int) as x, cast(l_orderkey % 20 as int) as y,
    cast(l_quantity + 20 as int) as w, cast(l_orderkey % 40 + 20 as int) as h from lineitem),
c1 as (select *, row_number() over (partition by doc_id order by x, y, w, h) as n from c0
  where w between 32 and 72 and h between 25 and 58 and w / h between 0.75 and 1.3),
-- one open box per step; "done" counts a box when the next one starts a new place
f as (select doc_id, n, x, y, w, h, 1 as place from c1 where n = 1
  union all
  select c.doc_id, c.n,
    case when abs(c.x - f.x) <= 4 and c.w * c.h <= f.w * f.h then f.x else c.x end,
    case when abs(c.x - f.x) <= 4 and c.w * c.h <= f.w * f.h then f.y else c.y end,
    case when abs(c.x - f.x) <= 4 and c.w * c.h <= f.w * f.h then f.w else c.w end,
    case when abs(c.x - f.x) <= 4 and c.w * c.h <= f.w * f.h then f.h else c.h end,
    case when abs(c.x - f.x) <= 4 then f.place else f.place + 1 end
  from f join c1 c on c.doc_id = f.doc_id and c.n = f.n + 1),
kept as (select *, row_number() over (partition by doc_id, place order by n desc) as last from f),
counted as (select *, max(place) over (partition by doc_id) as places from kept where last = 1)
select doc_id, cast(case when max(places) >= 8 then 8 else 0 end as int) as n_boxes,
  coalesce(string_agg(x || ',' || y || ',' || w || ',' || h, ' ' order by place) filter (where places >= 8 and place <= 8), '') as boxes
from counted group by doc_id"""

ORACLES["gender_resolve"] = f"""
with s as (select {ordinal()} * 128 + cast(floor(l_extendedprice) as bigint) % 128 as doc_id, l_tax * 5 as m, l_discount * 5 as f, l_quantity / 64 as t from lineitem),
o as (select *, greatest(m, f) as o, t > m and t > f as third from s),
p as (select *, third and t < greatest(0.32, o * 1.35) as weak from o),
q as (select doc_id, case when third and not weak then 'Transgender' when m >= f then 'Male' else 'Female' end as gender,
    case when third and not weak then t else o end as best,
    case when third and not weak then o when weak then t else greatest(least(m, f), t) end as next from p)
select doc_id, gender, {even4("greatest(0.25, least(0.99, least(0.99, best / 2.0) + greatest(0.0, best - next) / 4.0))")} as confidence
from q"""

_labels = ["MALE", "-Male", "FANALE", "FEMALE ", "TRANSGENDER", "OTHER", "TRONOGENIAR"]
_windows = ", ".join(
    f"({i}, {quote(n)}, {int(880 * a)}, {int(88 * b)}, {int(880 * c)}, {int(88 * d)})"
    for i, (n, (a, b, c, d)) in enumerate(K.GENDER_WINDOWS.items()))
_label_map = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in K.GENDER_LABELS.items())
ORACLES["gender_windows"] = f"""
with names(t, label) as (values {_label_map}), template(i, label, a, b, c, d) as (values {_windows}),
l as (select l_orderkey as doc_id, {ordinal()} as line_no, trim(upper({pick(_labels, 'l_partkey % 7')})) as t,
  l_partkey % 700 as x, l_suppkey % 40 as y, cast(12 + l_quantity as int) as h from lineitem),
s as (select doc_id, label, y, x, line_no, greatest(0, x - floor(h * 1.45)) as x1, x - floor(h * 0.12) as right_edge,
  greatest(0, y - floor(h * 0.2)) as y1, least(88, y + h + floor(h * 0.12)) as y2 from l join names using (t)),
k as (select *, row_number() over (partition by doc_id, label order by y desc, x desc, line_no desc) as late,
  row_number() over (partition by doc_id, label order by y, x, line_no) as early from s),
found as (select a.doc_id, a.label, a.y as fy, a.x as fx, a.line_no as fl, b.x1, b.y1, greatest(b.x1 + 1, b.right_edge) as x2, b.y2
  from k a join k b on a.doc_id = b.doc_id and a.label = b.label and a.early = 1 and b.late = 1),
every as (select d.doc_id, t.*, f.* exclude (doc_id, label) from (select distinct doc_id from l) d cross join template t
  left join found f on f.doc_id = d.doc_id and f.label = t.label)
select doc_id, cast(row_number() over (partition by doc_id order by x1 is null, fy, fx, fl, i) - 1 as int) as ordinal, label, x1 is not null as detected,
  cast(coalesce(x1, a) as int) as x1, cast(coalesce(y1, b) as int) as y1, cast(coalesce(x2, c) as int) as x2, cast(coalesce(y2, d) as int) as y2 from every"""


# --- address ---------------------------------------------------------------------------------------
def parse_steps(source) -> str:
    """CTEs from ``source`` (id, raw, pin, state, lines) to ``parsed``."""
    noise = r"\b(" + "|".join(K.ADDRESS_NOISE_WORDS) + r")\b"
    probe = r"\b[0-9]{6}\b|\b[0-9]{5}[L|I][0-9]\b"
    return f"""
    flat as (select id, unnest(lines) as t, unnest(range(len(lines))) as i from {source} where lines is not null),
    {address_line_steps('flat', 'id, i', 't')},
    listed as (select id, list(line order by i) as ls from al where line <> '' group by id),
    a0 as (select s.id, s.pin, s.state, coalesce(ls, []) as ls,
        case when ls is not null then array_to_string(ls, ' ') else {clean_generic('s.raw')} end as full0 from {source} s left join listed using (id)),
    a1 as (select *, {squeeze(rx("translate(full0, '650', 'GSO')", noise))} as full_address from a0),
    a2 as (select *, regexp_extract(translate(full_address, 'GOS', '005'), {quote(probe)}) as probe,
        list_filter(ls, lambda x: x <> state and x <> 'INDIA') as own from a1),
    a3 as (select *, len(own) as n, list_filter(string_split(case when probe <> ''
        then trim(regexp_replace(full_address, {quote(r'^(.*?)' + chr(92) + r'b.{6}' + chr(92) + r'b(.*)$')}, {quote(chr(92) + '1' + chr(92) + '2')}))
        else full_address end, ' '), lambda w: len(w) > 2) as ws from a2),
    parsed as (select id, ls, full_address,
        case when n >= 5 then own[4] when n >= 3 then own[n - 2] when n = 2 then own[1] when n = 1 then own[1] else coalesce(ws[-3], '') end as area,
        case when n >= 5 then own[5] when n >= 1 then own[n] else coalesce(ws[-1], '') end as district,
        case when n >= 5 then own[5] when n >= 2 then own[n - 1] when n = 1 then own[1] else coalesce(ws[-2], '') end as city,
        case when n >= 5 then own[5] when n >= 1 then own[n] else '' end as town_or_city,
        coalesce(own[1], '') as address_line_1, coalesce(own[2], '') as village, coalesce(own[3], '') as street_or_post_office,
        coalesce(own[4], '') as area_or_locality, case when n = 0 and len(ws) > 0 then ws[-1] else state end as state,
        case when probe <> '' then translate(probe, 'L|I', '111') else pin end as pin_code, 'INDIA' as country from a3)"""


_PARTS = ("full_address", "area", "district", "city", "town_or_city", "address_line_1", "village",
          "street_or_post_office", "area_or_locality", "state", "pin_code", "country")
ORACLES["address_parse"] = f"""
with src as (select doc_id as id, text as raw, cast(100000 + doc_id % 900000 as varchar) as pin, {pick(K.STATES, 'doc_id % 36')} as state,
  case when doc_id % 3 <> 0 then string_split(text, chr(10)) end as lines from documents), {parse_steps('src')}
select id as doc_id, array_to_string(ls, '|') as lines_out, {', '.join(f'{p} as a_{p}' for p in _PARTS)} from parsed"""

ADDRESS_READS = f"""
    addr0 as (select o_orderkey as k, p_name as street, unnest(range(20)) as r from orders join part on p_partkey = o_orderkey % (select count(*) from part)),
    address_reads as (select k as doc_id, r % 5 as line_idx, r as ordinal, (k * 7 + r * 5) % 64 / 64.0::double
        + case when (r // 5) % 2 = 0 then 0.0::double else 0.03::double end as confidence, case when (k + r % 5) % 4 = 0 then ''
        when (k + r) % 3 = 0 then {replace_letter('street', '(k + r * 3) % len(street)', 'X')} else street end as raw_text from addr0)"""
ORACLES["address_repair"] = f"""
with recursive {ADDRESS_READS}, n as (select doc_id, upper(max(raw_text)) as known from address_reads where line_idx = 0 group by doc_id),
src as (select doc_id as id, '' as raw, '' as pin, '' as state, ['S/O ' || {replace_letter('known', 'doc_id % greatest(len(known), 1)', 'X')}, 'HIGH STREET'] as lines from n),
{parse_steps('src')},
told as (select p.*, known, string_split(ls[1], ' ')[1] as relation, case when string_split(ls[1], ' ')[1] in ({", ".join(map(quote, K.RELATION_PREFIXES))})
    and contains(ls[1], ' ') then substr(ls[1], strpos(ls[1], ' ') + 1) end as rest from parsed p join n on n.doc_id = p.id),
pairs as (select rest as a, known as b from told where rest is not null and known <> ''),
{gestalt_steps('pairs')},
fixed as (select told.*, case when ratio >= {K.KNOWN_NAME_MIN_RATIO} then relation || ' ' || known end as line from told left join g on g.a = rest and g.b = known)
select id as doc_id, coalesce(line, address_line_1) as address_line_1,
  case when len(ls) > 0 then array_to_string(list_prepend(coalesce(line, ls[1]), ls[2:]), ' ') else full_address end as full_address from fixed"""

ORACLES["address_vote"] = f"""
with recursive {ADDRESS_READS}, {address_line_steps('address_reads', 'doc_id, ordinal', 'raw_text')},
stated as (select r.doc_id, r.line_idx, r.ordinal, r.confidence, trim(r.raw_text) as raw_text, al.line as t
    from address_reads r join al using (doc_id, ordinal) where al.line <> ''),
buckets as (select doc_id, line_idx, t, round(sum(confidence), 9) as total, max((confidence, -ordinal, raw_text)) as best from stated group by all),
pairs as (select x.doc_id, x.line_idx, x.t as a, y.t as b, y.total as w from buckets x join buckets y on x.doc_id = y.doc_id and x.line_idx = y.line_idx),
{gestalt_steps('pairs')},
votes as (select doc_id, line_idx, a as t, round(sum(ratio * w), 9) as vote from pairs join g using (a, b) group by all),
ranked as (select *, row_number() over (partition by doc_id, line_idx order by vote desc, best[1] desc,
    len(list_filter(string_split(t, ' '), lambda w: len(w) = 1)), len(replace(t, ' ', '')) desc, best[2] desc) as place from buckets join votes using (doc_id, line_idx, t))
select doc_id, trim(string_agg(best[3], ' ' order by line_idx)) as raw_text, string_agg(t, ' ' order by line_idx) as clean_text,
  {even4('round(sum(best[1]), 9) / count(*)')} as confidence, string_agg(t, '|' order by line_idx) as address_lines from ranked where place = 1 group by doc_id"""

# --- layout -------------------------------------------------------------------------------------------
ORACLES["layout_rows"] = f"""
with recursive {LINES},
items as (select doc_id, trim(text) as text, {squeeze(rx(tr(upper('text'), K.ANCHOR_LETTERS), r'[^\p{L}\p{N}]+', ' '))} as norm,
    x1, y1, x2, y2, (y1 + y2) / 2.0::double as cy, line_no from lines where boxed),
{row_steps('items')}
select doc_id, text, norm as normalized_text, cast(x1 as int) as x1, cast(y1 as int) as y1, cast(x2 as int) as x2, cast(y2 as int) as y2, cy,
  cast(len(string_split(norm, ' ')) as int) as token_count from rows"""

_label_rows = ", ".join(f"({i}, {quote(t)}, {y}::double)" for i, (t, y) in enumerate(recipes.LABEL_LINES.items()))
_phrases = ", ".join(
    f"({quote(n)}, {quote(p)}, {a['expected_y']}::double, {a['threshold']}::double, {a['tolerance']}::double, {a['max_x_pct']}::double, {a['max_tokens']})"
    for n, a in K.ANCHORS.items() for p in a["phrases"])
_norm = squeeze(rx(tr(upper("text"), K.ANCHOR_LETTERS), r"[^\p{L}\p{N}]+", " "))
FORM_ITEMS = f"""
    labels(i, label, y) as (values {_label_rows}),
    form0 as (select o_orderkey as doc_id, i as line_no, 70 + (o_orderkey * 3 + i * 11) % 40 as x1,
        cast(floor(y * {K.PAGE_HEIGHT} * (0.97::double + (o_orderkey % 7) * 0.01::double) + (o_orderkey % 13) * 3) as int) as c,
        case when (o_orderkey + i) % 9 = 0 then 'SMUDGE' when o_orderkey % 5 = 0 then translate(label, 'OE', '0F') else label end as text
        from orders cross join labels),
    items as (select doc_id, line_no, text, {_norm} as norm, x1, c - 16 as y1, x1 + 270 as x2, c + 16 as y2, c::double as cy from form0)"""
DOCUMENT_ITEMS = f"""
    {LINES},
    labels(i, label, y) as (values {_label_rows}),
    printed as (select doc_id, 1000000 + i as line_no, 70 + (doc_id * 3 + i * 11) % 40 as x1,
        cast(floor(y * {K.PAGE_HEIGHT} * (0.97::double + (doc_id % 7) * 0.01::double) + (doc_id % 13) * 3) as int) as c,
        case when (doc_id + i) % 9 = 0 then 'SMUDGE' when doc_id % 5 = 0 then translate(label, 'OE', '0F') else label end as text
        from documents cross join labels),
    placed as (select doc_id, line_no, trim(text) as text, x1, y1, x2, y2 from lines where boxed
        union all select doc_id, line_no, text, x1, c - 16, x1 + 270, c + 16 from printed),
    items as (select *, {_norm} as norm, (y1 + y2) / 2.0::double as cy from placed)"""


def anchor_steps() -> str:
    """CTEs from ``items`` to ``anchors`` (doc_id, anchor, cy, score)."""
    return f"""
    {row_steps('items')},
    phrases(anchor, phrase, ey, threshold, tolerance, max_x, max_tokens) as (values {_phrases}),
    fitting as (select rows.*, p.*, string_split(norm, ' ') as w, string_split(phrase, ' ') as want, 1.0 - abs(cy / {K.PAGE_HEIGHT} - ey) / tolerance as nearness
        from rows join phrases p on x1 <= {K.PAGE_WIDTH} * max_x and len(string_split(norm, ' ')) <= max_tokens and abs(cy / {K.PAGE_HEIGHT} - ey) <= tolerance),
    texts as (select distinct norm, phrase, w, want, least(len(w), len(want)) as n from fitting),
    word_pairs as (select norm, phrase, p, want[p] as a, b from (select *, unnest(w) as b from (select *, unnest(range(1, len(want) + 1)) as p from texts))),
    run_pairs as (select norm, phrase, phrase as a, array_to_string(w[i:i + n - 1], ' ') as b from (select *, unnest(range(1, len(w) - n + 2)) as i from texts)),
    pairs as (select a, b from word_pairs union select a, b from run_pairs),
    {gestalt_steps('pairs')},
    nearest as (select norm, phrase, p, max(ratio) as near from word_pairs join g using (a, b) group by all),
    by_words as (select norm, phrase, {K.PHRASE_RATIO_WEIGHT} * avg(near) + {K.PHRASE_CLOSE_WEIGHT} * avg(case when near >= {K.PHRASE_CLOSE_RATIO} then 1.0::double else 0 end) as v
        from nearest group by all),
    by_run as (select norm, phrase, max(ratio) as v from run_pairs join g using (a, b) group by all),
    scored as (select fitting.*, greatest(x.v, y.v) * greatest({K.PHRASE_SURPLUS_FLOOR}::double, 1.0 - greatest(0, len(w) - len(want)) * {K.PHRASE_SURPLUS_COST}::double) as text_score
        from fitting join by_words x using (norm, phrase) join by_run y using (norm, phrase)),
    placed_anchors as (select *, round(text_score * {K.ANCHOR_TEXT_SHARE} + nearness * {K.ANCHOR_PLACE_SHARE}, 9) as score from scored where text_score >= threshold),
    anchors as (select doc_id, anchor, cy, score from (
        select *, row_number() over (partition by doc_id, anchor order by score desc, r) as place from placed_anchors) where place = 1)"""


ORACLES["anchor_match"] = f"""
with recursive {FORM_ITEMS}, {anchor_steps()} select doc_id, anchor, cy, round(score, 6) as score from anchors"""
ORACLES["document_anchors"] = f"""
with recursive {DOCUMENT_ITEMS}, {anchor_steps()} select doc_id, anchor, cy, round(score, 6) as score from anchors"""

_anchor_values = ", ".join(f"({i}, {quote(n)}, {a['expected_y']}::double)" for i, (n, a) in enumerate(K.ANCHORS.items()))
FIT = f"""
    f as (select doc_id, regr_slope(cy, ex) as scale, regr_intercept(cy, ex) as o, count(*) as n,
        count(*) filter (where anchor in ('gender', 'dob', 'address', 'state_pin')) as core,
        count(*) filter (where anchor in ('address', 'state_pin')) as low from p group by doc_id),
    w as (select f.doc_id, any_value(scale) as scale, any_value(o) as o, max(abs(ex * scale + o - cy)) as worst from f join p using (doc_id)
        where n >= 3 and core >= 2 and low >= 1 and scale between 0.94 and 1.06 group by f.doc_id),
    fits as (select doc_id, scale, o from w where worst <= {K.PAGE_HEIGHT} * 0.018)"""
ORACLES["vertical_fit"] = f"""
with specs(i, anchor, ey) as (values {_anchor_values}),
p as (select l_orderkey as doc_id, anchor, ey * {K.PAGE_HEIGHT} as ex,
    max(floor((ey * {K.PAGE_HEIGHT} * (0.95 + (l_orderkey % 11) * 0.01) + l_orderkey % 17
      + case when l_orderkey % 10 = 0 then l_quantity * 2 else l_quantity / 16 end) * 16) / 16) as cy
  from lineitem join specs on i = (l_linenumber + l_suppkey) % 6 group by all),
{FIT}
select doc_id, round(scale, 6) as scale, round(o, 4) as offset from fits"""

_templates = ", ".join(f"({quote(f)}, {K.FIELD_ORDER.index(f)}, " + ", ".join(f"{v}::double" for v in b) + ")" for f, b in K.DEFAULT_ROIS.items())


def shift_steps(fits, width="1600", height="2200") -> str:
    """CTEs from ``fits`` (doc_id, scale, o, and width and height if named) and a template per
    page ``t`` (doc_id, field, place, a, b, c, d) to ``shifted``, for pages whose moved regions
    keep order and size."""
    return f"""
    m as (select t.doc_id, field, place, trunc({width} * a) as x1, trunc({width} * c) as x2,
        greatest(0, least({height} - 2, round_even({height} * b * scale + o, 0))) as y1, round_even({height} * d * scale + o, 0) as low, {height} as h
        from {fits} join t using (doc_id)),
    ns as (select *, greatest(y1 + 1, least(h, low)) as y2, case when place is not null then lag(y1) over (partition by doc_id, place is null order by place) end as above from m),
    keeps as (select doc_id from ns group by doc_id having min(y2 - y1) >= 12 and count(case when above > y1 then 1 end) = 0),
    shifted as (select doc_id, field, cast(x1 as int) as roi_x1, cast(y1 as int) as roi_y1, cast(x2 as int) as roi_x2, cast(y2 as int) as roi_y2
        from ns semi join keeps using (doc_id))"""


ORACLES["region_shift"] = f"""
with defaults(field, place, a, b, c, d) as (values {_templates}),
fits as (select o_orderkey as doc_id, (o_orderkey % 33 + 240) / 256.0::double as scale, (o_orderkey % 41) * 4.0::double - 80.0 as o from orders),
t as (select doc_id, defaults.* from fits cross join defaults), {shift_steps('fits')}
select * from shifted"""
ORACLES["page_regions"] = f"""
with recursive defaults(field, place, a, b, c, d) as (values {_templates}), {FORM_ITEMS}, {anchor_steps()},
p as (select doc_id, anchor, cy, ey * {K.PAGE_HEIGHT} as ex from anchors join (values {_anchor_values}) v(i, anchor, ey) using (anchor)), {FIT},
t as (select o_orderkey as doc_id, defaults.* from orders cross join defaults), {shift_steps('fits')}
select doc_id, true as dynamic, field, roi_x1, roi_y1, roi_x2, roi_y2 from shifted
union all select doc_id, false, field, cast(trunc(1600 * a) as int), cast(trunc(2200 * b) as int), cast(trunc(1600 * c) as int), cast(trunc(2200 * d) as int)
from t anti join shifted using (doc_id)"""
ORACLES["roi_assign"] = f"""
with {LINES}, t(field, place, a, b, c, d) as (values {_templates})
select doc_id, line_no, field, text from lines join t on (x1 + x2) / 2.0 >= trunc(1600 * a) and (x1 + x2) / 2.0 < trunc(1600 * c)
  and (y1 + y2) / 2.0 >= trunc(2200 * b) and (y1 + y2) / 2.0 < trunc(2200 * d) where boxed"""
_named = list(K.DOB_SEGMENT_WINDOWS.items()) + list(K.GENDER_WINDOWS.items()) + [
    (f"line_{i}", w) for i, w in enumerate(K.ADDRESS_LINE_WINDOWS)]
_named_values = ", ".join(f"({quote(n)}, " + ", ".join(f"{v}::double" for v in b) + ")" for n, b in _named)
ORACLES["crop_windows"] = f"""
with t(name, a, b, c, d) as (values {_named_values}),
p as (select o_orderkey as doc_id, 400 + o_orderkey % 500 as w, 40 + o_custkey % 60 as h from orders)
select doc_id, cast(case when w >= 430 and h >= 55 then 8 else 0 end as int) as fixed_boxes, name, cast(trunc(a * w) as int) as roi_x1,
  cast(trunc(b * h) as int) as roi_y1, cast(trunc(c * w) as int) as roi_x2, cast(trunc(d * h) as int) as roi_y2 from p cross join t"""

# --- refinement -------------------------------------------------------------------------------------------
_pads = ", ".join(f"({quote(f)}, " + ", ".join(f"{v}::double" for v in p) + ")" for f, p in K.FIELD_PADDING.items())
_moves = [
    "0, 0, 0, 0", "-gx, 0, 0, 0", "0, 0, gx, 0", "0, -gy, 0, 0", "0, 0, 0, gy", "-gx, -gy, gx, gy", "cx, 0, 0, 0", "0, cy, 0, 0",
    "cx, cy, 0, 0", "0, 0, -cx, 0", "0, 0, 0, -cy", "cx, 0, gx, 0", "0, cy, 0, gy",
]
_move_rows = ", ".join(f"{{'i': {i}, 'a': {a}, 'b': {b}, 'c': {c}, 'd': {d}}}" for i, (a, b, c, d) in enumerate(m.split(", ") for m in _moves))
CANDIDATES = f"""
    pads(field, ex, ey, sx, sy) as (values {_pads}),
r as (select {ordinal()} as doc_id, {pick(list(K.FIELD_PADDING), 'l_orderkey % 6')} as field, (l_partkey * 37) % 1500 as x1,
    (l_suppkey * 53 + l_linenumber * 211) % 2150 as y1,
    cast(least(1600, (l_partkey * 37) % 1500 + 20 + l_quantity * 9) as int) as x2,
    least(2200, (l_suppkey * 53 + l_linenumber * 211) % 2150 + 10 + l_partkey % 60) as y2, rowid_ from (select *, row_number() over () as rowid_ from lineitem)),
g as (select *, cast(greatest(4, trunc(greatest(1, x2 - x1) * ex)) as int) as gx, cast(greatest(4, trunc(greatest(1, y2 - y1) * ey)) as int) as gy,
    cast(greatest(3, trunc(greatest(1, x2 - x1) * sx)) as int) as cx, cast(greatest(3, trunc(greatest(1, y2 - y1) * sy)) as int) as cy from r join pads using (field)),
m as (select *, unnest([{_move_rows}]) as v from g),
c0 as (select *, greatest(0, least(1599, x1 + v.a)) as l, greatest(0, least(2199, y1 + v.b)) as t from m),
c1 as (select *, greatest(l + 1, least(1600, x2 + v.c)) as rr, greatest(t + 1, least(2200, y2 + v.d)) as bb from c0),
c2 as (select *, rr - l >= 12 and bb - t >= 12 as ok from c1),
u as (select rowid_, doc_id, field, case when ok then l end as l, case when ok then t end as t, case when ok then rr end as rr, case when ok then bb end as bb,
    min(v.i) as i, any_value((abs(l - x1) + abs(t - y1) + abs(rr - x2) + abs(bb - y2)) / greatest(1, (x2 - x1) + (y2 - y1))) as far
  from c2 group by all)"""
ORACLES["roi_candidates"] = f"""
with {CANDIDATES},
-- all variants that got too small count as one
n as (select *, row_number() over (partition by rowid_ order by i) - 1 as place from u)
select doc_id, field, cast(place as int) as roi_ordinal, round(far, 9) as distance,
  cast(l as int) as roi_x1, cast(t as int) as roi_y1, cast(rr as int) as roi_x2, cast(bb as int) as roi_y2 from n where l is not null"""



def _stand_in(x1, y1, x2, y2) -> str:
    return f"(({x1}) * 7 + ({y1}) * 3 + ({x2}) * 5 + ({y2}) * 11) % 64 / 64.0::double as c, (({x2}) - ({x1})) % 30 as len_"


_gain = "c + case when len_ > 0 then least(0.18::double, len_ * 0.008::double) else -0.10::double end"
ORACLES["refine_rounds"] = f"""
with {CANDIDATES}, limits(field, floor) as (values {", ".join(f"({quote(f)}, {v}::double)" for f, v in K.REFINE_MIN_CONFIDENCE.items())}),
base as (select rowid_, doc_id * 2048 + x1 as doc_id, field, x1, y1, x2, y2, -1 as i, 0.0::double as far, {_stand_in('x1', 'y1', 'x2', 'y2')} from r),
told as (select *, c < floor or len_ = 0 as weak from base join limits using (field)),
tried as (select rowid_, field, l as x1, t as y1, rr as x2, bb as y2, i, far, {_stand_in('l', 't', 'rr', 'bb')} from u where l is not null),
every as (select rowid_, doc_id, field, x1, y1, x2, y2, i, c, len_, far from base
    union all select rowid_, b.doc_id, tried.field, tried.x1, tried.y1, tried.x2, tried.y2, tried.i, tried.c, tried.len_, tried.far from tried join base b using (rowid_) where (tried.x1, tried.y1, tried.x2, tried.y2) <> (b.x1, b.y1, b.x2, b.y2)),
ranked as (select every.*, weak, round({_gain} - far * 0.15, 9) as score from every join (select rowid_, weak from told) using (rowid_) where every.i = -1 or weak),
best as (select *, row_number() over (partition by rowid_ order by score desc, i) as k from ranked)
select doc_id, field, weak, 'R ' || repeat('A', len_) as raw_text, repeat('A', len_) as clean_text, c as confidence,
  cast(x1 as int) as roi_x1, cast(y1 as int) as roi_y1, cast(x2 as int) as roi_x2, cast(y2 as int) as roi_y2 from best where k = 1"""
_label_words = ", ".join(f"({quote(f)}, {quote(w)})" for f, ws in K.FIELD_LABELS.items() for w in ws)
_label_counts = ", ".join(f"({quote(f)}, {len(ws)})" for f, ws in K.FIELD_LABELS.items())
_floors = ", ".join(f"({quote(f)}, {v}::double)" for f, v in K.REFINE_MIN_CONFIDENCE.items())
ORACLES["refine_gate"] = f"""
with recursive {LINES}, label_words(field, label) as (values {_label_words}), label_counts(field, n) as (values {_label_counts}), floors(field, floor) as (values {_floors}),
r as (select doc_id, line_no, {pick(K.ENGINE_FIELDS, 'line_no % 7')} as field, text, {clean_name('text')} as clean, score,
    {squeeze(rx(upper("text"), r"[^\p{L}\p{N}]+", " "))} as plain from lines),
words as (select distinct doc_id, line_no, field, unnest(string_split(plain, ' ')) as word from r),
near as (select distinct label, word from (select distinct label from label_words), (select distinct word from words)
    where 2.0 * least(len(label), len(word)) >= {K.LEAKAGE_TOKEN_RATIO} * (len(label) + len(word))
      and 2.0 * list_sum(list_transform(list_distinct(string_split(label, '')), lambda c: least(len(label) - len(replace(label, c, '')), len(word) - len(replace(word, c, '')))))
        >= {K.LEAKAGE_TOKEN_RATIO} * (len(label) + len(word))),
pairs as (select label as a, word as b from near),
{gestalt_steps('pairs')},
leaks as (select doc_id, line_no, count(distinct label) as k from words join label_words using (field) join g on g.a = label and g.b = word
    where ratio >= {K.LEAKAGE_TOKEN_RATIO} group by all),
told as (select r.*, floor, coalesce(k * 1.0::double / n, 0) as leakage from r left join leaks using (doc_id, line_no) left join label_counts using (field) left join floors using (field))
select doc_id, line_no, field, round(leakage, 6) as leakage,
  coalesce(floor is not null and (score < floor or leakage >= {K.LEAKAGE_LIMIT} or (trim(text) <> '' and trim(clean) = '')), false) as needs_refine from told"""

ORACLES["refine_winner"] = f"""
with r as (select l_orderkey as doc_id, case when l_linenumber = 1 then -1 else {ordinal()} end as roi_ordinal, {ordinal()} as o,
    case when l_linenumber = 1 then 100 else 100 + (l_partkey % 9 - 4) * 5 end as x1, case when l_linenumber = 1 then 100 else 100 - l_suppkey % 7 end as y1,
    case when l_linenumber = 1 then 400 else 400 + l_linenumber * 4 end as x2, 160 as y2,
    l_returnflag || ' ' || l_linestatus as raw_text,
    case when l_quantity % 5 = 0 then '' else repeat(l_returnflag, cast(floor(l_quantity / 2) as bigint)) end as clean_text,
    l_quantity / 64 + floor(l_extendedprice) % 4 / 256 as confidence, floor(l_discount * 100) / 64 as leakage from lineitem),
s as (select *, round(confidence + case when len(clean_text) > 0 then least(0.18, len(clean_text) * 0.008) else -0.10 end - leakage * 0.85
    - (abs(x1 - 100) + abs(y1 - 100) + abs(x2 - 400)) / 360.0::double * 0.15, 9) as score,
    confidence < 0.9 or leakage >= 0.18 or clean_text = '' as gate from r),
best as (select *, row_number() over (partition by doc_id order by score desc, roi_ordinal,
    x1 desc, y1 desc, x2 desc, raw_text desc, clean_text desc, confidence desc, leakage desc) as k from s),
-- several first items of an order: the largest as a row counts as the base
base as (select *, row_number() over (partition by doc_id order by x1 desc, y1 desc, x2 desc, raw_text desc, clean_text desc, confidence desc, leakage desc) as k
  from s where roi_ordinal = -1),
weak as (select doc_id, max(case when roi_ordinal = -1 then gate end) as weak from s group by doc_id)
select w.doc_id, 'name' as field, w.weak, p.raw_text, p.clean_text, p.confidence, p.score, cast(p.x1 as int) as roi_x1, cast(p.y1 as int) as roi_y1,
  cast(p.x2 as int) as roi_x2, cast(p.y2 as int) as roi_y2
from weak w left join (select *, true as is_best from best where k = 1 union all select *, false from base where k = 1) p
  on p.doc_id = w.doc_id and p.is_best = coalesce(w.weak, false)"""

# --- cheques -------------------------------------------------------------------------------------------------
CASES = f"""
    {ACCOUNTS},
    names as (select p_partkey, upper(p_name) as name from part),
    parties as (select o_orderkey as k, o_custkey, h.name as holder, p.name as payee, o.name as other from orders
        join names h on h.p_partkey = o_custkey * 7 % (select count(*) from part) join names p on p.p_partkey = o_orderkey * 11 % (select count(*) from part)
        join names o on o.p_partkey = o_orderkey * 13 % (select count(*) from part)),
    cases as (select k as case_id, 'PAY ' || case when k % 4 = 0 then {replace_letter('payee', 'k % len(payee)', 'Q')} else payee end || ' AC '
          || case when k % 7 = 0 then 900000000 + k else 100000000 + o_custkey end || ' '
          || case when k % 5 = 0 then {replace_letter('holder', 'k % len(holder)', 'Q')} else holder end as cheque_text,
        'INCOME TAX ' || case when k % 6 = 0 then other else holder end as pan_text,
        'GOVERNMENT OF INDIA ' || payee as aadhaar_text from parties),
    found as (select c.*, regexp_extract(cheque_text, '[0-9]{{9,18}}') as account_number, a.account_holder_name
        from cases c left join accounts a on a.account_number = regexp_extract(cheque_text, '[0-9]{{9,18}}'))"""
ORACLES["account_lookup"] = f"""
with {CASES} select case_id, account_number, account_holder_name, account_holder_name is not null as account_valid from found"""

_payee = (f"array_to_string(list_filter(string_split({rx('aadhaar_text', '[^A-Z ]')}, ' '), "
          f"lambda w: len(w) > 2 and not list_contains({strings(K.HOLDER_NOISE_WORDS)}, w))[1:2], ' ')")
# Longest common subsequence of a pattern with every window of a text, bit by bit: the state
# starts with all pattern bits set and loses one bit per matched symbol.
VERDICTS = f"""
    {CASES},
    asked as (select *, {_payee} as payee_name from found),
    pairs as (select distinct p, t from (
        select account_holder_name as p, pan_text as t from asked where account_holder_name is not null
        union all select account_holder_name, cheque_text from asked where account_holder_name is not null
        union all select payee_name, cheque_text from asked where account_holder_name is not null)),
    masks as (select p, ch, cast(sum(1 << i) as bigint) as mask from (
        select p, unnest(string_split(p, '')) as ch, unnest(range(len(p))) as i from (select distinct p from pairs)) group by all),
    tables as (select p, map(list(ch), list(mask)) as m from masks group by p),
    coded as (select p, t, len(p) as n, list_transform(string_split(t, ''), lambda c: coalesce(m[c], 0)) as bits
        from pairs join tables using (p) where len(p) <= len(t)),
    windows as (select p, t, n, bits[greatest(1, s):least(len(bits), s + n - 1)] as w
        from (select *, unnest(range(2 - n, len(bits) + 1)) as s from coded)),
    scored as (select p, t, n, len(w) as len_w, n - bit_count(list_reduce(list_concat([(1::bigint << n) - 1], w),
        lambda s, b: ((s + (s & b)) | (s - (s & b))) & ((1::bigint << n) - 1))) as lcs from windows),
    ratios as (select p, t, max(200.0::double * lcs / (n + len_w)) as score from scored group by p, t),
    verdicts as (select case_id, account_number, payee_name, account_holder_name is not null as account_valid,
        coalesce(c.score > 75, false) as cheque_name_valid, coalesce(a.score > 80, false) as pan_valid,
        coalesce(y.score > 75, false) as payee_valid, true as signature_valid
        from asked left join ratios a on a.p = account_holder_name and a.t = pan_text
        left join ratios c on c.p = account_holder_name and c.t = cheque_text
        left join ratios y on y.p = payee_name and y.t = cheque_text and account_holder_name is not null),
    decided as (select *, case when account_valid and cheque_name_valid and pan_valid and payee_valid then 'Approved' else 'Rejected' end as final_decision
        from verdicts)"""
ORACLES["cheque_decision"] = f"with {VERDICTS} select * from decided"
ORACLES["account_register"] = """
with c as (select case when c_custkey % 17 = 0 then ' ' when c_custkey % 19 = 0 then '1234567890123456' || (10000 + c_custkey)
      when c_custkey % 5 < 2 then cast(100000000 + c_custkey - c_custkey % 5 as varchar) else cast(100000000 + c_custkey as varchar) end as account_number,
    'HOLDER ' || c_custkey as account_holder_name, c_custkey from customer),
delivered as (select account_number, account_holder_name from c union all select account_number, account_holder_name from c where c_custkey % 7 = 0),
judged as (select *, case when trim(account_number) = '' then 'Missing account number.' when len(account_number) > 20 then 'Account number too long.' end as fault,
    row_number() over (partition by account_number order by account_holder_name) as k from delivered)
select account_number, account_holder_name, case when fault is not null or k > 1 then count(*) end as copies,
  case when fault is not null then fault when k > 1 then 'Account number already registered.' end as reason
from (select account_number, account_holder_name, fault, case when fault is null then least(k, 2) else 0 end as k from judged) group by account_number, account_holder_name, fault, k"""
ORACLES["cheque_from_lines"] = f"""
with {VERDICTS}, told as (select *, case_id % 10 = 7 or case_id % 9 = 4 or case_id % 11 = 3 as lacking from decided)
select case_id, case when not lacking then account_number end as account_number, case when not lacking then payee_name end as payee_name,
  {", ".join(f"case when not lacking then {c} end as {c}" for c in ("account_valid", "cheque_name_valid", "pan_valid", "payee_valid", "signature_valid", "final_decision"))},
  case when lacking then 'Missing required documents.' end as error from told
where not (case_id % 10 = 7 and case_id % 9 = 4 and case_id % 11 = 3) -- nothing tells of a case without any document"""
ORACLES["verdict_report"] = f"""
with {VERDICTS}, r as (select case_id, unnest([{{'position': 0, 'label': 'Account Exists', 'v': account_valid}}, {{'position': 1, 'label': 'PAN Owner Match', 'v': pan_valid}},
  {{'position': 2, 'label': 'Payee Aadhaar Match', 'v': payee_valid}}, {{'position': 3, 'label': 'Signature Verified', 'v': signature_valid}}]) as r from decided)
select case_id, r.position, r.label, case when r.v then 'Yes' else 'No' end as value from r"""
ORACLES["verdict_response"] = f"""
with {VERDICTS} select case_id, 'success' as status, account_valid as account_exists, cheque_name_valid as cheque_name_match, pan_valid as pan_owner_match,
  payee_valid as payee_aadhaar_match, signature_valid as signature_verified, final_decision, 'Levenshtein Fuzzy' as matching_algorithm,
  'Cheque_Validation_Report_' || final_decision || '.pdf' as report_name from decided"""
ORACLES["case_assembly"] = "with t as (select conv_id, turn % 3 as k, string_agg(" + upper("text") + """, ' ' order by turn) as text from conversations group by all),
w as (select conv_id as case_id, max(case when k = 0 then text end) as cheque_text, max(case when k = 1 then text end) as pan_text,
  max(case when k = 2 then text end) as aadhaar_text from t group by conv_id)
select *, cheque_text is not null and pan_text is not null and aadhaar_text is not null as complete from w"""

# --- profiles --------------------------------------------------------------------------------------------------
_conf = {"name": 1, "father_name": 3, "dob": 5, "gender": 7, "state": 11, "pin": 13, "address": 17}
PROFILES = f"""
    o as (select o_orderkey as id, trim(upper(translate(o_orderpriority, '0123456789-', ''))) as name, 'CLERK ' || o_orderstatus as father_name,
        strftime(o_orderdate, '%d/%m/%Y') as dob, {pick(['Male', 'Female', 'Transgender'], 'o_orderkey % 3')} as gender,
        {pick(K.STATES, 'o_orderkey % 36')} as state, cast(100000 + o_orderkey % 900000 as varchar) as pin, o_orderstatus from orders),
    src as (select id, '' as raw, pin, state, (['ZQ/' || o_orderstatus, 'OLD MARKET', state, 'BLOCK ' || (id % 90), 'INDIA', 'TOWN OF RIVERS'])[1:id % 7] as lines from o),
    {parse_steps('src')},
    profiles as (select o.*, case when len(ls) > 0 then array_to_string(ls, ' ') else full_address end as address_text, p.city, p.district, p.town_or_city,
        p.address_line_1, p.village, p.street_or_post_office, p.area_or_locality, array_to_string(ls, '|') as lines, ls from o join parsed p using (id))"""
_metrics = ", ".join(
    f"round_even((id * {m} % 64) / 64.0::double * 100, 2) as {f}_score_percentage, (id * {m} % 64) / 64.0 < 0.9 as {f}_needs_review" for f, m in _conf.items())
_raws = ", ".join(f"{f if f != 'address' else quote('')} as {f}_raw" for f in K.ENGINE_FIELDS)
_ADDRESS = "city, district, town_or_city, address_line_1, village, street_or_post_office, area_or_locality"
ORACLES["profile_assemble"] = f"""
with {PROFILES} select id as doc_id, name as full_name, dob, gender, father_name, state, pin as pincode, 'INDIA' as country, address_text, {_ADDRESS}, lines,
{_metrics}, {_raws} from profiles"""
ORACLES["profile_projection"] = f"""
with recursive {PROFILES}, payloads as (select o_orderkey as id, {pick(recipes.PAYLOADS, f'o_orderkey % {len(recipes.PAYLOADS)}')} as p from orders), {FIELD_STEPS},
x as (select p.*, f.fields, {_mapped(K.PUBLIC_ENGINE_FIELDS)} as public_fields from profiles p join parsed_fields f using (id))
select id as doc_id, case when list_contains(fields, 'full_name') then name end as full_name, case when list_contains(fields, 'dob') then dob end as dob,
  case when list_contains(fields, 'gender') then gender end as gender, case when list_contains(fields, 'father_name') then father_name end as father_name,
  case when list_contains(fields, 'location') then pin end as pincode, case when list_contains(fields, 'address_details') then city end as city,
  case when list_contains(fields, 'confidence_metrics') then array_to_string(list_sort(public_fields), ',') end as metric_fields,
  case when list_contains(fields, 'raw_extracted_text') then array_to_string(list_sort(public_fields), ',') end as raw_fields from x""".replace(
    "parsed as (select id, error,", "parsed_fields as (select id, error,").replace("p.*, f.fields,", "p.*, f.fields, f.sel,")
FORMS = f"""
    {PROFILES.split('src as')[0].strip().rstrip(',')}, {DOB_PARTS},
    read_forms as (select o.*, id % 7 <> 0 as seen, id % 5 <> 0 as has_pin, {to_digits(base_clean("day || ' ' || month || ' ' || year"))} as g from o join dob_parts on doc_id = id),
    forms as (select id, case when seen then {clean_name('name')} else '' end as full_name, case when seen then {clean_name('father_name')} else '' end as father_name,
        case when seen then {dob_text_of('g')} else '' end as dob, 'Male' as gender, case when seen then state else '' end as state,
        case when seen and has_pin then pin else '' end as pincode, 'INDIA' as country, case when seen then round_even((id % 64) / 64.0::double, 4) * 100 end as name_score,
        case when not seen then [] when has_pin then ['dob', 'father_name', 'name', 'pin', 'state'] else ['dob', 'father_name', 'name', 'state'] end as present from read_forms)"""
ORACLES["form_profiles"] = f"""
with {FORMS} select id as doc_id, * exclude (id, present), array_to_string(present, ',') as metric_fields from forms"""
_shown = "array_to_string(list_filter(present, lambda f: list_contains(public_fields, f)), ',')"
ORACLES["requested_profiles"] = f"""
with {FORMS}, payloads as (select o_orderkey as id, {pick(recipes.PAYLOADS, f'o_orderkey % {len(recipes.PAYLOADS)}')} as p from orders), {FIELD_STEPS},
x as (select forms.*, fields, {_mapped(K.PUBLIC_ENGINE_FIELDS)} as public_fields from forms join parsed using (id) where fields is not null)
select id as doc_id, {", ".join(f"case when list_contains(fields, '{c}') then {c} end as {c}" for c in ("full_name", "father_name", "dob", "gender"))},
  case when list_contains(fields, 'location') then state end as state, case when list_contains(fields, 'location') then pincode end as pincode,
  case when list_contains(fields, 'confidence_metrics') then {_shown} end as metric_fields, case when list_contains(fields, 'raw_extracted_text') then {_shown} end as raw_fields from x"""
ORACLES["report_rows"] = f"""
with {PROFILES}, r as (select id, unnest([{{'p': 0, 'label': 'Full Name', 'v': name}}, {{'p': 1, 'label': 'Date of Birth', 'v': dob}}, {{'p': 2, 'label': 'Father''s Name', 'v': father_name}},
  {{'p': 3, 'label': 'Gender', 'v': gender}}, {{'p': 4, 'label': 'State', 'v': state}}, {{'p': 5, 'label': 'Pincode', 'v': pin}},
  {{'p': 6, 'label': 'Full Address', 'v': coalesce(nullif(address_text, ''), array_to_string(ls, ', '))}}]) as r from profiles)
select id as doc_id, r.p as position, r.label, case when r.p < 6 and r.v = '' then 'N/A' else r.v end as value from r where r.p < 6 or r.v <> ''"""
ORACLES["artefact_links"] = f"""
with {PROFILES}, f as (select id, name, lower(to_hex(id + 4294967296)) as h, unnest({strings(K.ENGINE_FIELDS)}) as field from profiles)
select id + 4294967296 as doc_id, '/media/documents/aligned_' || h || '.jpg' as image_url, 'Profile_' || replace(name, ' ', '_') || '.pdf' as report_name,
  field, '/media/documents/crop_' || field || '_' || h || '.jpg' as url from f"""
ORACLES["profile_read_back"] = f"""
with {PROFILES} select id as doc_id, case when id % 5 < 3 then name end as full_name, case when id % 5 < 3 then state end as state,
  case when id % 5 < 3 then (id * 13 % 64) / 64.0 < 0.9 end as pin_review,
  case when id % 5 >= 3 then 'JSON must contain an object in "data".' end as error from profiles"""

# --- templates ------------------------------------------------------------------------------------------------------
CALIBRATED = f"""
    drags as (select 'user-' || user_id as template_id, {pick(K.ENGINE_FIELDS, 'event_id % 7')} as field, event_id,
        greatest(0, least(1, (event_id * 37 % 140 - 20) / 128.0::double)) as ax, greatest(0, least(1, (event_id * 53 % 140) / 128.0::double)) as ay,
        greatest(0, least(1, (event_id * 71 % 140) / 128.0::double)) as bx, greatest(0, least(1, (event_id * 11 % 140 - 8) / 128.0::double)) as by_ from events),
    calibrated as (select template_id, field, least(ax, bx) as x1, least(ay, by_) as y1, greatest(ax, bx) as x2, greatest(ay, by_) as y2
        from (select *, row_number() over (partition by template_id, field order by event_id desc) as k from drags) where k = 1)"""
STORED = f"""
    t0(field, place, a, b, c, d) as (values {_templates}),
    stored as (select template_id, t0.* from (select distinct 'user-' || user_id as template_id from events) cross join t0),
    users as (select template_id, field, coalesce(x1, a) as x1, coalesce(y1, b) as y1, coalesce(x2, c) as x2, coalesce(y2, d) as y2
        from stored full outer join calibrated using (template_id, field))"""
ORACLES["calibration_boxes"] = f"with {CALIBRATED} select * from calibrated"
ORACLES["roi_merge"] = f"with {CALIBRATED}, {STORED} select * from users"
_order = f"list_position({strings(K.FIELD_ORDER)}, field)"
ORACLES["roi_assign_by_template"] = f"""
with {DOCUMENT_ITEMS}, {CALIBRATED}, {STORED},
saved as (select * from users union all select 'form-' || r_regionkey, field, a + r_regionkey * 0.005::double, b + r_regionkey * 0.004::double,
    c + r_regionkey * 0.005::double, d + r_regionkey * 0.004::double from region cross join t0),
pages as (select doc_id, case when doc_id % 2 = 0 then 'form-0' when doc_id % 4 = 3 then 'user-' || (doc_id % 40) else 'form-' || (doc_id % 7) end as template_id,
    1600 + doc_id % 2 * 100 as width, 2200 + doc_id % 3 * 50 as height, doc_id % 5 < 3 as fitted,
    (doc_id % 33 + 240) / 256.0::double as scale, (doc_id % 41) * 4.0::double - 80.0 as o from documents),
t as (select doc_id, field, {_order} as place, x1 as a, y1 as b, x2 as c, y2 as d from pages join saved using (template_id)
    union all select doc_id, t0.field, {_order.replace('field', 't0.field')}, a, b, c, d from pages cross join t0 where template_id not in (select template_id from saved)),
fits as (select * from pages where fitted), {shift_steps('fits', 'width', 'height')},
regions as (select *, true as moved from shifted
    union all select doc_id, field, cast(trunc(width * a) as int), cast(trunc(height * b) as int), cast(trunc(width * c) as int), cast(trunc(height * d) as int), false
    from t join pages using (doc_id) where doc_id not in (select doc_id from shifted)),
boxes as (select doc_id, line_no, text, x1, y1, x2, y2 from lines where boxed union all select doc_id, line_no, text, x1, c - 16, x1 + 270, c + 16 from printed)
select l.doc_id, line_no, field, moved, text, roi_x1, roi_y1, roi_x2, roi_y2 from boxes l join regions p on p.doc_id = l.doc_id
  and (x1 + x2) / 2.0 >= roi_x1 and (x1 + x2) / 2.0 < roi_x2 and (y1 + y2) / 2.0 >= roi_y1 and (y1 + y2) / 2.0 < roi_y2"""

"""The operators as queries over whole tables, and the SQL to check them by."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from scanweave.llm import (
    bpe, chat, decontaminate, main_text, neighbours, ngram_join, ngram_lm, outliers, product_codes, reputation, token_files, toxicity,
    variants,
)
from scanweave.llm.shared import table
from scanweave.llm.vocabularies import BYTE_BPE, WORD_BPE, vocabulary_file
from scanweave.shipping import ship

QUERIES = {}
ORACLES = {}


def query(fn):
    """Registers a query under its name; Python workers get the package first."""

    def run(spark: SparkSession, sf_dir) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
                                        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from docs),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as d, b.doc_id as e, count(*) as both from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select o.d, o.e from common o join sizes x on x.doc_id = o.d join sizes y on y.doc_id = o.e
    where 100 * o.both >= 75 * (x.n + y.n - o.both)),
reach as (select d, e from links union select r.d, l.e from reach r join links l on l.d = r.e)
select k.doc_id, coalesce(s.n, 0)::bigint as n_shingles,
       least(k.doc_id, coalesce((select min(e) from reach r where r.d = k.doc_id), k.doc_id)) as component_id,
       coalesce((select count(*) from links l where l.d = k.doc_id), 0)::bigint as n_links
from docs k left join sizes s using (doc_id)
"""


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_bpe_encoding(spark, sf_dir):
    docs, raw = table(spark, sf_dir, "documents"), vocabulary_file(WORD_BPE)
    return bpe.digests(bpe.encode(docs, raw, bpe.lexicon_of(docs, raw), decoded=True))


@query
def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op4_benchmark_decontamination"] = r"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
items as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) as s
    from items where len(w) > 0),
spots as (
    select d.doc_id, n, unnest(range(len(w) - n + 1)) as i, w
    from docs d, (select distinct n from windows) where len(w) >= n),
hits as (
    select s.doc_id, s.i, s.n, x.item_id from spots s join windows x on x.n = s.n and x.s = array_to_string(s.w[s.i + 1:s.i + s.n], ' ')),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered using (doc_id) left join named using (doc_id)
"""


@query
def op5_url_filters(spark, sf_dir):
    """With the one strength of all levels that its SQL has."""
    return reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), shared_strength=True)


@query
def op5_url_filters_by_level(spark, sf_dir):
    return reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLES["op5_url_filters"] = r"""
with parsed as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
    from pages),
known as (select doc_id, max(1 - quality) as bad from labels where quality in (0, 1) and doc_id is not null group by doc_id),
hosts as (
    select host, count(bad) as n, coalesce(sum(bad), 0) as bad, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix
    from parsed left join known on doc_id = page_id group by host),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
tops as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
moments as (select sum(bad) / sum(n) as mean, sum((bad / n) * (bad / n) * n) / sum(n) as square from tops where n > 0),
prior as (
    select coalesce(mean, 0.5::double) as mean,
           coalesce(case when square - mean * mean > 0 then greatest(1, least(100, mean * (1 - mean) / (square - mean * mean) - 1)) end, 2::double) as strength
    from moments),
top as (select suffix, (bad + strength * mean) / (n + strength) as mean, strength from tops, prior),
middle as (select domain, (d.bad + strength * mean) / (d.n + strength) as mean, strength from domains d join top using (suffix)),
posterior as (select host, h.bad + strength * mean as a, h.n - h.bad + strength * (1 - mean) as b from hosts h join middle using (domain)),
standing as (
    select host, round(a / (a + b), 9) as bad_rate, round(greatest(0, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 9) as bound from posterior),
ruled as (
    select *, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                   when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                   when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                   when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
    from parsed)
select page_id, r.host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when bound > 0.5 then 'block' else 'allow' end as verdict,
       bad_rate, bound
from ruled r join standing using (host)
"""


@query
def op6_quality_classifier(spark, sf_dir):
    return neighbours.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_lm_scoring(spark, sf_dir):
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


@query
def op8_token_binary_output(spark, sf_dir):
    path = token_files.write_ids(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE))
    return token_files.read_summary(spark, path)


@query
def op9_quality_rules(spark, sf_dir):
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


#: a conversation of control strings, formatted along with the table
CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


@query
def op10_chat_formatting(spark, sf_dir):
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.formatted_and_read(rows.unionByName(own), vocabulary_file(BYTE_BPE))


@query
def op11_html_extraction(spark, sf_dir):
    return main_text.page_texts(table(spark, sf_dir, "pages"))


@query
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = r"""
with recursive crc as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
runs as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
    from documents),
counted as (select doc_id, run, count(*) as n from runs group by doc_id, run),
hashed as (
    select run, n, xor(4294967295, list_reduce(
               list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
                   lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 | (unicode(c) >> 6))::bigint, (128 | (unicode(c) & 63))::bigint] end))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
    from counted, crc),
words as (
    select case when h % 97 = 0 then run[:h % len(run)] || run[h % len(run) + 2:] else run end as word, sum(n)::bigint as n
    from hashed group by word having len(word) >= 5 and sum(n) >= 3),
holes as (select word, unnest(range(1, len(word) + 1)) as i, word[:i - 1] || word[i + 1:] as rest from words),
near as (
    select a.word, b.word as other from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select word, rest from holes where rest in (select word from words)
    union select rest, word from holes where rest in (select word from words)),
best as (
    select near.word, count(*) as n_near, min({'less': -n, 'word': other}) as b from near join words on words.word = other group by near.word),
forms as (
    select w.word, case when -b.less >= 2 * n then b.word end as form, n, coalesce(n_near, 0) as n_near, case when -b.less >= 2 * n then -b.less end as form_n
    from words w left join best on best.word = w.word),
chains as (
    select word, word as at from forms
    union all select c.word, f.form from chains c join forms f on f.word = c.at where f.form is not null)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from forms f join chains c on c.word = f.word join forms e on e.word = c.at where e.form is null
"""


@query
def op13_vector_codes(spark, sf_dir):
    return product_codes.product_codes(table(spark, sf_dir, "embeddings"))


def _round(k):
    """Parts with the nearest entry of codebook k, and the codebook after that."""
    return f"""
near{k} as materialized (
    select p.id, p.part, min({{'d': list_sum(list_transform(list_zip(x, c.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': c.e}}) as best, any_value(x) as x
    from parts p join book{k} c on c.part = p.part group by p.id, p.part),
sums{k} as (
    select part, e, i, sum(v) as s, count(*) as n
    from (select part, best.e as e, generate_subscripts(x, 1) as i, unnest(x) as v from near{k}) group by part, e, i),
means{k} as (select part, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as entry from sums{k} group by part, e),
book{k + 1} as materialized (select c.part, c.e, coalesce(m.entry, c.entry) as entry from book{k} c left join means{k} m on m.part = c.part and m.e = c.e),"""


ORACLES["op13_vector_codes"] = f"""
with kept as materialized (
    select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select id, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] as x from kept, (select unnest(range(8)) as part)),
book0 as materialized (select part, id - 1 as e, x as entry from parts where id <= 16),{"".join(_round(k) for k in range(6))}
final as (
    select p.id, p.part, min({{'d': list_sum(list_transform(list_zip(x, c.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': c.e}}) as best
    from parts p join book6 c on c.part = p.part group by p.id, p.part),
coded as (select id, string_agg(format('{{:02x}}', best.e), '' order by part) as code, sum(best.d)::bigint as error from final group by id),
books as (select sha256(string_agg(array_to_string(entry, ','), ',' order by part, e)) as sha from book6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256
from kept join coded using (id), books
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

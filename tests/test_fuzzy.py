import random
from difflib import SequenceMatcher

from scanweave import constants as K
from scanweave.functions import fuzzy

RNG = random.Random(7)


def word(alphabet, low, high):
    return "".join(RNG.choice(alphabet) for _ in range(RNG.randint(low, high)))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_partial(a, b):
    """Every piece of the longer text no longer than the shorter one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    sides = [(a, b)] if len(a) < len(b) else [(b, a)] if len(a) > len(b) else [(a, b), (b, a)]
    best = 0.0
    for s, t in sides:
        m, n = len(s), len(t)
        pieces = [t[i:i + m] for i in range(n - m + 1)] + [t[:i] for i in range(1, m)] + [t[-i:] for i in range(1, m)]
        best = max([best] + [200.0 * lcs(s, p) / (m + len(p)) for p in pieces])
    return best


def test_ratio_is_difflibs_and_not_symmetric(values):
    rows = [("tide", "diet"), ("diet", "tide"), ("", ""), ("A", "")] + [(word("ABCD", 0, 12), word("ABCD", 0, 12)) for _ in range(200)]
    rows.append((word("AB", 180, 250), word("AB", 180, 250)))
    got = values(fuzzy.seq_ratio, rows, "a string, b string")
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in rows]
    assert got[0] == 0.25 and got[1] == 0.5


def test_partial_ratio_matches_brute_force(values):
    rows = [("", ""), ("", "A"), ("GANGAPPA", "CANGAPA"), ("ABC", "XXABCXX")]
    rows += [(word("ABCE ", 1, 9), word("ABCDE ", 0, 25)) for _ in range(300)]
    rows += [(word("ABC", 65, 90), word("ABC", 60, 120)) for _ in range(6)]
    rows += [(word("AB", 62, 64), word("AB", 64, 130)) for _ in range(6)]
    got = values(fuzzy.partial_ratio, rows, "a string, b string")
    for (a, b), g in zip(rows, got):
        assert abs(g - brute_partial(a, b)) < 1e-9, (a, b)


def test_choice_prefilter_never_changes_the_answer(values):
    def plain(text):
        compact = text.replace(" ", "").replace("-", "")
        best, top = text, 0.0
        for c in K.STATES:
            r = SequenceMatcher(None, compact, c.replace(" ", "")).ratio()
            if r > top:
                best, top = c, r
        return best if top >= K.STATE_MIN_RATIO else text

    rows = []
    for s in K.STATES:
        for _ in range(6):
            letters = list(s)
            for _ in range(RNG.randint(0, 4)):
                letters[RNG.randrange(len(letters))] = RNG.choice("AEIXRN ")
            rows.append(("".join(letters),))
    assert values(fuzzy.fuzzy_choice, rows, "t string") == [plain(t) for (t,) in rows]


def test_label_leakage(values):
    def share(field, raw):
        tokens = raw.split()
        hits = [any(SequenceMatcher(None, l, t).ratio() >= 0.84 for t in tokens) for l in K.FIELD_LABELS.get(field, [])]
        return sum(hits) / len(hits) if hits else 0.0

    rows = [("name", "LAST NAME NARASEMHAPPA"), ("gender", "LAST"), ("pin", "PINC0DE ZIP 560001"), ("dob", ""), ("address", "ADRESS STATES CITI")]
    assert values(fuzzy.label_leakage, rows, "f string, t string") == [share(*r) for r in rows]


def test_ratio_equals_the_library_for_all_shapes_of_texts():
    rng = random.Random(11)
    pairs = [("", "A"), ("A", ""), ("AB" * 99, "BA" * 99), ("AB" * 120, "BA" * 150), ("X" + "AB" * 120, "AB" * 99)]
    for letters, most in (("AB", 12), ("AB ", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ ", 60), ("ABC", 230)):
        for _ in range(400):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(2))
            at = rng.randrange(len(a) + 1)
            pairs += [(a, b), (a, a[:at] + "X" + a[at + 1:]), (a[:at] + "XY" + a[at:], a)]
    assert [p for p in pairs if fuzzy.gestalt_ratio(*p) != SequenceMatcher(None, *p).ratio()] == []
    fuzzy.gestalt_ratio.cache_clear()

"""Stupid-backoff scores of every document under a bigram model of the whole corpus.

Every word counts as itself.  The frequent ones are numbered (bounded, broadcast with their
counts) and one number is the beginning of a text; any other word goes by 63 bits of its hash.
A bigram of numbers with its document's place in a slice of rows and its count there is eight
packed bytes, one with a hash is 22.  They are dealt by a hash of the bigram; each part is
at once the count table of its bigrams and their occurrences, so the two are joined by sorting:
a bigram seen often enough scores its count over its first word's, any other backs off to the
second word's share.  Where that word goes by its hash, the part asks the table of all such
words' counts, dealt by hash.  What parts add to each document goes to the slice and is summed.
"""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import mix, parts, settle, slices, word_hashes, words_of

#: words with a number of their own; the others are as exact, but go by their hash
NUMBERED = 1 << 17
BACKOFF = 0.4
LEAST_COUNT = 2
_U = np.uint64
_WORD, _DOC, _TIMES = 18, 16, 12
_HASHED = _U(1 << 63)
#: bits of a slice's number within its task, in a place of a document: task, slice, document
_AT = 24


def _count(batches):
    for _, texts in slices(batches):
        codes, _, names = words_of(pc.ascii_lower(texts))
        times = np.bincount(codes, minlength=len(names)) if len(codes) else np.zeros(len(names), np.int64)
        seen = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(seen)), pa.array(times[seen])], ["word", "n"])


def frequent_words(documents: DataFrame, size: int = NUMBERED):
    """The words with a number and their counts over all documents (at most size of them,
    words of about equal count enter together), the number of all words, and the table
    (word, n) of the words without a number."""
    counted = settle(documents.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    cut, taken, total = None, 0, 0
    for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        taken += r.words
        total += r.n
        if taken <= size:
            cut = r.level
    top = counted.where(level >= cut).orderBy("word").collect() if cut is not None else []
    return [r.word for r in top], [r.n for r in top], total, counted if cut is None else counted.where(level < cut)


class Model:
    """Numbers and counts of the words: 0 the rest (of a bounded vocabulary; otherwise the rest
    go by their hashes), 1 the beginning of a text, then the words."""

    def __init__(self, words, counts, total, texts, bounded):
        self.words, self.bounded = words, bounded
        rest = total - sum(counts)
        self.total = max(total, 1)
        self.counts = np.array([max(rest, 1), max(texts, 1), *counts], np.float64)
        self.index = None

    def codes(self, names):
        """Number of each word, or its hash with the top bit set."""
        if self.index is None:
            self.index = pa.array(self.words, pa.string())
        code = pc.fill_null(pc.add(pc.index_in(names, value_set=self.index), 2), 0).to_numpy(zero_copy_only=False).astype(_U)
        rest = np.flatnonzero(code == 0)
        if not self.bounded and len(rest):
            code[rest] = word_hashes(names.take(pa.array(rest))) | _HASHED
        return code

    def log_scores(self, pair, count):
        """Natural log score of a bigram that occurs count times."""
        a, b = (pair >> _U(_WORD)).astype(np.int64), (pair & _U((1 << _WORD) - 1)).astype(np.int64)
        seen = np.log(count / self.counts[a])
        return np.where(count >= LEAST_COUNT, np.minimum(seen, 0), np.log(BACKOFF) + np.log(self.counts[b] / self.total))

    def log_known(self, a, b, count):
        """The same for bigrams with a hash, without the term of the hashed word's own count;
        that word (a number if none is wanted) and the sign of its log count."""
        often = count >= LEAST_COUNT
        word = np.where(often, a, b)
        sign = np.where(often, -1, 1)
        own = np.log(self.counts[np.where(word < _HASHED, word, _U(0)).astype(np.int64)])
        return np.where(often, np.log(count), np.log(BACKOFF) - np.log(self.total)) + np.where(word < _HASHED, sign * own, 0.0), word, sign


_PACKED = "bucket int, slice binary, ids binary, sizes binary, keys binary, hashed binary"
_ASKED = "bucket int, words binary, places binary, weights binary, counts binary"
_SUMS = "slice binary, bucket int, ids binary, sizes binary, docs binary, sums binary"


def _rows(schema, rows):
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _deal(dealt, *columns):
    """(part, bytes of its rows, column by column) in the order of parts."""
    if not len(dealt):
        return
    order = np.argsort(dealt, kind="stable")
    dealt, columns = dealt[order], [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(dealt[a]), b"".join(c[a:b].tobytes() for c in columns)


def _pack_hashed(a, b, doc, buckets):
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.concatenate([heads, [len(a)]])).astype(np.int32)
    a, b, doc = a[heads], b[heads], doc[heads].astype(np.uint16)
    return _deal((mix(mix(a) + b) % _U(buckets)).astype(np.int32), a, b, times, doc)


def _unpack(data, *kinds):
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    at = 0
    for k in kinds:
        yield np.frombuffer(data, k, n, at)
        at += n * np.dtype(k).itemsize


def _counted_hashed(model, found):
    """From (slice, packed bigrams with a hash) of one part: the slice and the place in it of
    each occurrence, what is known of its score, the word whose count is wanted, its weight."""
    a, b, times, doc = (np.concatenate(x) for x in zip(*(tuple(_unpack(d, _U, _U, np.int32, np.uint16)) for _, d in found)))
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(d) // 22 for _, d in found])
    order = np.lexsort((b, a))
    a, b, times, doc, owner = a[order], b[order], times[order], doc[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    runs = np.diff(np.concatenate([heads, [len(a)]]))
    known, word, sign = model.log_known(a[heads], b[heads], np.add.reduceat(times, heads, dtype=np.int64))
    return owner, doc, np.repeat(known, runs) * times, np.repeat(word, runs), np.repeat(sign, runs) * times


def _ask(model, buckets):
    """The words of a part that go by their hash and whose counts its bigrams want."""
    def run(batches):
        found = [(r["slice"], r["hashed"]) for batch in batches for r in batch.select(["slice", "hashed"]).to_pylist() if r["hashed"] is not None]
        if not found:
            return
        owner, doc, _, word, weight = _counted_hashed(model.value, found)
        marks = np.array([p << _AT | at for p, at in (struct.unpack("<qq", m) for m, _ in found)], np.int64)
        wanted = np.flatnonzero(word >= _HASHED)
        place, word, weight = marks[owner[wanted]] << _DOC | doc[wanted], word[wanted], weight[wanted].astype(np.int32)
        rows = []
        for to, data in _deal((mix(word) % _U(buckets)).astype(np.int32), word, place, weight):
            n = len(data) // 20
            rows.append((to, data[: 8 * n], data[8 * n : 16 * n], data[16 * n :], None))
        for a in range(0, len(rows), 64):
            yield _rows(_ASKED, rows[a : a + 64])
    return run


def _hashed_counts(buckets):
    """The counts of the words without a number, by hash."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            word = word_hashes(batch.column("word")) | _HASHED
            rows = []
            for to, data in _deal((mix(word) % _U(buckets)).astype(np.int32), word, batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)):
                rows.append((to, data[: len(data) // 2], None, None, data[len(data) // 2 :]))
            yield _rows(_ASKED, rows)
    return run


def _answer(batches):
    """Adds the log counts of the words asked for to the places that asked."""
    part = TaskContext.get().partitionId()
    words, counts, asked, places, weights = [], [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["counts"] is not None:
                words.append(np.frombuffer(r["words"], _U))
                counts.append(np.frombuffer(r["counts"], np.int64))
            else:
                asked.append(np.frombuffer(r["words"], _U))
                places.append(np.frombuffer(r["places"], np.int64))
                weights.append(np.frombuffer(r["weights"], np.int32))
    if not asked:
        return
    words, back = np.unique(np.concatenate(words), return_inverse=True)
    logs = np.log(np.bincount(back, np.concatenate(counts)))
    asked, place = np.concatenate(asked), np.concatenate(places)
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    if (words[at] != asked).any():
        raise RuntimeError("a word of the table was not counted")
    gained = logs[at] * np.concatenate(weights)
    order = np.lexsort((gained, place))
    place, gained = place[order], gained[order]
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sums, place = np.add.reduceat(gained, heads), place[heads]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place >> _DOC)) + 1, [len(place)]]).tolist()
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        mark = int(place[a] >> _DOC)
        rows.append((struct.pack("<qq", mark >> _AT, mark & ((1 << _AT) - 1)), -1 - part, None, None, (place[a:b] & ((1 << _DOC) - 1)).astype(np.uint16).tobytes(), sums[a:b].tobytes()))
    for a in range(0, len(rows), 64):
        yield _rows(_SUMS, rows[a : a + 64])


def _bigrams(model, buckets):
    def run(batches):
        part = TaskContext.get().partitionId()
        for at, (rows, texts) in enumerate(slices(batches)):
            codes, starts, names = words_of(pc.ascii_lower(texts))
            ids = rows.column("doc_id")
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            head = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + known.astype(np.uint8).tobytes()
            mark = struct.pack("<qq", part, at)
            sizes = np.diff(starts)
            yield _rows(_PACKED, [((part + at) % buckets, mark, head, sizes.astype(np.int64).tobytes(), None, None)])
            if not len(codes):
                continue
            word = model.value.codes(names)[codes]
            before = np.concatenate([np.ones(1, _U), word[:-1]])
            before[starts[:-1][sizes > 0]] = 1
            doc = np.repeat(np.arange(len(sizes)), sizes).astype(_U)
            hashed = (before | word) >= _HASHED
            if hashed.any():
                packed = [(to, mark, None, None, None, data) for to, data in _pack_hashed(before[hashed], word[hashed], doc[hashed], buckets)]
                for a in range(0, len(packed), 64):
                    yield _rows(_PACKED, packed[a : a + 64])
                before, word, doc = before[~hashed], word[~hashed], doc[~hashed]
            if not len(word):
                continue
            key = np.sort((((before << _U(_WORD)) | word) << _U(_DOC)) | doc)
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.concatenate([heads, [len(key)]]))
            key = key[heads]
            most = (1 << _TIMES) - 1
            again = (times + most - 1) // most
            key, times = np.repeat(key, again), np.minimum(np.repeat(times, again) - (np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)) * most, most)
            key = (key << _U(_TIMES)) | times.astype(_U)
            dealt = (mix(key >> _U(_DOC + _TIMES)) % _U(buckets)).astype(np.int32)
            packed = [(to, mark, None, None, data, None) for to, data in _deal(dealt, key)]
            for a in range(0, len(packed), 64):
                yield _rows(_PACKED, packed[a : a + 64])
    return run


def _score(model):
    def run(batches):
        part = TaskContext.get().partitionId()
        marks, keys, owner, found = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["hashed"] is not None:
                    found.append((r["slice"], r["hashed"]))
                    continue
                if r["keys"] is None:
                    yield _rows(_SUMS, [(r["slice"], part, r["ids"], r["sizes"], None, None)])
                    continue
                keys.append(np.frombuffer(r["keys"], _U))
                owner.append(np.full(len(keys[-1]), len(marks), np.int32))
                marks.append(r["slice"])
        places, gains = [], []
        if keys:
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            del order
            times = (keys & _U((1 << _TIMES) - 1)).astype(np.int32)
            doc = ((keys >> _U(_TIMES)) & _U((1 << _DOC) - 1)).astype(np.int64)
            pair = keys >> _U(_DOC + _TIMES)
            heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            runs = np.diff(np.concatenate([heads, [len(pair)]]))
            del keys
            total = np.add.reduceat(times, heads, dtype=np.int64)
            gains.append(np.repeat(model.value.log_scores(pair[heads], total), runs) * times)
            places.append(owner.astype(np.int64) << _DOC | doc)
            del pair, times, doc, owner, runs, total
        if found:
            at = {m: i for i, m in enumerate(marks)}
            for m, _ in found:
                if at.setdefault(m, len(marks)) == len(marks):
                    marks.append(m)
            owner, doc, gained, _, _ = _counted_hashed(model.value, found)
            places.append(np.array([at[m] for m, _ in found], np.int64)[owner] << _DOC | doc)
            gains.append(gained)
            del owner, doc, found
        if not places:
            return
        place, gained = np.concatenate(places), np.concatenate(gains)
        del places, gains
        order = np.argsort(place, kind="stable")
        place, gained = place[order], gained[order]
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums, place = np.add.reduceat(gained, heads), place[heads]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place >> _DOC)) + 1, [len(place)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _rows(_SUMS, [(marks[place[a] >> _DOC], part, None, None, (place[a:b] & ((1 << _DOC) - 1)).astype(np.uint16).tobytes(), sums[a:b].tobytes())])
    return run


_SCORES = "doc_id long, n_words long, log_score double"


def _gather(batches):
    metas, found = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["docs"] is None:
                metas[r["slice"]] = r
            else:
                found.setdefault(r["slice"], []).append((r["bucket"], r["docs"], r["sums"]))
    for mark, r in metas.items():
        sizes = np.frombuffer(r["sizes"], np.int64)
        n = len(sizes)
        ids, known = np.frombuffer(r["ids"][: 8 * n], np.int64), np.frombuffer(r["ids"][8 * n :], np.uint8)
        total = np.zeros(n)
        for _, docs, sums in sorted(found.get(mark, [])):
            total[np.frombuffer(docs, np.uint16)] += np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(np.round(total, 6))], ["doc_id", "n_words", "log_score"])


def lm_scores(documents: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score and perplexity.

    Counts cover all rows, repeated ones as often as they occur, and all words; only a caller
    who names a vocabulary gets a model of that many frequent words with one word for the rest.
    NULL and blank texts have no words, the score 0 and no mean.  Rows are scored one by one
    whatever their doc_id; other columns are not read."""
    bounded = vocabulary is not None
    size = vocabulary if bounded else NUMBERED
    if size + 2 > 1 << _WORD:
        raise ValueError("words must be numbered in 18 bits")
    spark = documents.sparkSession
    n = 2 * parts(spark)
    words, counts, total, others = frequent_words(documents, size)
    texts = documents.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()
    model = spark.sparkContext.broadcast(Model(words, counts, total, texts, bounded))
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bigrams(model, n), _PACKED)
    dealt = packed.repartition(n, "bucket")
    sums = dealt.mapInArrow(_score(model), _SUMS)
    if not bounded:
        asked = dealt.mapInArrow(_ask(model, n), _ASKED).unionByName(others.mapInArrow(_hashed_counts(n), _ASKED))
        sums = sums.unionByName(asked.repartition(n, "bucket").mapInArrow(_answer, _SUMS))
    scored = sums.repartition(n, "slice").mapInArrow(_gather, _SCORES)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_score", F.round(mean, 6).alias("mean_log_score"), F.round(F.exp(-mean), 4).alias("perplexity"))

"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when their sets of five-word shingles satisfy 100*|A and B| >= 75*|A or B|.
A document can only link if at least three quarters of its shingles occur in another one, and
only to a document that shares one of its rarest shared shingles (those left after taking away
the overlap it needs).  So:

1. One pass over the texts makes the sets (64-bit keyed hashes).  Equal sets of a slice of rows
   are one posting source.  Postings travel packed, eight bytes each, dealt by shingle.
2. Each part sorts its postings; shingles found once are dropped, the others go back to their
   slice with their document frequency.  Documents with too few shared shingles are settled.
3. Equal sets become one class.  The rarest shingles of the classes left tie them into families.
4. Within each family (cut into blocks of bounded size) DivideSkip finds all partners: merge the
   short inverted lists, keep what reaches T minus the number of long lists, probe the long lists
   by binary search, test exactly.  Links leave a task as a forest and counts, never as pairs.
"""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.components import components
from scanweave.llm.shared import binaries, mix, parts, settle, slices, spare, word_hashes, words_of

WIDTH = 5
BLOCK_SETS = 2048
BLOCK_ITEMS = 2_000_000
_LOW = np.uint64(0xFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def required(n):
    """Least overlap of a set of n with any set it links to: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def linked(overlap, n, m):
    return 7 * overlap >= 3 * (n + m)


def shingle_sets(texts, width=WIDTH):
    """Sorted distinct shingle hashes of each text.  Fewer words than width: the sequence as
    one; no words: none."""
    codes, starts, names = words_of(pc.ascii_lower(texts))
    n_docs = len(starts) - 1
    if not len(codes):
        return [np.empty(0, _U)] * n_docs
    h = word_hashes(names).astype(_U)[codes]
    run = h.copy()
    for k in range(1, width):
        run[: len(h) - k] = run[: len(h) - k] * _STEP + h[k:]
    run = mix(run)
    out = []
    for i in range(n_docs):
        a, b = starts[i], starts[i + 1]
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            v = _U(b - a)
            for x in h[a:b]:
                v = v * _STEP + x
            out.append(mix(np.array([v ^ _U(0x5851F42D4C957F2D)])))
        else:
            out.append(np.empty(0, _U))
    return out


def _digest(s):
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return struct.pack("<QQ", int(np.add.reduce(mix(s))), int(np.add.reduce(mix(s ^ _STEP)) ^ _U(len(s))))


_POSTINGS = "bucket int, slice binary, ids binary, sizes binary, sets binary, keys binary"
_SHARED = "slice binary, ids binary, sizes binary, sets binary, keys binary, dfs binary"
_SETS = "doc_id long, n long, cls binary, items binary"


def _emit_postings(buckets):
    def run(batches):
        np.seterr(over="ignore")
        part = TaskContext.get().partitionId()
        for at, (rows, texts) in enumerate(slices(batches)):
            sets = shingle_sets(texts)
            digests = [_digest(s) for s in sets]
            first = {}
            for i, d in enumerate(digests):
                if d is not None:
                    first.setdefault(d, i)
            ids = rows.column("doc_id")
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            id_bytes = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + known.astype(np.uint8).tobytes()
            mark = struct.pack("<qq", part, at)
            keys = [((s >> _U(16)) << _U(16)) | _U(i) for d, i in first.items() if len(s := sets[i])]
            keys = np.concatenate(keys) if keys else np.empty(0, _U)
            dealt = ((keys >> _U(16)) % _U(buckets)).astype(np.int32)
            order = np.argsort(dealt, kind="stable")
            keys, dealt = keys[order], dealt[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]]) if len(dealt) else [0]
            packed = [(int(dealt[a]), keys[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            meta = (id_bytes, np.array([len(s) for s in sets], np.int64).tobytes(), b"".join(d or bytes(16) for d in digests))
            yield _batch(_POSTINGS, [((part + at) % buckets, mark, *meta, None)])
            for a in range(0, len(packed), 64):
                yield _batch(_POSTINGS, [(b, mark, None, None, None, k) for b, k in packed[a : a + 64]])
    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema, rows):
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _shared_only(batches):
    """Of one part of all postings: those of shingles with two sources or more."""
    marks, keys, owner = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["keys"] is None:
                yield _batch(_SHARED, [(r["slice"], r["ids"], r["sizes"], r["sets"], None, None)])
                continue
            keys.append(np.frombuffer(r["keys"], _U))
            owner.append(np.full(len(keys[-1]), len(marks), np.int32))
            marks.append(r["slice"])
    if not keys:
        return
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys >> _U(16), kind="stable")
    keys, owner = keys[order], owner[order]
    del order
    token = keys >> _U(16)
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(token)]]))
    df = np.repeat(sizes, sizes).astype(np.uint32)
    del token
    keep = df > 1
    keys, owner, df = keys[keep], owner[keep], df[keep]
    order = np.argsort(owner, kind="stable")
    keys, owner, df = keys[order], owner[order], df[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield _batch(_SHARED, [(marks[owner[a]], None, None, None, keys[a:b].tobytes(), df[a:b].tobytes())])


def _assemble(batches):
    """One row per document; items are its shared shingles, rarest first, where enough of
    them are shared for any link."""
    metas, found = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["keys"] is None:
                metas[r["slice"]] = r
            else:
                found.setdefault(r["slice"], []).append((np.frombuffer(r["keys"], _U), np.frombuffer(r["dfs"], np.uint32)))
    for mark, r in metas.items():
        sizes = np.frombuffer(r["sizes"], np.int64)
        count = len(sizes)
        ids, known = np.frombuffer(r["ids"][: 8 * count], np.int64), np.frombuffer(r["ids"][8 * count :], np.uint8)
        items = [None] * count
        if got := found.pop(mark, None):
            keys, df = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            doc = (keys & _LOW).astype(np.int64)
            order = np.lexsort((keys, df, doc))
            keys, doc = keys[order] >> _U(16), doc[order]
            at = np.searchsorted(doc, np.arange(count + 1))
            for i in np.flatnonzero(np.diff(at) >= np.maximum(1, required(sizes))):
                items[i] = keys[at[i] : at[i + 1]].tobytes()
        rows = [(int(ids[i]) if known[i] else None, int(sizes[i]), r["sets"][16 * i : 16 * i + 16] if sizes[i] else None, items[i]) for i in range(count)]
        for a in range(0, count, 512):
            yield _batch(_SETS, rows[a : a + 512])


def document_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, n, cls, items) for every row.  cls is the same for equal sets, NULL for empty
    ones; items (packed shingles, rarest first) are NULL where no link to another set is possible,
    or where an equal set of the same slice has them."""
    n = parts(documents.sparkSession)
    postings = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_emit_postings(n), _POSTINGS)
    shared = postings.repartition(n, "bucket").mapInArrow(_shared_only, _SHARED)
    return shared.repartition(n, "slice").mapInArrow(_assemble, _SETS)


class _Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _explode_prefix(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            sizes = part.column("n").to_pylist()
            tokens, owner = [], []
            for i, (n, raw) in enumerate(zip(sizes, part.column("items").to_pylist())):
                t = np.frombuffer(raw, np.int64)
                take = len(t) - required(n) + 1
                tokens.append(t[:take])
                owner.append(np.full(take, i, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), part.column("cls").take(pa.array(np.concatenate(owner)))], ["token", "cls"])


def _tie_families(batches):
    """Classes with a prefix shingle in common, as a forest of this part."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    token = t.column("token").to_numpy()
    coded = t.column("cls").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(token, kind="stable")
    token, code = token[order], code[order]
    same = np.flatnonzero(token[1:] == token[:-1])
    pairs = np.unique(np.stack([code[same], code[same + 1]], 1), axis=0) if len(same) else np.empty((0, 2), int)
    forest = _Forest()
    for a, b in pairs.tolist():
        forest.tie(a, b)
    names = coded.dictionary.to_pylist()
    rows = [(names[x], names[forest.find(x)]) for x in forest.up]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([binaries([r[0] for r in rows]), binaries([r[1] for r in rows])], ["a", "b"])


class Index:
    """Inverted index over a block of sets, and the T-occurrence search in it."""

    def __init__(self, sets):
        self.sizes = np.array([n for n, _ in sets], np.int64)
        token = np.concatenate([t for _, t in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(t) for _, t in sets])
        order = np.argsort(token, kind="stable")
        token, self.docs = token[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.tokens, self.starts = token[heads], np.concatenate([heads, [len(token)]])

    def search(self, n, tokens):
        """Sets of the block that link to the set of n shingles with these shared ones."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        need = required(n)
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.starts[at + 1] - self.starts[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        longest = int(length[-1])
        n_long = min(need - 1, int(need / (0.01 * np.log2(max(2, longest)) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.sort(np.concatenate([self.docs[self.starts[i] : self.starts[i + 1]] for i in short]), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.concatenate([heads, [len(merged)]]))
        found = merged[heads]
        fit = (count >= need - n_long) & (4 * self.sizes[found] >= 3 * n) & (3 * self.sizes[found] <= 4 * n)
        found, count = found[fit], count[fit]
        left = n_long
        for i in long:
            if not len(found):
                break
            docs = self.docs[self.starts[i] : self.starts[i + 1]]
            p = np.searchsorted(docs, found)
            p[p == len(docs)] = 0
            count = count + (docs[p] == found)
            left -= 1
            fit = count + left >= need
            if not fit.all():
                found, count = found[fit], count[fit]
        return found[linked(count, n, self.sizes[found])].astype(np.int64)


_LINKS = "a binary, b binary, links long"


def _search_blocks(batches):
    """Rows come sorted by (family, block, role): first the sets of the block (role 0), then
    sets of other blocks to look up in it (role 1), one at a time."""
    key, members, index, forest, links, deferred = None, [], None, None, None, []

    def flush():
        if not members:
            return
        build()
        rows = [(members[i][0], members[forest.find(i)][0], int(links[i])) for i in range(len(members))]
        rows += [(c, members[forest.find(i)][0], k) for c, i, k in deferred]
        for a in range(0, len(rows), 4096):
            yield _batch(_LINKS, rows[a : a + 4096])

    def build():
        nonlocal index, forest, links
        if index is not None:
            return
        index, forest, links = Index([(m[1], m[3]) for m in members]), _Forest(), np.zeros(len(members), np.int64)
        weight = np.array([m[2] for m in members], np.int64)
        for i, m in enumerate(members):
            found = index.search(m[1], m[3])
            found = found[found != i]
            links[i] += int(weight[found].sum())
            for j in found.tolist():
                forest.tie(i, j)

    for batch in batches:
        for r in batch.to_pylist():
            if (k := (r["family"], r["block"])) != key:
                yield from flush()
                key, members, index, deferred = k, [], None, []
            row = (r["cls"], r["n"], r["copies"], np.frombuffer(r["items"], np.int64))
            if r["role"] == 0:
                members.append(row)
            elif members:
                build()
                found = index.search(row[1], row[3])
                if len(found):
                    links[found] += row[2]
                    for j in found[1:].tolist():
                        forest.tie(int(found[0]), j)
                    deferred.append((row[0], int(found[0]), int(sum(members[j][2] for j in found.tolist()))))
    yield from flush()


def ngram_links(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) and
    n_links (rows this one links to, copies included), one row per input row.

    NULL and blank texts have an empty set and link to nothing.  Rows with the same doc_id are
    rows of their own; a NULL doc_id takes part, but never names a component.  Other columns
    are not read.  An empty table gives an empty result."""
    spark = documents.sparkSession
    n = parts(spark)
    sets = settle(document_sets(documents))
    classes = settle(sets.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n")))
    carried = sets.where("items is not null").select("cls", "n", "items")
    lone = settle(carried.groupBy("cls").agg(F.min(F.struct("n", "items")).alias("x")).select("cls", "x.n", "x.items"))
    edges = lone.mapInArrow(_explode_prefix, "token long, cls binary").repartition(n, "token").mapInArrow(_tie_families, "a binary, b binary")
    families = settle(components(edges))
    member = lone.join(families.withColumnRenamed("node", "cls"), "cls").join(classes.select("cls", "copies"), "cls").select(
        "cls", "n", "copies", "items", F.col("root").alias("family"))
    shape = member.groupBy("family").agg(F.count("*").alias("sets"), (F.sum(F.length("items")) / 8).alias("volume")).select(
        "family", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("volume") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    own = member.join(shape, "family").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    sent = own.select("cls", "n", "copies", "items", "family", "own", F.explode(F.expr("sequence(own, blocks - 1)")).alias("block")).withColumn(
        "role", F.when(F.col("block") == F.col("own"), 0).otherwise(1)).drop("own")
    links = settle(sent.repartition(n, "family", "block").sortWithinPartitions("family", "block", "role").mapInArrow(_search_blocks, _LINKS))
    roots = components(links.select("a", "b"))
    degree = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left").select(
        "cls", "first_id", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = named.join(least, "root").select("cls", "component_id", "n_links")
    linked_rows = sets.where("cls is not null").select("doc_id", "n", "cls").join(answer, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    bare = sets.where("cls is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked_rows.unionByName(bare)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without all but the least doc_id of each group of linked ones.  Of rows
    that repeat a doc_id and text one stays; rows without a doc_id stay."""
    kept = ngram_links(documents).where("component_id = doc_id").select("doc_id").distinct()
    nth = spare(documents, "_nth")
    once = documents.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(
        nth, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(documents.where("doc_id is null")).select(documents.columns)

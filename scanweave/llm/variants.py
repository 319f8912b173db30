"""Spelling variants: near words found by blocked Gram matrices of letter counts.

A word's letter-count vector moves by squared distance 1 when a letter is inserted or deleted,
and by 2 when one is replaced.  So only pairs at squared distance 2 in one length, or 1 between
adjacent lengths, can be one edit apart.  Words are put into blocks by length and by how many of
their letters fall into each of ``GROUPS`` fixed letter groups; an edit moves these counts by one
at most, so a block meets itself and few neighbouring blocks.  Blocks are cut into chunks of at
most ``CHUNK`` words, one row each; a task multiplies count matrices of a chunk and its partners
with NumPy, keeps pairs at most two apart, verifies the edit letter by letter, and returns one
partial result per word, never a pair.  A block of any size is dealt out over many tasks: each
gets ``CHUNKS_PER_TASK`` of its chunks and all partners, which stream past.

Results for odd input: NULL or empty texts have no runs; NULL ids count as empty text in the
hash; repeated rows count as often as they occur; an empty table gives no rows; ties of the
largest count fall to the smallest word; columns beyond doc_id and text are not read.
"""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import parts, settle, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: an occurrence loses a letter if this divides its hash
DAMAGED = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: letter groups of a block's key: letter number modulo this
GROUPS = 4
#: words of a chunk, and bytes of it at most (one word at least)
CHUNK, CHUNK_BYTES = 4096, 1 << 20
#: chunks of one block that a task compares with all partners
CHUNKS_PER_TASK = 8
#: rows and columns of one product
TILE = 2048
#: distinct words that a task counts before it passes them on, and characters it cuts at once
HELD_WORDS = 1 << 18
PIECE = 1 << 20


# --- words -----------------------------------------------------------------------------------
def damaged(run: str, seed: int) -> str:
    """The lower-cased run, without one letter where the hash says so.  ``seed`` is the crc32
    of the document's id and a colon."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(run.encode(), seed)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def pieces(text: str):
    """Cuts a long text between runs."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def _counted(batches):
    """(word, n) of the words long enough, summed over the documents of a task in stages."""
    held = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch, texts in slices(batches):
        ids = batch.column("id").to_pylist()
        for id_, text in zip(ids, texts.to_pylist()):
            seed = zlib.crc32(f"{id_}:".encode())
            for piece in pieces(text):
                for run, n in Counter(RUN.findall(piece)).items():
                    word = damaged(run, seed)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
    if held:
        yield flush()


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n of every word with at least MIN_LENGTH letters and MIN_COUNT occurrences."""
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- blocks ----------------------------------------------------------------------------------
def letter_numbers(words, length) -> np.ndarray:
    """Code points of equally long words, one row each; all of them fit a byte."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def group_counts(codes: np.ndarray) -> np.ndarray:
    """How many letters of each word fall into each group."""
    return np.stack([(codes % GROUPS == g).sum(axis=1) for g in range(GROUPS)], axis=1)


def block_name(length, counts) -> str:
    return ".".join(map(str, (length, *counts)))


def partner_blocks(length, counts) -> list[str]:
    """Blocks where words one edit away may lie: the block itself, those a replaced letter leads
    to, and those one letter longer.  Of two blocks of one length, only the lesser key looks at
    the greater one, so every pair of words meets once."""
    counts = list(counts)
    names = [block_name(length, counts)]
    for g, h in combinations(range(GROUPS), 2):
        for down, up in ((g, h), (h, g)):
            moved = list(counts)
            moved[down] -= 1
            moved[up] += 1
            if moved[down] >= 0 and moved > counts:
                names.append(block_name(length, moved))
    for g in range(GROUPS):
        longer = list(counts)
        longer[g] += 1
        names.append(block_name(length + 1, longer))
    return names


_CHUNK_SCHEMA = "block string, chunk string, partners array<string>, words array<string>, ns array<long>"


def _chunks(batches):
    """Packs the words of each block, which arrive together, into rows.  A block that goes on in
    the next batch starts another chunk there.  The name of a chunk is its block's and its
    first word."""
    for batch in batches:
        blocks, words, ns = (batch.column(c).to_pylist() for c in ("block", "word", "n"))
        at, out = 0, []
        while at < len(words):
            length = len(words[at])
            limit = min(CHUNK, max(1, CHUNK_BYTES // length))
            to = at + 1
            while to < len(words) and to - at < limit and blocks[to] == blocks[at]:
                to += 1
            counts = [int(c) for c in blocks[at].split(".")[1:]]
            out.append((blocks[at], words[at], partner_blocks(length, counts), words[at:to], ns[at:to]))
            at = to
        columns = list(zip(*out))
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
        for from_ in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[from_:from_ + 64], t) for c, t in zip(columns, types)],
                names=["block", "chunk", "partners", "words", "ns"])


def _with_blocks(batches):
    for batch in batches:
        words = batch.column("word").to_pylist()
        names = [None] * len(words)
        by_length = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            for i, counts in zip(at, group_counts(letter_numbers([words[i] for i in at], length)).tolist()):
                names[i] = block_name(length, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), batch.column("word"), batch.column("n")], names=["block", "word", "n"])


def chunked(words: DataFrame) -> DataFrame:
    """The words as chunks of blocks.  A block is spread by ranges of (block, word), so one of
    any size lies in as many partitions as it needs."""
    blocks = words.mapInArrow(_with_blocks, "block string, word string, n long")
    return blocks.repartitionByRange(parts(words.sparkSession), "block", "word").sortWithinPartitions("block", "word").mapInArrow(_chunks, _CHUNK_SCHEMA)


# --- products --------------------------------------------------------------------------------
class Counts:
    """A chunk's words as codes and as rows of letter counts."""

    def __init__(self, words, ns):
        self.words, self.ns, self.length = words, ns, len(words[0])
        self.codes = letter_numbers(words, self.length)
        self.exact = np.float32 if self.length < 1 << 10 else np.float64  # whole numbers throughout
        rows = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(rows * 256 + self.codes.ravel(), minlength=len(words) * 256).reshape(-1, 256)
        self.used = self.counts.any(axis=0)

    def matrix(self, used, exact, left):
        """Rows whose product with those of the other side is minus the squared distance."""
        counts = self.counts[:, used].astype(exact)
        squares = (counts * counts).sum(axis=1, keepdims=True)
        ones = np.ones_like(squares)
        return np.hstack([2 * counts, -squares, ones] if left else [counts, ones, -squares])


def near_pairs(a: Counts, b: Counts):
    """Index pairs (i of a, j of b) exactly one edit apart; b's words have the length of a's or
    one letter more."""
    used, exact = a.used | b.used, np.promote_types(a.exact, b.exact)
    left, right = a.matrix(used, exact, True), b.matrix(used, exact, False)
    furthest = 2 if a.length == b.length else 1
    found = []
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            close = left[i:i + TILE] @ right[j:j + TILE].T >= -furthest
            at = np.flatnonzero(close)
            if not len(at):
                continue
            x, y = np.divmod(at, close.shape[1])
            for from_ in range(0, len(x), max(1, (1 << 23) // a.length)):
                to = from_ + max(1, (1 << 23) // a.length)
                u, v = x[from_:to] + i, y[from_:to] + j
                real = _one_edit(a.codes[u], b.codes[v])
                found.append((u[real], v[real]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of a is one replaced letter from that of b, or b's less one letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same_front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    same_back = np.logical_and.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(axis=1)
    return same_front + same_back >= a.shape[1]


class Best:
    """Per word of a chunk: how many near words were met, and the best of them."""

    def __init__(self, chunk):
        self.chunk, self.n_near = chunk, np.zeros(len(chunk.words), np.int64)
        self.best = {}

    def add(self, mine, other, theirs):
        if not len(mine):
            return
        np.add.at(self.n_near, mine, 1)
        ns = other.ns[theirs]
        # words of a chunk are in code-point order, so the first index is the smallest word
        order = np.lexsort((theirs, -ns, mine))
        first = order[np.concatenate([[True], np.diff(mine[order]) > 0])]
        for i, j in zip(mine[first].tolist(), theirs[first].tolist()):
            candidate = (-int(other.ns[j]), other.words[j])
            if i not in self.best or candidate < self.best[i]:
                self.best[i] = candidate

    def batch(self):
        at = np.flatnonzero(self.n_near).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([self.chunk.words[i] for i in at], pa.string()), pa.array(self.n_near[at], pa.int64()),
             pa.array([-self.best[i][0] for i in at], pa.int64()), pa.array([self.best[i][1] for i in at], pa.string())],
            names=["word", "n_near", "best_n", "best"])


def _chunk_of(row) -> Counts:
    return Counts(row["words"].as_py(), row["ns"].values.to_numpy(zero_copy_only=False))


def _products(batches):
    """The rows of a task come by (block, share): first the chunks that look for partners there,
    held (CHUNKS_PER_TASK at most), then the partners, one at a time."""
    home, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at] for c in batch.schema.names}
            place = (row["home"].as_py(), row["share"].as_py())
            if place != home:
                yield from (h.batch() for h in held if h.n_near.any())
                home, held = place, []
            if row["resident"].as_py():
                held.append(Best(_chunk_of(row)))
                held[-1].name = row["chunk"].as_py()
                continue
            name = row["chunk"].as_py()
            own = row["block"].as_py() == home[0]
            met = Best(_chunk_of(row))
            for resident in held:
                if own and name > resident.name:
                    continue  # the two chunks meet with the roles exchanged
                mine, theirs = near_pairs(met.chunk, resident.chunk)
                if own and name == resident.name:
                    ahead = mine < theirs
                    mine, theirs = mine[ahead], theirs[ahead]
                met.add(mine, resident.chunk, theirs)
                resident.add(theirs, met.chunk, mine)
            if met.n_near.any():
                yield met.batch()
    yield from (h.batch() for h in held if h.n_near.any())


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near word; ``words`` has distinct
    words (made of letters up to U+00FF) and their counts n."""
    chunks = settle(chunked(words))
    # chunks of a block get numbers that grow with their names; a block's chunks are few rows
    numbered = chunks.select("block", "chunk").groupBy("block").agg(F.array_sort(F.collect_list("chunk")).alias("names"))
    shares = numbered.select("block", F.ceil(F.size("names") / CHUNKS_PER_TASK).cast("int").alias("shares"), F.posexplode("names").alias("i", "chunk"))
    residents = chunks.join(shares.select("block", "chunk", F.floor(F.col("i") / CHUNKS_PER_TASK).cast("int").alias("share")), ["block", "chunk"]).select(
        F.col("block").alias("home"), "share", F.lit(True).alias("resident"), "block", "chunk", "words", "ns")
    looking = chunks.select(
        F.explode("partners").alias("home"), "block", "chunk", "words", "ns")
    homes = numbered.select(F.col("block").alias("home"), F.ceil(F.size("names") / CHUNKS_PER_TASK).cast("int").alias("shares"))
    partners = looking.join(homes, "home").select(
        "home", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("resident"), "block", "chunk", "words", "ns")
    dealt = residents.unionByName(partners).repartition(parts(words.sparkSession), "home", "share").sortWithinPartitions(
        "home", "share", F.desc("resident"), "chunk")
    met = dealt.mapInArrow(_products, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


# --- forms and roots -------------------------------------------------------------------------
def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: the end of the chain from form to form.  A form is at least twice as frequent
    as its word, so chains end; each round doubles the steps known, until no word moves."""
    state = settle(forms.withColumn("root", F.coalesce("form", "word")))
    while True:
        onward = state.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(state.join(onward, "root", "left").select(
            *forms.columns, F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return stepped.drop("moved")
        state = stepped.drop("moved")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = settle(word_counts(documents))
    near = near_words(words)
    forms = words.join(near, "word", "left").select(
        "word", F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n"))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")

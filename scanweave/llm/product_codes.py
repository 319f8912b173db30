"""Vectors as product codes, trained on integers with LAESA pivots.

Vectors become integers, are cut into ``PARTS`` equal parts, and each part position gets a codebook
of ``ENTRIES`` entries, refined in a fixed number of rounds.  Everything is whole-number
arithmetic, so the result does not depend on partitions.

Nearest entries are found as LAESA does.  ``PIVOTS`` fixed pivots are chosen per part position
(the entries of the first codebook that lie furthest apart); the distances from every part to
them are computed once and kept with the rows.  A round computes only the distances between
pivots and its entries; by the triangle inequality ``|d(part, pivot) - d(pivot, entry)|`` is a
lower bound of ``d(part, entry)``.  Entries are visited by rising bound, and the exact integer
distance is computed only where the bound does not pass the best one found so far.  Distances to
pivots are kept as 32-bit floating-point numbers, so each bound is lowered by more than its error.

A task returns its sums per entry and position; they are added by a grouping, and only the
codebooks (PARTS * ENTRIES entries) reach the driver.

Results for odd input: vectors that are NULL or hold NULL, NaN or infinite components are
dropped, as are those whose length differs from the vector with the smallest id; a length that
is no multiple of PARTS is filled up with zeros; with fewer than ENTRIES vectors, the codebooks
have that many entries; equal ids are ordered by their vectors, NULL ids come last; an empty
table gives no rows.  Components of any finite size are exact: from 2^22 on a slice is computed
with Python's integers.  An error beyond a long is NULL, and so is that of its label.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
PIVOTS = 3
#: components up to this size (exclusive) keep all sums and squares of a slice within 64 bits
SMALL = 1 << 22
#: relative error taken off a bound, and distances beyond which none is used
SLACK, FAR = 1e-6, 1e30
#: rows computed at once
ROWS = 8192
#: sums leave a task as digits of this many bits, so that sums over any table stay within a long
DIGIT_BITS = 30
#: labels that are broadcast with their errors at most; more are joined, each dealt to SALTS tasks
LABELS, SALTS = 100_000, 32
LONG_MAX = (1 << 63) - 1


def part_width(dimension: int) -> int:
    return -(-dimension // PARTS)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers, in 64 bits where all fit, else as Python integers."""
    x = x.astype(np.float64)  # SCALE is a power of two: the product is exact
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    exact = [math.floor(v) * SCALE if abs(v) >= 1 << 53 else math.floor(SCALE * v) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def lean(a: np.ndarray) -> np.ndarray:
    """In 64 bits where all numbers are small, else as Python integers."""
    small = a.dtype != object or not a.size or max(abs(v) for v in a.ravel().tolist()) < SMALL
    return a.astype(np.int64 if small else object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of a and b (paired, or b one row)."""
    d = a - b
    return (d * d).sum(axis=1)


def _distance(square) -> np.ndarray:
    """Roots of exact squares, which may be Python integers of any size."""
    if square.dtype != object:
        return np.sqrt(square.astype(np.float64))
    return np.array([math.sqrt(v) if v < 1 << 200 else math.inf for v in square.tolist()], np.float64)


def choose_pivots(entries: np.ndarray) -> list[int]:
    """Entries that lie far apart: the first one, then each time the one furthest from the last."""
    chosen = [0]
    nearest = squared(entries, entries[:1])
    while len(chosen) < min(PIVOTS, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1]][None]))
    return chosen


class Search:
    """Nearest entries of one part position.  ``entries`` are the round's, ``pivots`` fixed."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, pivots = lean(entries), lean(pivots)
        self.to_entries = np.stack([_distance(squared(self.entries, p[None])) for p in pivots])
        self.evaluated = 0

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances to all entries."""
        out = np.zeros((len(to_pivots), len(self.entries)))
        for d, e in zip(to_pivots.T.astype(np.float64), self.to_entries):
            d, e = np.where(d < FAR, d, np.nan)[:, None], np.where(e < FAR, e, np.nan)[None, :]
            np.fmax(out, np.abs(d - e) - SLACK * (d + e), out=out)
        return out * out * (1 - SLACK)

    def nearest(self, parts: np.ndarray, to_pivots: np.ndarray):
        """(index of the nearest entry, exact squared distance) of each row; ties to the lower index."""
        n, entries, bounds = len(parts), self.entries, self.bounds(to_pivots)
        order = np.argsort(bounds, axis=1, kind="stable")
        rows = np.arange(n)
        index = order[:, 0]
        best = squared(parts, entries[index])
        self.evaluated += n
        open_ = rows  # those whose next bound may still be reached
        for rank in range(1, len(entries)):
            entry = order[open_, rank]
            may = bounds[open_, entry] <= best[open_] if best.dtype != object else np.ones(len(open_), bool)
            open_, entry = open_[may], entry[may]  # bounds rise: who is done stays done
            if not len(open_):
                break
            found = squared(parts[open_], entries[entry])
            self.evaluated += len(open_)
            better = (found < best[open_]) | ((found == best[open_]) & (entry < index[open_]))
            at = open_[better]
            index[at], best[at] = entry[better], found[better]
        return index, best


# --- rows --------------------------------------------------------------------------------------
def _matrix(batch, column, dimension) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, dimension)


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows filled up with zeros and cut into parts: (rows, PARTS, width)."""
    width = part_width(x.shape[1])
    out = np.zeros((len(x), PARTS * width), x.dtype)
    out[:, :x.shape[1]] = x
    return out.reshape(len(x), PARTS, width)


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (floats or doubles) of the rows whose vector is whole and finite."""
    x = F.col("embedding")
    if embeddings.schema["embedding"].dataType.simpleString() != "array<float>":
        x = x.cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.select("vec_id", "label", x.alias("vector")).where(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))


def _with_pivots(dimension, pivots):
    """Adds the distances from each part to its position's pivots, flat."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                parts = _padded(whole_numbers(_matrix(rows, "vector", dimension)))
                gaps = np.stack([
                    np.stack([_distance(squared(parts[:, p], pivot[None])) for pivot in pivots[p]], axis=1) for p in range(PARTS)], axis=1)
                flat = gaps.reshape(rows.num_rows, -1).astype(np.float32)
                offsets = np.arange(rows.num_rows + 1, dtype=np.int32) * flat.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("label"), rows.column("vector"),
                     pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), pa.float32()))],
                    names=["vec_id", "label", "vector", "to_pivots"])

    return run


def _assigned(batches, dimension, searches):
    """(rows, parts, indexes, squared distances) of each slice."""
    pivots = searches[0].to_entries.shape[0]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            parts = _padded(whole_numbers(_matrix(rows, "vector", dimension)))
            gaps = _matrix(rows, "to_pivots", PARTS * pivots).reshape(-1, PARTS, pivots)
            found = [searches[p].nearest(parts[:, p], gaps[:, p]) for p in range(PARTS)]
            yield rows, parts, [f[0] for f in found], [f[1] for f in found]


def _sums(dimension, codebooks, pivots):
    """Per task: the sum of each entry's parts by position and, behind them, their count, in
    digits.  ``slot`` numbers (part, entry, position)."""
    width = part_width(dimension)

    def run(batches):
        searches = [Search(e, p) for e, p in zip(codebooks, pivots)]
        total = np.zeros((PARTS, len(codebooks[0]), width + 1), object)
        for _, parts, indexes, _ in _assigned(batches, dimension, searches):
            for p in range(PARTS):
                values = np.hstack([parts[:, p], np.ones((len(parts), 1), parts.dtype)])
                sums = np.zeros(total[p].shape, parts.dtype)
                np.add.at(sums, indexes[p], values)
                total[p] += sums
        slots, digits, values = [], [], []
        for slot, value in enumerate(total.ravel().tolist()):
            sign, value, digit = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                slots.append(slot)
                digits.append(digit)
                values.append(sign * (value & ((1 << DIGIT_BITS) - 1)))
                value >>= DIGIT_BITS
                digit += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int64()), pa.array(digits, pa.int32()), pa.array(values, pa.int64())], names=["slot", "digit", "value"])

    return run


def train(rows: DataFrame, dimension, codebooks, pivots):
    """The codebooks after ROUNDS rounds over all rows."""
    width = part_width(dimension)
    for _ in range(ROUNDS):
        sums = rows.select("vector", "to_pivots").mapInArrow(_sums(dimension, codebooks, pivots), "slot long, digit int, value long")
        total = np.zeros(PARTS * len(codebooks[0]) * (width + 1), object)
        for r in sums.groupBy("slot", "digit").agg(F.sum("value").alias("value")).collect():
            total[r["slot"]] += r["value"] << DIGIT_BITS * r["digit"]
        total = total.reshape(PARTS, -1, width + 1)
        codebooks = [
            np.array([[s // t[-1] for s in t[:-1]] if t[-1] else list(e) for e, t in zip(entries, total[p].tolist())], object).reshape(len(entries), width)
            for p, entries in enumerate(codebooks)]
    return codebooks


def _codes(dimension, codebooks, pivots):
    def run(batches):
        searches = [Search(e, p) for e, p in zip(codebooks, pivots)]
        for rows, _, indexes, squares in _assigned(batches, dimension, searches):
            codes = np.stack(indexes, axis=1).astype(np.uint8)
            errors = sum(s.astype(object) for s in squares).tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array([e if e <= LONG_MAX else None for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum over rows of an equal label (NULLs together)."""
    key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("some_label")]
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    whole = (F.count("error") == F.count(F.lit(1))) & (total <= F.lit(LONG_MAX))
    sums = settle(coded.groupBy(*key).agg(F.when(whole, total.cast("decimal(38,0)")).alias("s"))).select(
        "no_label", "some_label", F.col("s").cast("long").alias("label_error"))
    keyed = coded.select("*", *key)
    if sums.count() <= LABELS:
        return keyed.join(F.broadcast(sums), ["no_label", "some_label"]).drop("no_label", "some_label")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["no_label", "some_label", "salt"]).drop("no_label", "some_label", "salt")


def codebook_text(codebooks) -> str:
    return ",".join(str(int(v)) for entries in codebooks for entry in entries for v in entry)


def compress(embeddings: DataFrame):
    """(rows with vec_id, label, code, error; the codebooks, one array of entries per part)."""
    kept = kept_vectors(embeddings)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    dimension = len(first[0]["vector"])
    kept = kept.where(F.size("vector") == dimension)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    parts = _padded(whole_numbers(np.array([r["vector"] for r in start], np.float64).reshape(len(start), dimension)))
    codebooks = [parts[:, p].astype(object) for p in range(PARTS)]
    pivots = [lean(entries[choose_pivots(entries)]) for entries in codebooks]
    keys = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"
    vector = kept.schema["vector"].dataType.simpleString()
    rows = settle(kept.mapInArrow(_with_pivots(dimension, pivots), f"{keys}, vector {vector}, to_pivots array<float>"))
    codebooks = train(rows, dimension, codebooks, pivots)
    return settle(rows.mapInArrow(_codes(dimension, codebooks, pivots), f"{keys}, code string, error long")), codebooks


def product_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    coded, codebooks = compress(embeddings)
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

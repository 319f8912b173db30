"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level k holds the k-th chunk of every id
that has one, a bit per chunk that says whether the id goes on, and for every 512 of these bits
the number of ones before them.  The place of an id on the next level is its rank on this one,
so any id is found without decoding others.

The files are a table of segments in the shared folder, in ascending doc_id order.  A segment is
a row: its documents and their lengths, how many ids of its part precede it, and the codes.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.byte_coder import byte_coder
from scanweave.llm.shared import parts, shared_folder, slices

MAGIC = b"DAC1"
BITS = 512
SEGMENT_IDS = 1 << 19
END = 0
CELL = 20


def pack(ids: np.ndarray) -> bytes:
    """The codes of ids (each below 2**32)."""
    left = np.asarray(ids, np.uint32)
    levels = []
    while len(left) or not levels:
        chunk, rest = (left & np.uint32(255)).astype(np.uint8), left >> np.uint32(8)
        on = rest > 0
        counted = np.concatenate([[0], np.cumsum(on)])
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + np.packbits(on, bitorder="little").tobytes() + counted[: len(on) + 1 : BITS].astype("<u8").tobytes())
        left = rest[on]
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads packed ids: all of them, or any one."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", blob, 4)[0]):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunk = np.frombuffer(blob, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(blob, "<u8", n // BITS + 1, at)
            at += ranks.nbytes
            self.levels.append((chunk, bits, ranks))

    def __len__(self):
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BITS
            before = np.unpackbits(bits[block * BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BITS]
            i = int(ranks[block]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        out = self.levels[-1][0].astype(np.uint32)
        for chunk, bits, _ in self.levels[-2::-1]:
            value = chunk.astype(np.uint32)
            value[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = value
        return out


_NAMES = ["part", "seq", "before", "n_ids", "doc_ids", "known", "sizes", "codes"]
_SEGMENTS = "part int, seq int, before long, n_ids long, doc_ids binary, known binary, sizes binary, codes binary"


def _segments(raw, end):
    def run(batches):
        coder, part = byte_coder(raw), TaskContext.get().partitionId()
        seq = before = held = 0
        docs, ids = [], []

        def flush():
            nonlocal seq, before, held, docs, ids
            flat = np.concatenate(ids)
            row = (part, seq, before, len(flat), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs], np.uint8).tobytes(),
                   np.array([len(x) for x in ids], "<i8").tobytes(), pack(flat))
            seq, before, held, docs, ids = seq + 1, before + len(flat), 0, [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _NAMES)

        for rows, texts in slices(batches, limit=12 << 20):
            for doc_id, found in zip(rows.column("doc_id").to_pylist(), coder.encode(texts)):
                docs.append(doc_id)
                ids.append(np.append(found, np.uint32(end)))
                held += len(found) + 1
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()
    return run


def write_ids(documents: DataFrame, vocabulary: bytes, path: str | None = None, end: int = END) -> str:
    """Writes the ids of every document, each closed by the end id, in ascending doc_id order
    (NULL first, ties by text) and returns the path.  NULL and empty texts have the end id alone."""
    spark = documents.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary)
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(raw, end), _SEGMENTS).write.parquet(path)
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments and the number of ids in front of each.  One row per part is summed up,
    at most as many as one stage had tasks."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    sums = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("held"))
    offsets = sums.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("offset"))
    return files.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset", "before")


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in ("start", "doc_ids", "known", "sizes", "codes")}
            ids = Codes(r["codes"]).all().astype("<u4")
            sizes, known = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["known"], np.uint8)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=known == 0), pa.array(r["start"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as
    little-endian 32-bit numbers) of every document, from the files."""
    return segments(spark, path).select("start", "doc_ids", "known", "sizes", "codes").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _look_up(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            codes, start = Codes(batch.column("codes")[i].as_py()), batch.column("start")[i].as_py()
            at = batch.column("at")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([codes[p - start] for p in at], pa.int64())], ["position", "id"])


def ids_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for each distinct position of the whole sequence, by random access."""
    held = segments(spark, path)
    cells = held.select("part", "seq", "start", "n_ids", F.explode(F.expr(f"sequence(shiftright(start, {CELL}), shiftright(start + n_ids - 1, {CELL}))")).alias("cell"))
    wanted = positions.select("position").distinct().withColumn("cell", F.shiftright("position", CELL)).join(cells, "cell").where("position >= start and position < start + n_ids")
    asked = wanted.groupBy("part", "seq", (F.col("position") % 4096).alias("share")).agg(F.collect_list("position").alias("at"))
    return asked.join(held.select("part", "seq", "start", "codes"), ["part", "seq"]).select("start", "codes", "at").mapInArrow(_look_up, "position long, id long")

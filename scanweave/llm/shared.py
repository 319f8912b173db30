"""What the operators have in common: tables, the shared folder, slices of Arrow batches, words."""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
SLICE_ROWS = 1 << 15


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A cluster names it in
    spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/scanweave-shared"


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a lost executor costs no
    more than the tasks it ran, and later steps start from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scanweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """128 bits of doc_id and text, to tell rows apart when doc_ids repeat or are NULL."""
    return F.concat_ws("-", F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1)))


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out.  NULL ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 2


def training_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most per_class labelled rows of each class, none held out,
    picked by a hash of the id.  At most 2 * per_class ids are broadcast."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        rows = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
        picked = rows if picked is None else picked.unionByName(rows)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def slices(batches, column="text", limit=SLICE_BYTES, rows=SLICE_ROWS):
    """Cuts Arrow batches where the text of a slice would pass the limit; NULL texts turn
    empty.  Yields (slice, texts); a slice has one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + limit, "right"))), at + rows, batch.num_rows)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def words_of(texts):
    """Words between blanks (space, tab to carriage return): codes into a dictionary of the
    distinct words, and where each text begins.  Returns (codes, starts, dictionary)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    coded = flat.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(names, "").as_py() if len(names) else -1
    if blank >= 0:
        real = codes != blank
        before = np.concatenate([[0], np.cumsum(real)])
        codes, starts = codes[real], before[starts]
    return codes, starts, names


def word_hashes(names) -> np.ndarray:
    """Keyed 64-bit hash of each distinct word, the same in every process."""
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binaries(values) -> pa.Array:
    return pa.array(values, pa.binary())


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if a count shows at most so many (short) rows, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df

"""Chat formatting at token level.

Every segment of a turn (role, text) is encoded on its own, so no token reaches across a border;
reserved ids beyond the vocabulary are spliced in between.  The loss mask is the prefix sum of
+1 where an assistant's text begins and -1 where it ends.  Control strings inside contents are
escaped reversibly: a bar after '<' and any number of backslashes gets one more backslash.

A conversation comes as rows of bounded length in order, so it may be of any size: turns are
encoded wherever they lie, then sorted by conversation and strung together as a stream.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.byte_coder import byte_coder
from scanweave.llm.shared import parts, settle, slices

START, FINISH = "<|im_start|>", "<|im_end|>"
CHUNK_IDS = 1 << 15
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Afterwards '<|' does not occur."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role takes one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line), flags=re.S)


def reserved(coder):
    """Ids of the turn marks, the first two beyond the vocabulary."""
    return len(coder.bytes), len(coder.bytes) + 1


def _turns(raw):
    """Each row as ids and the place of the text to learn in them."""
    def run(batches):
        coder = byte_coder(raw)
        start, finish = reserved(coder)
        line = coder.whole("\n")
        for rows, texts in slices(batches):
            heads = coder.encode(pa.array([escape_role(r or "") + "\n" for r in rows.column("role").to_pylist()], pa.string()))
            bodies = coder.encode(pa.array([escape(t) for t in texts.to_pylist()], pa.string()))
            ids, delta = [], []
            for role, head, body in zip(rows.column("role").to_pylist(), heads, bodies):
                ids.append(np.concatenate([[start], head, body, [finish], line]).astype(np.int32))
                step = np.zeros(len(ids[-1]) + 1, np.int8)
                if role == "assistant":
                    step[1 + len(head)] += 1
                    step[1 + len(head) + len(body)] -= 1
                delta.append(step[:-1])
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("conv_id", "turn", "role", "text")] + [pa.array([x.tobytes() for x in v], pa.binary()) for v in (ids, delta)],
                ["conv_id", "turn", "role", "text", "ids", "delta"])
    return run


def _string(batches):
    """Sorted turns of whole conversations to rows of CHUNK_IDS ids with their mask."""
    key, seq, ids, delta, depth = (), 0, [], [], 0

    def flush(last):
        nonlocal seq, ids, delta, depth
        flat, steps = np.concatenate(ids), np.concatenate(delta)
        while len(flat) >= CHUNK_IDS or (last and len(flat)):
            take = min(CHUNK_IDS, len(flat))
            mask = depth + np.cumsum(steps[:take])
            depth = int(mask[-1])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([seq], pa.int32()), pa.array([flat[:take].tolist()], pa.list_(pa.int32())),
                                              pa.array([(mask > 0).tolist()], pa.list_(pa.bool_()))], ["conv_id", "seq", "ids", "mask"])
            flat, steps, seq = flat[take:], steps[take:], seq + 1
        ids, delta = [flat], [steps]

    held = 0
    for batch in batches:
        for c, i, d in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("delta")):
            if (c,) != key:
                if key:
                    yield from flush(True)
                key, seq, ids, delta, depth, held = (c,), 0, [], [], 0, 0
            ids.append(np.frombuffer(i.as_py(), np.int32))
            delta.append(np.frombuffer(d.as_py(), np.int8))
            held += len(ids[-1])
            if held >= CHUNK_IDS:
                yield from flush(False)
                held = len(ids[0])
    if key:
        yield from flush(True)


def format_conversations(conversations: DataFrame, vocabulary: bytes) -> DataFrame:
    """(conv_id, seq, ids, mask): the conversations as ids and loss mask, in rows of at most
    CHUNK_IDS ids, seq giving their order.

    Turns go by turn number (NULL first), then role and text, so repeated rows are turns of
    their own.  A NULL text or role is empty; rows without conv_id form one conversation.  Only
    the role 'assistant' is learned.  Other columns are not read; no rows give no rows."""
    spark = conversations.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary)
    n = parts(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = rows.mapInArrow(_turns(raw), "conv_id long, turn long, role string, text string, ids binary, delta binary")
    return turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "delta").mapInArrow(
        _string, "conv_id long, seq int, ids array<int>, mask array<boolean>")


class _Reader:
    """Digests of one conversation, fed with its ids in order."""

    def __init__(self, coder):
        self.coder, (self.start, self.finish) = coder, reserved(coder)
        self.turns, self.length, self.learned = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.body, self.masked = [], []

    def feed(self, ids, mask):
        marks = np.flatnonzero((ids == self.start) | (ids == self.finish))
        at = 0
        for m in [*marks.tolist(), len(ids)]:
            if m > at:
                self.body.append(ids[at:m])
                self.masked.append(mask[at:m])
            if m < len(ids):
                self.close(bool(ids[m] == self.finish))
            at = m + 1

    def text(self):
        raw = self.coder.decode(np.concatenate(self.body)) if self.body else b""
        return raw.decode()

    def close(self, ends_turn):
        text = self.text()
        self.length += len(text) + len(FINISH if ends_turn else START)
        if ends_turn:
            role, _, content = text.partition("\n")
            self.turns += 1
            self.all.update(f"{unescape_role(role)}\n{unescape(content)}\n".encode())
            ids, mask = np.concatenate(self.body), np.concatenate(self.masked)
            if mask.any():
                learned = unescape(self.coder.decode(ids[mask]).decode())
                self.learned += len(learned)
                self.loss.update(learned.encode())
        self.body, self.masked = [], []

    def end(self):
        self.length += len(self.text())
        return self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.length


_SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(raw):
    def run(batches):
        coder = byte_coder(raw)
        names, key, reader, done = [x.split(" ")[0] for x in _SUMMARY.split(", ")], (), None, []

        def out(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for c, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                if (c,) != key:
                    if key:
                        done.append((*key, *reader.end()))
                    key, reader = (c,), _Reader(coder)
                reader.feed(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False))
                if len(done) >= 1000:
                    yield out(done)
                    done = []
        if key:
            done.append((*key, *reader.end()))
        if done:
            yield out(done)
    return run


def read_conversations(formatted: DataFrame, vocabulary: bytes) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from
    ids and masks alone."""
    spark = formatted.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary)
    ordered = formatted.select("conv_id", "seq", "ids", "mask").repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_read(raw), _SUMMARY)


def formatted_and_read(conversations: DataFrame, vocabulary: bytes) -> DataFrame:
    return read_conversations(settle(format_conversations(conversations, vocabulary)), vocabulary)

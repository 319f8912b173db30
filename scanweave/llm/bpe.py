"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (counted over all documents, the most frequent of them kept)
are encoded once and compiled into an acyclic automaton with shared prefixes and suffixes.
Counts on its edges number the words, the number leads to the ids.  The automaton is a handful
of flat arrays, sent once and memory-mapped by each worker.  Words outside it are merged by the
vocabulary's ranks, so every result is exact.

The vocabulary is a tokenizer file with word ends: composed, lower-cased, white space dropped.
"""

import heapq
import json
import mmap
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from scanweave.llm.shared import settle, slices, words_of

LEXICON_WORDS = 1 << 16
MEMO = 200_000
WORD_END = "</w>"
_NEVER = 1 << 30

# fixed values of the file format: white space and the pieces a text falls into
_SPACE = r"\x09-\x0D\x85\p{Z}"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+")


def _byte_signs():
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in signs:
            signs[b] = chr(256 + len(signs) - len(plain))
    return signs


_SIGNS = str.maketrans({chr(b): s for b, s in _byte_signs().items()})


class Vocabulary:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.ids = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.signs = {i: s for s, i in (self.ids | self.special).items()}
        rule = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = pre_tokenizers.Split(Regex(rule["pattern"]["Regex"]), rule["behavior"].lower(), invert=rule["invert"])
        self.normalizer = Tokenizer.from_str(raw.decode()).normalizer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, chunk: str):
        """Words of a text without blanks; those that stand for themselves come as ids."""
        if self.cut and "<" in chunk and self.cut.search(chunk):
            out = []
            for part in self.cut.split(chunk):
                out += [self.special[part]] if part in self.special else self.pieces(part)
            return out
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else _PIECES.findall(low)
        if max(chunk) < chr(0x370):
            return _PIECES.findall(unicodedata.normalize("NFC", chunk).lower())
        # beyond Latin, what counts as a letter depends on the Unicode version: the file's own rules decide
        return [p for p, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def merge(self, word: str):
        """Ids of a word: always the pair of lowest rank, the leftmost first."""
        signs = list(word.encode().decode("latin-1").translate(_SIGNS))
        signs[-1] += WORD_END
        ranks, n = self.ranks, len(signs)
        if n > 32:
            signs = self._merge_long(signs)
        else:
            order = [ranks.get(p, _NEVER) for p in zip(signs, signs[1:])]
            while order and (best := min(order)) != _NEVER:
                at = order.index(best)
                one = signs[at] + signs[at + 1]
                signs[at : at + 2] = [one]
                del order[at]
                if at < len(order):
                    order[at] = ranks.get((one, signs[at + 1]), _NEVER)
                if at:
                    order[at - 1] = ranks.get((signs[at - 1], one), _NEVER)
        return [self.ids[s] for s in signs]

    def _merge_long(self, signs):
        ranks, n = self.ranks, len(signs)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, i, signs[i], signs[i + 1]) for i in range(n - 1) if (r := ranks.get((signs[i], signs[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            _, i, a, b = heapq.heappop(todo)
            j = after[i]
            if signs[i] != a or j >= n or signs[j] != b:
                continue
            signs[i], signs[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := ranks.get((signs[left], signs[after[left]]))) is not None:
                    heapq.heappush(todo, (r, left, signs[left], signs[after[left]]))
        return [s for s in signs if s is not None]


def compile_lexicon(entries: dict) -> bytes:
    """Words and their ids as a minimal acyclic transducer, in flat arrays."""
    register, path, last = {}, [{}], b""
    final = [False]
    nodes, finals = [], []

    def freeze(depth):
        while len(path) > depth:
            edges, end = path.pop(), final.pop()
            shape = (end, tuple(edges.items()))
            node = register.get(shape)
            if node is None:
                node = register[shape] = len(nodes)
                nodes.append(edges)
                finals.append(end)
            if path:
                path[-1][last[len(path) - 1]] = node
        return node

    ordered = sorted((w.encode(), ids) for w, ids in entries.items())
    for word, _ in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        if len(path) > same + 1:
            freeze(same + 1)
        for _ in word[same:]:
            path.append({})
            final.append(False)
        final[-1] = True
        last = word
    root = freeze(0)
    below = [0] * len(nodes)
    keys, targets, skips = [], [], []
    for i, edges in enumerate(nodes):  # a node's targets are numbered before it
        passed = int(finals[i])
        for byte, node in edges.items():
            keys.append(i << 8 | byte)
            targets.append(node)
            skips.append(passed)
            passed += below[node]
        below[i] = passed
    offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in ordered])])
    arrays = [np.array([root]), np.array(keys), np.array(targets), np.array(skips), np.array(finals), offsets, np.array([x for _, ids in ordered for x in ids])]
    arrays = [np.asarray(a, np.int64) for a in arrays]
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled transducer, memory-mapped from a file without a name."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        all_ = np.frombuffer(self.map, np.int64)
        at, found = 1 + int(all_[0]), []
        for size in all_[1:at].tolist():
            found.append(all_[at : at + size])
            at += size
        self.root, self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = found

    def numbers(self, words):
        """Number of each word, -1 where the lexicon lacks it.  All words walk together, a
        byte at a time."""
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        if not len(self.keys) or not len(raw):
            return np.full(len(raw), -1)
        text, start = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(length)])[:-1]
        node, number = np.full(len(raw), int(self.root[0])), np.zeros(len(raw), np.int64)
        alive = np.flatnonzero(length > 0)
        out = np.full(len(raw), -1)
        step = 0
        while len(alive):
            key = node[alive] << 8 | text[start[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            alive, edge = alive[there], edge[there]
            node[alive] = self.targets[edge]
            number[alive] += self.skips[edge]
            step += 1
            done = length[alive] == step
            ended = alive[done]
            good = ended[self.finals[node[ended]] == 1]
            out[good] = number[good]
            alive = alive[~done]
        return out

    def ids_of(self, number):
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


class Coder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.memo = vocabulary, lexicon, {}
        size = max(vocabulary.signs) + 1
        self.signs = [vocabulary.signs.get(i, "") for i in range(size)]

    def chunks(self, names):
        """Ids of texts without blanks, as packed 32-bit numbers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = [c for c in names if c not in memo]
        cut = [self.vocabulary.pieces(c) for c in new]
        words = list(dict.fromkeys(p for ps in cut for p in ps if isinstance(p, str)))
        packed = {}
        for w, k in zip(words, self.lexicon.numbers(words).tolist()):
            packed[w] = np.asarray(self.lexicon.ids_of(k) if k >= 0 else self.vocabulary.merge(w), np.int32).tobytes()
        for c, ps in zip(new, cut):
            memo[c] = packed[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join(
                packed[p] if isinstance(p, str) else np.int32(p).tobytes() for p in ps)
        return [memo[c] for c in names]

    def encode(self, texts):
        """Flat ids of many texts, and where each begins."""
        codes, starts, names = words_of(texts)
        packed = self.chunks(names.to_pylist())
        size = np.array([len(p) // 4 for p in packed], np.int64)
        flat, head = np.frombuffer(b"".join(packed), np.int32), np.concatenate([[0], np.cumsum(size)])[:-1]
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(head[codes] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[starts]

    def decode(self, ids):
        return " ".join(map(self.signs.__getitem__, ids.tolist()))


_READY = {}


def _coder(raw, blob) -> Coder:
    """One per worker and pair of broadcasts."""
    key = (raw.id if hasattr(raw, "id") else id(raw), hash(raw.value), hash(blob.value) if blob else 0)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Coder(Vocabulary(raw.value), Lexicon(blob.value if blob else compile_lexicon({"a": []})))
    return _READY[key]


def _count(raw):
    def run(batches):
        vocabulary = Vocabulary(raw.value)
        for _, texts in slices(batches):
            codes, _, names = words_of(texts)
            times = np.bincount(codes, minlength=len(names)).tolist() if len(codes) else []
            total = {}
            for chunk, k in zip(names.to_pylist(), times):
                for p in vocabulary.pieces(chunk):
                    if isinstance(p, str):
                        total[p] = total.get(p, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
    return run


def word_counts(documents: DataFrame, vocabulary: bytes) -> DataFrame:
    """(word, n) over all documents; each slice of rows counts its own words first."""
    raw = documents.sparkSession.sparkContext.broadcast(vocabulary)
    return documents.select("text").mapInArrow(_count(raw), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(documents: DataFrame, vocabulary: bytes, words: int = LEXICON_WORDS) -> bytes:
    """The transducer of the most frequent words.  Words of about equal count enter together as
    long as there is room; at most so many reach the driver, whatever the number of tasks.
    The lexicon only decides what is looked up and what is merged, not the ids."""
    counted = settle(word_counts(documents, vocabulary).where(F.length("word") <= 64))
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    cut, taken = None, 0
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        taken += r["count"]
        if taken > words:
            break
        cut = r.level
    top = counted.where(level >= cut).select("word").collect() if cut is not None else []
    v = Vocabulary(vocabulary)
    return compile_lexicon({r.word: v.merge(r.word) for r in top})


def encode(documents: DataFrame, vocabulary: bytes, lexicon: bytes | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row, and the text decoded from the ids if asked
    for.  NULL and blank texts have no ids and decode to the empty text.  Rows are handled
    one by one whatever their doc_id; other columns are not read."""
    spark = documents.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary)
    blob = spark.sparkContext.broadcast(lexicon) if lexicon else None
    names = ["doc_id", "ids"] + ["decoded"] * decoded

    def run(batches):
        coder = _coder(raw, blob)
        for rows, texts in slices(batches):
            ids, starts = coder.encode(texts)
            arrays = [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
            if decoded:
                arrays.append(pa.array([coder.decode(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id and the text that the ids stand for: their signs, joined by blanks.  NULL ids
    give a NULL text."""
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        coder = _coder(raw, None)
        for batch in batches:
            texts = [None if ids is None else coder.decode(np.asarray(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(encoded: DataFrame, *more) -> DataFrame:
    """n_tokens and digests of ids and decoded text, and more columns if asked for."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)

"""Byte-level BPE of many texts with the tokenizers library, each distinct piece once."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from scanweave.llm.bpe import _byte_signs

MEMO = 1 << 20  # a piece and its ids take some 40 bytes


class ByteCoder:
    """A text falls into pieces before every single blank between two other characters;
    the library's own pieces never reach across such a place, so the ids of a text are those
    of its pieces.  Texts with any other white space next to a blank are encoded whole."""

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.first = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        back = {s: b for b, s in _byte_signs().items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for sign, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in sign) if all(c in back for c in sign) else sign.encode()
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if i >= len(self.bytes):
                self.bytes += [b""] * (i + 1 - len(self.bytes))
            self.bytes[i] = token.content.encode()
        self.sizes = np.array([len(b) for b in self.bytes])

    def _after_blank(self, names):
        """Ids of distinct pieces that follow a blank: all of them, and where those of each begin
        and end.  Known pieces are looked up; the others are learnt, and beyond MEMO only these
        here stay known."""
        place = pc.index_in(names, value_set=self.known)
        new = names.filter(pc.is_null(place))
        ids, sizes = self._learn(new)
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = place.is_null().to_numpy(zero_copy_only=False)
        at[fresh] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        head, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(head - ends[:-1], size) + np.arange(ends[-1])]
        if len(self.known) > MEMO:
            self.known, self.ids, self.ends = names, ids, ends
        return ids, ends

    def _learn(self, names):
        """Ids of pieces and how many each has.  Pieces that begin with a blank are one text; the ids
        are cut where their bytes end.  Those that may hold a control token go alone."""
        alone = pc.match_substring(names, "<|").to_numpy(zero_copy_only=False).astype(bool)
        length = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        found, sizes = [], np.zeros(len(names), np.int64)
        usual = np.flatnonzero(~alone)
        parts = {}
        for at in range(0, len(usual), 4096):
            rows = usual[at : at + 4096]
            block = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), names.take(pa.array(rows)))
            ids = self.whole(" " + pc.binary_join(block, " ")[0].as_py())
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(length[rows])) + 1
            sizes[rows] = np.diff(ends, prepend=0)
            found.append(ids[: ends[-1]])
        for i in np.flatnonzero(alone).tolist():
            parts[i] = self.whole(" " + names[i].as_py())
            sizes[i] = len(parts[i])
        flat = np.concatenate(found) if found else np.empty(0, np.uint32)
        if parts:  # each goes to its place among the others
            before = np.concatenate([[0], np.cumsum(np.where(alone, 0, sizes))])
            cuts = np.split(flat, before[list(parts)])
            flat = np.concatenate([cuts[0], *[x for i, cut in zip(parts, cuts[1:]) for x in (parts[i], cut)]])
        return flat, sizes

    def _first(self, piece):
        if len(self.first) > MEMO:
            self.first.clear()
        if piece not in self.first:
            self.first[piece] = self.whole(piece)
        return self.first[piece]

    def whole(self, text: str) -> np.ndarray:
        # the fast call leaves out the places of the tokens in the text, which nothing here needs
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts) -> list:
        """Ids of each text of an Arrow array."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        bare = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(names)), pc.binary_length(names))
        odd = ~pc.and_(bare, pc.greater(pc.binary_length(names), 0)).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        irregular = np.add.reduceat(odd[codes], starts[:-1]) > 0 if len(codes) else np.zeros(len(sizes), bool)
        usual = np.repeat(~irregular, sizes)
        usual[starts[:-1]] = False
        used = np.zeros(len(names), bool)
        used[codes[usual]] = True
        regular = np.flatnonzero(~irregular)
        ids, ends = self._after_blank(names.filter(pa.array(used)))
        openers = [self._first(p) for p in names.take(pa.array(codes[starts[regular]])).to_pylist()]
        flat = np.concatenate([ids, *openers])
        head = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in openers], dtype=np.int64)])
        size = np.diff(head)
        place = np.zeros(len(names), np.int64)
        place[used] = np.arange(used.sum())
        at = place[codes]
        at[starts[regular]] = used.sum() + np.arange(len(regular))
        each = np.where(np.repeat(~irregular, sizes), size[at], 0) if len(size) else np.zeros(len(codes), np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(head[at] - ends[:-1], each) + np.arange(ends[-1])] if len(size) else np.empty(0, np.uint32)
        cut = ends[starts]
        return [self.whole(texts[i].as_py()) if bad else ids[cut[i] : cut[i + 1]] for i, bad in enumerate(irregular.tolist())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.asarray(ids).tolist()))


_READY = {}


def byte_coder(raw) -> ByteCoder:
    """One per worker; raw is a broadcast of the vocabulary file."""
    if _READY.get("raw") != raw.value:
        _READY.update(raw=raw.value, coder=ByteCoder(raw.value))
    return _READY["coder"]

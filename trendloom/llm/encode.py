"""Fast byte-level BPE encoding of Arrow text columns with the tokenizers library.

A text is cut before each single space that stands between two non-space characters. The byte-level pattern always
ends a pre-token there, so the pieces can be encoded alone. Distinct pieces are encoded once per batch and kept in a
bounded cache. Texts with other white space around a space, pieces outside the Latin blocks and pieces with added
tokens go through ``Tokenizer.encode`` itself. Any other kind of tokenizer is used plainly, text by text.

Defined cases: null and empty texts have no ids; an empty column gives empty arrays; a very long text is encoded whole, in
a slice of its own; repeated texts are encoded each for itself, their pieces once.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trendloom.llm.common import give_back

#: Fixed value: the pre-token pattern of byte-level BPE files (as the tokenizer's documentation states it).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 400_000
SLICE_BYTES = 8 << 20
PUNCTUATION = frozenset(".,;:!?")


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest count on from 256."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


#: The bytes of white space of `str.isspace`; those from 128 on are looked at as characters.
_SPACES = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)


def _spaced(pieces: pa.Array, as_str: list[str]) -> list[np.ndarray]:
    """Whether each piece is empty or starts with white space, and whether it is empty or ends with it."""
    raw = pieces.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    empty = ends[1:] == ends[:-1]
    out = []
    for at, of in ((ends[:-1], 0), (ends[1:] - 1, -1)):
        bad = empty.copy()
        byte = data[at[~empty]]
        bad[~empty] = _SPACES[byte]
        for i in np.flatnonzero(~empty)[byte > 127].tolist():
            bad[i] = as_str[i][of].isspace()
        out.append(bad)
    return out


class DocEncoder:
    """Encodes whole texts; ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab(True).values(), default=-1) + 1)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.fast = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self.fast and not any(" " in a for a in self.added)
        self.split = regex.compile(PRETOKEN).findall
        self.chars = _byte_chars()
        self.not_latin = regex.compile(r"[\u0250-\U0010FFFF]").search
        self.cache: dict[str, bytes] = {}

    @property
    def vocab_size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def _encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _ids(self, p: str) -> bytes:
        # printable ASCII stands for itself, but for the space
        raw = p.replace(" ", self.chars[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.chars)
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(raw)])

    def _pretoken(self, p: str) -> bytes:
        """Ids of one pre-token, as uint32 bytes."""
        ids = self.cache.get(p)
        if ids is None:
            ids = self.cache[p] = self._ids(p)
        return ids

    def _piece(self, piece: str, added: bool) -> bytes:
        if (added and any(a in piece for a in self.added)) or (not piece.isascii() and self.not_latin(piece)):
            return np.array(self._encode(piece), "<u4").tobytes()
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():  # letters are one pre-token, with the space before them
            return self._pretoken(piece)
        if body[-1:] in PUNCTUATION and body[:-1].isalpha():
            return self._pretoken(piece[:-1]) + self._pretoken(body[-1])
        return b"".join([self._pretoken(p) for p in self.split(piece)])

    def _pieces(self, pieces: list[str], added: bool) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                # most are letters, which are one pre-token
                body = p[1:] if p[:1] == " " else p
                ids = cache[p] = self._ids(p) if not added and body.isascii() and body.isalpha() else self._piece(p, added)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if not self.fast:
            each = [self._encode(t) for t in texts.to_pylist()]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(e) for e in each], np.int64)
        lists = pc.split_pattern(texts, " ")
        first = np.asarray(lists.offsets)[:-1].astype(np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        last = np.r_[first[1:], len(index)] - 1
        starts_bad, ends_bad = (bad[index] for bad in _spaced(coded.dictionary, distinct))
        heads = [distinct[i] for i in index[first]]
        starts_bad[first] = False
        ends_bad[first] = [bool(h) and h[-1].isspace() for h in heads]
        ends_bad[last] = False
        odd = np.flatnonzero(np.logical_or.reduceat(starts_bad | ends_bad, first))
        index[first] = len(distinct) + np.arange(len(heads))
        place = np.zeros(len(distinct) + len(heads), np.int64)
        place[index] = 1
        used = np.flatnonzero(place)
        added = any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added)
        ids = self._pieces([" " + distinct[i] if i < len(distinct) else heads[i - len(distinct)] for i in used.tolist()], added)
        place[used] = np.arange(len(used))
        index = place[index]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(size) - size
        n = size[index]
        at = np.cumsum(n) - n
        out = flat[np.repeat(begin[index] - at, n) + np.arange(int(n.sum()))]
        counts = np.add.reduceat(n, first)
        if len(odd):
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = np.array(self._encode(texts[int(i)].as_py()), np.uint32)
                counts[i] = len(parts[i])
            out = np.concatenate(parts) if parts else out
        return out, counts


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Row ranges of about `most` bytes of text each; one long text may stand alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    if not len(size):
        return
    part = (np.cumsum(size) - size) // most
    cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(size)]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(a), int(b)


_encoders: dict[str, DocEncoder] = {}


def end_of_task(most: int = 100_000) -> None:
    """A reused worker keeps its encoders, but not large caches."""
    for e in _encoders.values():
        if len(e.cache) > most:
            e.cache.clear()
    give_back()


def encoder(path: str) -> DocEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = DocEncoder(path)
    return _encoders[path]

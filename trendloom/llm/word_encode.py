"""Fast encoding of Arrow text columns by BPE files with word ends (lower case, white space dropped).

Such a file's pattern never crosses white space and its normaliser works character by character, so a text can be cut at
every space and the different pieces encoded alone, once per batch, and kept in a bounded cache. Pieces beyond the Latin
blocks, or with an added token, go through ``Tokenizer.encode`` itself. A file of another kind is encoded text by text.

Defined cases: null and empty texts have no ids; an empty column gives empty arrays; a very long text is encoded whole;
repeated texts are encoded each for itself, their pieces once.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trendloom.llm.common import give_back

#: Fixed value: the pre-token pattern of these files, as the file itself states it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_PIECES = 400_000


class WordEncoder:
    """Encodes whole texts; ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = [x.get("pattern") for x in pre if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")]
        bytes_ = [x for x in pre if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and pattern == [{"Regex": PRETOKEN}] and len(bytes_) == 1 and len(pre) == 2 and not any(" " in a for a in self.added)
        self.split = regex.compile(PRETOKEN).findall
        # Letters before U+0250 are composed and have one lower case, but for the dotted I. Control characters and odd spaces
        # are left to the library.
        self.odd = regex.compile(r"[\x00-\x08\x0E-\x1F\x7F-\xA0\u0130\u0250-\U0010FFFF]").search
        self.chars = {b: c for b, c in enumerate(self._stand_ins())}
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _stand_ins() -> list[str]:
        """Byte-level BPE writes a byte as a printable character: itself if printable, else the next free one from 256."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def _encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return np.array([t.id for t in self.tok.model.tokenize(piece.lower())], "<u4").tobytes()
        if self.odd(piece) or ("<" in piece and any(a in piece for a in self.added)):
            return np.array(self._encode(piece), "<u4").tobytes()
        low, out = piece.lower(), []
        for p in [low] if low.isalpha() else self.split(low):
            out += [t.id for t in self.tok.model.tokenize(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.chars))]
        return np.array(out, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.cache[piece] = self._piece(piece)
        return ids

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
        coded = lists.flatten().dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        ids = [self._ids(p) for p in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = (np.cumsum(size) - size)[index]
        n = size[index]
        at = np.cumsum(n) - n
        out = flat[np.repeat(begin - at, n) + np.arange(int(n.sum()))]
        return out, np.add.reduceat(n, first - first[0])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def end_of_task(most: int = 100_000) -> None:
    """A reused worker keeps its encoders, but not large caches."""
    for e in _encoders.values():
        if len(e.cache) > most:
            e.cache.clear()
    give_back()

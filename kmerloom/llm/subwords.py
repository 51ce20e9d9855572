"""Subword ids of a public tokenizer, with a bounded cache of pieces.

Byte-level pre-tokenisers never join text across a single white-space
character, but for a space, which opens the next piece. So a text is cut before
every space and line end that has no other white space beside it, equal pieces
are looked up once, and the ids of the text are those of its pieces in order.
Texts that hold a special token's string are encoded whole by the tokenizers
library. Pieces are merged by tiktoken with the vocabulary of the same file,
several times faster; where the file isn't a byte-level BPE whose ids are its
merge ranks, the tokenizers library encodes them too.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa

from .common import PIECE, text_bytes

#: The tokenizer file of the queries, by its name in public_tokenizers.
TOKENIZER = "byte_bpe_50k.json"
#: Pieces a worker remembers at most, twice over, and the longest of them.
CACHE = 250_000
LONG = 64
#: Bytes of text whose pieces are looked up at a time (a longer piece alone).
PART = 1 << 22
#: Bytes that a text may be cut before, and those of white space.
_CUT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[0x0A, 0x20]] = True
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: White space of two and of three bytes in UTF-8.
_BLANK_2 = [0xC285, 0xC2A0]
_BLANK_3 = [int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Fixed value: the pre-tokeniser's pattern of byte-level BPE.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(path: str, special: set[str]):
    """Functions from a text, and from one piece of the pre-tokeniser's, to its ids, or None where the file doesn't fit."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = spec["model"]["merges"]
    first = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
    if [spec["model"]["vocab"].get(t) for t in first] != list(range(256, 256 + len(first))):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    coder = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return coder.encode_ordinary, coder.encode_single_piece


class Encoder:
    """Texts -> the ids of the tokenizer's file, as little-endian uint32."""

    def __init__(self, path: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(path))
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.merge, self.letters = _merger(tokenizer_path(path), {s.decode() for s in self.special}) or (None, None)
        self.new: dict[bytes, bytes] = {}  # pieces and their ids
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        if self.merge is None:
            return self._whole([p.decode(errors="replace") for p in pieces])
        merge, letters = self.merge, self.letters
        # letters after one space at most are one piece of the pre-tokeniser's
        ids = [letters(p) if p.isalpha() or (p[:1] == b" " and p[1:].isalpha()) else merge(p.decode(errors="replace")) for p in pieces]
        raw, to = array("I", chain.from_iterable(ids)).tobytes(), [4 * x for x in accumulate(map(len, ids), initial=0)]
        return [raw[a:b] for a, b in pairwise(to)]

    def _codes(self, pieces: list[bytes], odd: bool) -> list[bytes]:
        """The ids of distinct pieces. odd: some may hold a special token's string."""
        if len(self.new) + len(pieces) > CACHE:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, pieces))
        at = [i for i, x in enumerate(out) if x is None]
        wanted = [pieces[i] for i in at]
        found = list(map(self.old.get, wanted))
        if odd:
            found = [self._whole([p.decode(errors="replace")])[0] if any(s in p for s in self.special) else x for p, x in zip(wanted, found, strict=True)]
        missing = [j for j, x in enumerate(found) if x is None]
        for j, ids in zip(missing, self._encode([wanted[j] for j in missing]), strict=True):
            found[j] = ids
        for i, ids in zip(at, found, strict=True):
            out[i] = ids
        self.new.update(zip(wanted, found, strict=True))
        for p in wanted:
            if len(p) > LONG:
                del self.new[p]
        return out

    def _starts(self, data: np.ndarray, off: np.ndarray, odd: bool) -> np.ndarray:
        """Where pieces begin: texts that aren't empty, and white space that may be cut at, but in texts with a special token's string."""
        cut = [off[:-1][np.diff(off) > 0]]
        for at in range(0, len(data), PART):
            i = np.flatnonzero(_CUT[data[at : at + PART]]) + at
            i = i[(i > 0) & (i < len(data) - 1)]
            i = i[~(_BLANK[data[i - 1]] | _BLANK[data[i + 1]])]
            for far, near in ((-3, -1), (1, 3)):  # characters of several bytes before and after
                wide = data[i + (-1 if far < 0 else 1)] >= 0x80
                if wide.any():
                    j = i[wide]
                    x, y, z = (data[np.clip(j + k, 0, len(data) - 1)].astype(np.int64) for k in range(far, near + 1))
                    two = (y << 8 | z) if far < 0 else (x << 8 | y)
                    keep = np.ones(len(i), bool)
                    keep[wide] = ~(np.isin(two, _BLANK_2) | np.isin(x << 16 | y << 8 | z, _BLANK_3))
                    i = i[keep]
            cut.append(i)
        start = np.sort(np.concatenate(cut))
        start = start[np.append(True, start[1:] != start[:-1])] if len(start) else start
        if odd:
            raw = data.tobytes()
            bad = np.array([any(s in raw[a:b] for s in self.special) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            text = np.searchsorted(off, start, "right") - 1
            start = start[~bad[text] | (start == off[text])]
        return start

    def arrays(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; null is empty.

        Equal pieces of some PART bytes are looked up once.
        """
        data, off = text_bytes(col)
        view = memoryview(data)
        odd = any(_holds(view, s) for s in self.special)
        start = self._starts(data, off, odd)
        ids, sizes, lo = [], [], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + PART, "right")) - 1) if len(data) - start[lo] > PART else len(start)
            end = int(start[hi]) if hi < len(start) else len(data)
            edges = np.append(start[lo:hi], end) - start[lo]
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[start[lo] : end])]).dictionary_encode()
            codes = self._codes(found.dictionary.to_pylist(), odd)
            size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            flat, first = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(size) - size
            which = found.indices.to_numpy()
            n = size[which]
            shift = first[which] - (np.cumsum(n) - n)
            ids.append(flat[np.repeat(shift, n) + np.arange(int(n.sum()))])
            sizes.append(n)
            lo = hi
        total = np.concatenate([[0], *sizes]).cumsum() if sizes else np.zeros(1, np.int64)
        at = total[np.searchsorted(start, off)]
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.diff(at)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, n = self.arrays(pa.array(texts, pa.large_string()))
        raw, to = ids.tobytes(), (4 * np.cumsum(n)).tolist()
        return [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


def _holds(data: memoryview, what: bytes) -> bool:
    """Whether bytes hold others; looked for part by part."""
    step = PIECE
    return any(what in bytes(data[at : at + step + len(what) - 1]) for at in range(0, len(data), step))


_encoders: dict[str, Encoder] = {}


def shared_encoder(path: str = TOKENIZER) -> Encoder:
    """One encoder a worker process, whose cache outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Words, their hashes and their windows, over whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Multipliers of the splitmix64 finaliser, odd bases of the polynomials.
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: [\x20\x09-\x0D]
BLANKS = separators(b" \t\n\x0b\x0c\r")

_byte_codes = mix(np.arange(1, 257, dtype=U) * U(_BYTE_BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(which: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse; grown with the longest group seen."""
    if len(_powers[which]) < n:
        base = _BYTE_BASE if which == "up" else pow(_BYTE_BASE, -1, 1 << 64)
        steps = np.full(max(n, 2 * len(_powers[which])), U(base))
        steps[0] = U(1)
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def groups(at: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: hash, first and last byte of each, and where each text's words begin."""

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, at: np.ndarray, blanks: np.ndarray = BLANKS) -> None:
        """data: the bytes of these texts only; at: their offsets, from 0."""
        n = len(data)
        self.data = data
        if not n:
            self.hashes, self.starts, self.ends, self.first = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
            return
        inside = ~blanks[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        cut = at[1:] - 1
        after[cut[cut >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, U)
        np.cumsum(_byte_codes[data] * _power("up", n), out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * _power("down", n + 1)[self.starts])
        self.first = np.searchsorted(self.starts, at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, index of the first word, and text of each window of k words; with short, a text of 1 to k - 1 words
        is one window."""
        h, counts = self.hashes, self.counts
        at, doc = starts(self, k)
        out = rolled(self, k)[at]
        if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
            more = np.empty(len(few), U)
            for i, d in enumerate(few):
                x = 0
                for w in h[self.first[d] : self.first[d + 1]].tolist():
                    x = (x * _WORD_BASE + w) & 0xFFFFFFFFFFFFFFFF
                more[i] = x
            out = np.concatenate([out, mix(more ^ self.counts[few].astype(U))])
            at, doc = np.concatenate([at, self.first[few]]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            out, at, doc = out[order], at[order], doc[order]
        return out, at, doc


def batches(texts: pa.Array, blanks: np.ndarray = BLANKS, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Words of the texts, a group at a time: first text, text after the last, words."""
    data, at = buffers(texts)
    for i, j in groups(at, limit):
        yield i, j, Words(data[at[i] : at[j]], at[i : j + 1] - at[i], blanks)


def rolled(words: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on, across ends of texts too."""
    h = words.hashes
    if len(h) < k:
        return np.zeros(0, U)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= U(_WORD_BASE)
        out += h[j : len(h) - k + 1 + j]
    return mix(out ^ U(k))


def starts(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and text, of each window of k words inside one text."""
    n = np.maximum(words.counts - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n), doc


def least(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the leftmost least hash of the width from there on stands."""
    best, place = hashes[at].copy(), at.copy()
    for j in range(1, width):
        here = hashes[at + j]
        less = here < best
        best[less] = here[less]
        place[less] = at[less] + j
    return place

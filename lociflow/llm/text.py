"""Whole Arrow columns of text as numpy arrays: words, their hashes and 5-word shingles, without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once inside a task; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIVE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each, or of one row."""
    lengths = np.diff(buffers(texts)[1])
    total, begin = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased.

    starts, ends: byte positions in `data`; of: each text's range of words, len(texts) + 1; hashes: 64 bits a word.
    """

    def __init__(self, texts: pa.Array):
        raw, offs = buffers(texts)
        n = len(raw)
        self.n_texts, self.data = len(offs) - 1, _LOWER[raw]
        space = _SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = True, space[:-1]
        begin = ~space & (before | edge[:-1])
        after = np.empty(n, dtype=bool)
        if n:
            after[-1], after[:-1] = True, space[1:]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.of = np.searchsorted(self.starts, offs)
        self.space = space

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, then mixed with its length."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        value = _BYTE[self.data]
        value[self.space] = 0
        at = np.arange(len(self.data)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.data)))) if self.starts[0] == 0 else None
        if at is None:
            at = np.arange(len(self.data))
            at[self.starts[0] :] -= np.repeat(self.starts, np.diff(np.append(self.starts, len(self.data))))
            at[: self.starts[0]] = 0
        at[self.space] = 0
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
            value *= power[at]
            return mix(np.add.reduceat(value, self.starts) + lengths.astype(np.uint64) * _FIVE[7])

    def column(self, which: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow string column."""
        starts, lengths = self.starts[which], (self.ends - self.starts)[which]
        offs = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(offs[-1]) - np.repeat(offs[:-1] - starts, lengths)
        data = self.data[take] if len(take) else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] times, then begin[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): every distinct `width`-word shingle of each text, sorted by owner and hash.

    A text of 1 to width-1 words has its whole sequence as its one shingle; a text without words has none.
    """
    h, counts = words.hashes(), words.counts
    with np.errstate(over="ignore"):
        full = np.maximum(counts - width + 1, 0)
        owner = np.repeat(np.arange(words.n_texts), full)
        first = np.repeat(words.of[:-1], full) + np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        got = np.zeros(len(owner), dtype=np.uint64)
        for k in range(width):
            got += h[first + k] * _FIVE[k]
        got = mix(got)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for k in range(width - 1):
                has = counts[short] > k
                extra[has] += h[words.of[short[has]] + k] * _FIVE[k]
            extra = mix(extra + counts[short].astype(np.uint64))
            got, owner = np.concatenate([got, extra]), np.concatenate([owner, short])
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    if len(got):
        keep = np.ones(len(got), dtype=bool)
        keep[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
        got, owner = got[keep], owner[keep]
    return got, owner

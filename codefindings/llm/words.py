"""Words and shingles of many texts at once, as numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word becomes a 64-bit polynomial hash of
its bytes; shingles are hashes over neighbouring word hashes. All of it is done on the byte buffer,
without a Python object per word. Long texts are hashed in pieces, so memory follows the number of
bytes of one slice of documents and the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 2 << 20
PIECE = 1 << 20
LONGEST = 1 << 18
BASE = 0x9E3779B97F4A7C15
STEPS = np.array([0xD6E8FEB86659FD93, 0xA5A3564E25A2B8C5, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD,
                  0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        inverse = pow(BASE, -1, 1 << 64)
        for base in (BASE, inverse):
            steps = np.full(PIECE + LONGEST + 1, base, np.uint64)
            steps[0] = 1
            _tables.append(np.cumprod(steps, dtype=np.uint64))
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text array; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b'')
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``SLICE`` text bytes, or of one row.

    Memory that Arrow keeps for later is given back after each batch: workers outlive their stage.
    """
    _, offsets = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, 'right')) - 1)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words; a document's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starting = word.copy()
    starting[1:] &= ~word[:-1]
    starting[inner] = word[inner]
    ending = word.copy()
    ending[:-1] &= ~word[1:]
    ending[inner - 1] = word[inner - 1]
    return np.flatnonzero(starting), np.flatnonzero(ending) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of document ``i`` are ``hashes[bounds[i]:bounds[i + 1]]``."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every span of bytes, A-Z read as a-z. Spans are in order and do not overlap."""
    hashes = np.empty(len(starts), np.uint64)
    power, inverse = _powers()
    at = 0
    while at < len(starts):
        base = starts[at]
        end = int(np.searchsorted(ends, base + PIECE, 'right'))
        if end <= at:
            if ends[at] - base > LONGEST:
                hashes[at] = xxhash.xxh64_intdigest(LOWER[data[base:ends[at]]].tobytes())
                at += 1
                continue
            end = at + 1
        piece = LOWER[data[base:ends[end - 1]]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[:len(piece)], out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        hashes[at:end] = mixed((sums[e] - sums[s]) * inverse[s])
        for long in np.flatnonzero(e - s > LONGEST):
            hashes[at + long] = xxhash.xxh64_intdigest(LOWER[data[base + s[long]:base + e[long]]].tobytes())
        at = end
    return hashes


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds) of ``width`` words, repeats included; a shorter text is one shingle, no words none."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        rolled[:n - j] += hashes[j:] * STEPS[j]
    rolled = mixed(rolled)
    full = counts >= width
    shingles = np.empty(out[-1], np.uint64)
    doc = np.repeat(np.arange(len(made)), made)
    at = bounds[:-1][doc] + np.arange(out[-1]) - out[:-1][doc]
    shingles[:] = rolled[at]
    for d in np.flatnonzero(~full & (counts > 0)):
        own = hashes[bounds[d]:bounds[d + 1]]
        ending = np.array([len(own)], np.uint64) * STEPS[-1:]
        shingles[out[d]:out[d] + 1] = mixed((own * STEPS[:len(own)]).sum(dtype=np.uint64, keepdims=True) + ending)
    return shingles, out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]

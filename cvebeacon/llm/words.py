"""Words and shingles of texts as 64-bit hashes, in numpy, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

#: Bytes of text that are split at a time; bounds the memory of a task.
CHUNK_BYTES = 4_000_000
#: Words that a worker remembers before it starts anew.
MEMORY = 300_000
#: Bytes of text whose words are hashed in one step by ``codes``.
_BLOCK = 1 << 16
#: Longer words are hashed one by one.
_LONG = 256
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def slices(
    batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0))
    chunk = np.cumsum(sizes) // size
    starts = np.flatnonzero(np.diff(chunk, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def numbered(cells: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each non-empty word, the distinct words, and words per text.

    Python then sees each distinct word of a slice once.
    """
    flat = cells.flatten()
    sizes = np.asarray(pa.compute.list_value_length(cells), np.int64)
    full = np.asarray(pa.compute.binary_length(flat)) > 0
    if not full.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)[full]
        sizes = np.bincount(owner, minlength=len(sizes))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, sizes


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    values = map(xxhash.xxh3_64_intdigest, strings.cast(pa.binary()).to_pylist())
    return np.fromiter(values, np.uint64, len(strings))


def texts_array(texts: list[str | None] | pa.Array) -> pa.Array:
    """The texts as Arrow strings, null as empty."""
    strings = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return pa.compute.fill_null(strings, "")


def word_hashes(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text.

    Words are runs of anything but space and 0x09-0x0D; A-Z count as a-z.
    """
    lower = pa.compute.ascii_lower(texts_array(texts))
    at, distinct, counts = numbered(pa.compute.ascii_split_whitespace(lower))
    return hashes(distinct)[at], counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, equal for A-Z and a-z; powers of an odd number and of its inverse."""
    odd = 0x9E3779B97F4A7C15
    byte = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(odd)))
    byte[65:91] = byte[97:123]
    powers = [np.full(_BLOCK, x, np.uint64) for x in (odd, pow(odd, -1, 1 << 64))]
    for x in powers:
        x[0] = 1
    return byte, *map(np.multiply.accumulate, powers)


_BYTES, _POWERS, _INVERSE = _table()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in turn, and where each begins and the last ends."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; words are as in ``word_hashes``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    border = np.ones(len(data) + 1, bool)
    border[1:-1] = space[:-1]
    border[offsets] = True
    starts = np.flatnonzero(border[:-1] & ~space)
    border[:-1] = space
    border[offsets] = True
    return starts, np.flatnonzero(border[1:] & ~space) + 1


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from sums over its bytes; A-Z count as a-z.

    A byte counts by its place, as a digit does, so running sums over a block of
    text hold the hashes of all its words. Words of over ``_LONG`` bytes, for which
    equal sums could be made on purpose, go through xxhash one by one.
    """
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _LONG)
    for k in long:
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    short = np.flatnonzero(ends - starts <= _LONG) if len(long) else slice(None)
    begin, end = starts[short], ends[short]
    found = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        base = begin[at]
        upto = np.searchsorted(end, base + _BLOCK, "right")
        first, last = begin[at:upto] - base, end[at:upto] - base
        value = _BYTES[data[base : base + last[-1]]]
        value *= _POWERS[: len(value)]
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        found[at:upto] = (sums[last] - sums[first]) * _INVERSE[first]
        at = upto
    out[short] = mix(found)
    return out


def shingles(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their number for each text.

    A text of one to k-1 words has its whole sequence as one shingle, a text
    without words none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    at = starts[owner] + inside
    length = np.minimum(counts, k)[owner]
    value = length.astype(np.uint64)
    for step in range(k):
        live = step < length
        if live.all():
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + flat[at + step])
        else:
            word = flat[np.where(live, at + step, at)]
            value = np.where(live, mix(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    return value, number


def set_id(distinct: np.ndarray) -> bytes:
    """16 bytes that equal sets of hashes share, whatever their order."""
    first = mix(distinct).sum(dtype=np.uint64)
    second = mix(distinct ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return first.tobytes() + second.tobytes()

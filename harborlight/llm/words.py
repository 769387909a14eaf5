"""Split many texts into words at once, as arrays over one byte buffer."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts that are worked on together, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table with True for the bytes in the closed ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Separators of plain words, and of lower-cased words of letters, digits and non-ASCII bytes.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give free memory back to the system: worker processes live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part hold about `size` bytes at most.

    Arrow's buffers come from the system's allocator, which gives large ones back at once.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1])
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class Words:
    """Words of several texts: word i is data[offsets[i]:offsets[i + 1]], one space at its end included.

    Text d has the words bounds[d] to bounds[d + 1].
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            data = LOWER[data]
        sep = separators[data]
        end = sep.copy()
        end[0] = False
        end[1:] &= ~sep[:-1]
        ends = np.flatnonzero(end)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        self.bounds = np.concatenate(([0], np.searchsorted(ends, stops, side="right")))
        keep = ~sep | end
        data = data[keep]
        data[end[keep]] = 32
        self.data = data
        self.offsets = np.concatenate(([0], np.flatnonzero(end[keep]) + 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """An id for each word, and the different words by id, one space at their end included."""
        return encode_words(self.data, self.offsets)

    def document(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def encode_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]
    )
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in values.to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbours; the last n - 1 places have no meaning."""
    out = np.zeros(len(h), np.uint64)
    for j in range(n):
        out[: len(h) - j] = mix(out[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
    return out

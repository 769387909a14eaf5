"""Substring dedup: exact counts of long word windows by super-k-mer partitioning.

A super-k-mer is a run of consecutive windows that share their minimiser, the smallest hash of any
m words inside. All equal windows have the same minimiser, so they meet in the same bucket, where
sorting counts them. A super-k-mer travels as one string of its words. Equal strings of one slice
of documents travel once, so a passage that a third of all documents share reaches its bucket once
per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import parts_for, text_total
from harborlight.llm.words import SPACES, Words, encode_words, gram_hashes, hashes, mix, release, slices, text_bytes

WINDOW, MINIMISER = 35, 4
#: Windows of one super-k-mer at most; a longer run goes on in the next one.
LONGEST = 64
#: Text bytes for each bucket.
BUCKET_BYTES = 6 << 20


def super_kmers(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer."""
    span = k - m + 1
    n = len(words) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    ids, names = words.dictionary()
    low = gram_hashes(hashes(names)[ids], m)
    width = 1
    while width < span:
        step = min(width, span - width)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        width += step
    low = low[:n]
    edge = np.zeros(len(words) + 1, np.int64)
    fits = np.diff(words.bounds) >= k
    np.add.at(edge, words.bounds[:-1][fits], 1)
    np.add.at(edge, words.bounds[1:][fits] - k + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    new[words.bounds[:-1][fits]] = True
    first = np.flatnonzero(new)
    counts = np.add.reduceat(valid.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    pieces = -(-counts // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(first, pieces) + nth * LONGEST
    counts = np.minimum(np.repeat(counts, pieces) - nth * LONGEST, LONGEST)
    return starts, counts, low[starts]


def packed(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    starts, counts, low = super_kmers(words, k, m)
    text = words.data.tobytes()
    a, b = words.offsets[starts].tolist(), words.offsets[starts + counts + k - 1].tolist()
    return starts, counts, low, [text[x:y] for x, y in zip(a, b)]


def digests(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the strings, as two signed numbers each."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def to_buckets(buckets: int, k: int, m: int):
    """Documents to rows (bucket, kmers): the slice's different super-k-mers of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            _, _, low, strings = packed(Words(text_bytes(batch.column("text")), SPACES), k, m)
            times: dict[bytes, int] = {}
            home: dict[bytes, int] = {}
            for s, b in zip(strings, (mix(low) % np.uint64(buckets)).tolist()):
                times[s] = times.get(s, 0) + 1
                home[s] = b
            groups: dict[int, list[bytes]] = {}
            for s, b in home.items():
                groups.setdefault(b, []).append(s)
            rows = []
            for own in groups.values():
                # The strings end in a space each; a line feed marks one that the slice holds twice or more.
                rows.append(press.compress(b"\t".join([s + b"\n" if times[s] > 1 else s for s in own])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(groups), pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "kmers"]
            )

    return run


def equal_windows(ids: np.ndarray, at: np.ndarray, k: int, hashed: np.ndarray) -> np.ndarray:
    """Of windows whose hash some other one has: those that some other one equals word by word."""
    order = np.argsort(hashed, kind="stable")
    at, hashed = at[order], hashed[order]
    same = hashed[1:] == hashed[:-1]
    for j in range(k):
        same &= ids[at[1:] + j] == ids[at[:-1] + j]
    twin = np.zeros(len(at), bool)
    twin[1:] |= same
    twin[:-1] |= same
    runs = np.concatenate(([0], np.flatnonzero(hashed[1:] != hashed[:-1]) + 1, [len(at)]))
    odd = np.flatnonzero((hashed[1:] == hashed[:-1]) & ~same)
    for r in np.unique(np.searchsorted(runs, odd, side="right") - 1).tolist():  # different windows of one hash
        a, b = runs[r], runs[r + 1]
        _, number, times = np.unique(ids[at[a:b, None] + np.arange(k)], axis=0, return_inverse=True, return_counts=True)
        twin[a:b] = times[number.reshape(-1)] > 1
    out = np.zeros(len(at), bool)
    out[order] = twin
    return out


def repeats_of(k: int):
    """All rows of a bucket to rows (h1, h2, repeats): the windows of a super-k-mer that occur elsewhere too.

    `repeats` has one bit per window, first window first.
    """

    def run(bucket: pa.Table) -> pa.Table:
        release()
        unpress = zstandard.ZstdDecompressor()
        times: dict[bytes, int] = {}
        for blob in bucket.column("kmers").to_pylist():
            for s in unpress.decompress(blob).split(b"\t"):
                if s.endswith(b"\n"):
                    s = s[:-1]
                    times[s] = 2
                else:
                    times[s] = times.get(s, 0) + 1
        strings = list(times)
        often = np.fromiter(times.values(), np.int64, len(times)) > 1
        del times
        data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.flatnonzero(data == 32) + 1
        sizes = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        stop = np.searchsorted(ends, sizes, side="right")
        start = np.concatenate(([0], stop[:-1]))
        ids, names = encode_words(data, np.concatenate(([0], ends)).astype(np.int64))
        del data
        windows = stop - start - k + 1
        owner = np.repeat(np.arange(len(strings)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(start, windows)
        # The hash of a window: differences of running sums with powers of an odd number, which has an inverse.
        value = mix(np.arange(1, len(names) + 1, dtype=np.uint64))[ids]
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.full(len(ids), base))
        total = np.concatenate(([np.uint64(0)], np.cumsum(value * power)))
        hashed = (total[at + k] - total[at]) * np.cumprod(np.full(len(ids), inverse))[at]
        del value, power, total
        ordered = np.sort(hashed)
        seen = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        twin = np.zeros(len(at), bool)
        if len(seen):
            slot = np.minimum(np.searchsorted(seen, hashed), len(seen) - 1)
            some = np.flatnonzero(seen[slot] == hashed)
            twin[some] = equal_windows(ids, at[some], k, hashed[some])
        twin |= often[owner]
        found = np.flatnonzero(np.bincount(owner[twin], minlength=len(strings)))
        first = np.cumsum(windows) - windows
        bits = [np.packbits(twin[first[i] : first[i] + windows[i]]).tobytes() for i in found.tolist()]
        h1, h2 = digests([strings[i] for i in found.tolist()])
        return pa.table({"h1": pa.array(h1), "h2": pa.array(h2), "repeats": pa.array(bits, pa.binary())})

    return run


def occurrences(k: int, m: int):
    """Documents to rows (h1, h2, rid, start): where each super-k-mer stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(text_bytes(batch.column("text")), SPACES)
            starts, _, _, strings = packed(words, k, m)
            h1, h2 = digests(strings)
            owner = np.searchsorted(words.bounds, starts, side="right") - 1
            rid = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(rid[owner]), pa.array((starts - words.bounds[owner]).astype(np.int32))],
                names=["h1", "h2", "rid", "start"],
            )

    return run


def cut(k: int):
    """Documents with their repeats to (doc_id, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(text_bytes(batch.column("text")), SPACES)
            edge = np.zeros(len(words) + 1, np.int64)
            for d, found in enumerate(batch.column("found").to_pylist()):
                for part in found or ():
                    at = words.bounds[d] + part["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(part["repeats"], np.uint8)))
                    edge[at] += 1
                    edge[at + k] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            keep = np.repeat(~gone, np.diff(words.offsets))
            data = words.data[keep].tobytes()
            stops = np.concatenate(([0], np.cumsum(keep)))[words.offsets[words.bounds]].tolist()
            total = np.concatenate(([0], np.cumsum(gone)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(words.bounds)), pa.array(np.diff(total[words.bounds])),
                    pa.array([data[a : max(a, b - 1)] for a, b in zip(stops, stops[1:])], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated(documents: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its remaining words, joined by a space).

    A word goes if a window of `window` words around it also starts elsewhere, in the same or any
    other document; windows are counted over the input. Null and empty texts keep nothing and lose
    nothing; a repeated row counts as another document; rows with the same doc_id and different
    texts are told apart by a hash of both.
    """
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    buckets = parts_for(text_total(documents), BUCKET_BYTES, least=48)
    repeats = (
        rows.select("text")
        .mapInArrow(to_buckets(buckets, window, minimiser), "bucket int, kmers binary")
        .groupBy("bucket")
        .applyInArrow(repeats_of(window), "h1 long, h2 long, repeats binary")
    )
    found = (
        rows.select("text", "rid")
        .mapInArrow(occurrences(window, minimiser), "h1 long, h2 long, rid long, start int")
        .join(repeats, ["h1", "h2"])
        .groupBy(F.col("rid").alias("found_rid"))
        .agg(F.collect_set(F.struct("start", "repeats")).alias("found"))
    )
    joined = rows.join(found, F.col("rid") == F.col("found_rid"), "left").select("doc_id", "text", "found")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut(window), f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Periodic runs of words: stretches that repeat themselves word by word, found on sparse diagonals.

A diagonal is a lag, the distance of a word from an earlier occurrence. It becomes active where a gram of words meets an
earlier occurrence whose left neighbour is another one; its match length then grows until the first difference, and the
diagonal emits a run if it has become long enough. Two things keep that sparse on texts that repeat a word thousands of
times, where every pair of words lies on some diagonal: a run of lag d is at least 2 * d long, so lags from k to 2 * k - 1
start from equal grams of k words, with k doubled from level to level; and match lengths grow by those grams, not by words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.words import SPACES, Words, gram_hashes, mix, slices, text_bytes

#: A run is this long at least, and two periods.
LEAST = 12
#: Words of the shortest grams: a diagonal that emits a run has matched LEAST - lag words, and lag words, so half of LEAST.
GRAM = LEAST // 2
#: Text bytes worked on together, and words copied together.
TOGETHER, COPIED = 2 << 20, 1 << 16

RUNS = "array<struct<start: long, length: long, period: long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: Which word stands at each place, from the rows' doc_ids and the bounds of their words.
Rearrange = Callable[[list, np.ndarray], np.ndarray]


class Diagonals:
    """The words of several texts by id, and the grams that occur twice in a text at least."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        self.n, self.ids = len(ids), np.append(ids, -1)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.repeat(bounds[1:], sizes)
        self.left = np.concatenate(([-1], ids[:-1]))
        self.left[bounds[:-1][sizes > 0]] = -1
        #: For each level, words of a gram, its places, and the gram at each place of the texts (-1: none that occurs twice).
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        places, grams = self._shortest()
        size = GRAM
        while len(places):
            at = np.full(self.n + 1, -1, np.int64)
            at[places] = grams
            self.levels.append((size, places, at))
            places = places[places + size < self.n]
            places = places[at[places + size] >= 0]
            places, grams = self._twice(places, at[places] * (self.n + 1) + at[places + size])
            size *= 2

    def _shortest(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n < GRAM:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = gram_hashes(mix(self.ids[:-1].astype(np.uint64)), GRAM)
        hashes = mix(hashes + self.doc.astype(np.uint64))
        places = np.flatnonzero(np.arange(self.n) + GRAM <= self.end)
        places, _ = self._twice(places, hashes[places])
        # Hashes only choose candidates; the grams are told apart by their words.
        grams, kinds = self.doc[places], int(self.ids.max(initial=0)) + 1
        for j in range(GRAM):
            grams = np.unique(grams * kinds + self.ids[places + j], return_inverse=True)[1]
        return self._twice(places, grams)

    @staticmethod
    def _twice(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, named, counts = np.unique(values, return_inverse=True, return_counts=True)
        keep = counts[named] > 1
        return places[keep], named[keep]

    def starts(self, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) where diagonals of this level's lags become active: equal grams, i before j, unequal left neighbours."""
        size, places, at = self.levels[level]
        nearest, farthest = (1 if level == 0 else size), 2 * size - 1
        grams = at[places]
        order = np.argsort(grams, kind="stable")
        place, base = places[order], grams[order] * (self.n + 1)
        left = self.left[place]
        keys = base + place
        low = np.searchsorted(keys, base + np.maximum(place - farthest, 0))
        top = np.searchsorted(keys, base + place - nearest, side="right") - 1
        # Neighbours in the list with one gram and one left word are passed, or taken, together.
        new = np.ones(len(place), bool)
        new[1:] = (base[1:] != base[:-1]) | (left[1:] != left[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        own = np.flatnonzero(top >= low)
        top = top[own]
        while len(own):
            stop = np.maximum(first[top], low[own])
            differ = left[top] != left[own]
            counts = (top - stop + 1)[differ]
            if len(counts):
                j = np.repeat(place[own[differ]], counts)
                i = np.repeat(stop[differ], counts) + np.arange(len(j)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield place[i], j
            top = stop - 1
            more = top >= low[own]
            own, top = own[more], top[more]

    def matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on. No gram occurs twice above the last level, so each counts once at most."""
        length = np.zeros(len(i), np.int64)
        for size, _, at in reversed(self.levels):
            here = at[i + length]
            length += size * ((here >= 0) & (here == at[j + length]))
        live = np.ones(len(i), bool)
        for _ in range(GRAM - 1):
            live &= (j + length < self.end[j]) & (self.ids[i + length] == self.ids[j + length])
            length += live
        return length

    def runs(self) -> tuple[np.ndarray, ...]:
        """text, start, length and period of all runs, by text, start and period."""
        found = [np.empty((0, 3), np.int64)]
        for level in range(len(self.levels)):
            for i, j in self.starts(level):
                lag, length = j - i, self.matched(i, j)
                long_enough = length >= np.maximum(LEAST - lag, lag)
                found.append(np.column_stack((i, length + lag, lag))[long_enough])
        start, length, lag = np.concatenate(found).T
        # Multiples of a run's smallest period have the same start and length.
        order = np.lexsort((lag, length, start))
        start, length, lag = start[order], length[order], lag[order]
        smallest = np.ones(len(start), bool)
        smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, lag = start[smallest], length[smallest], lag[smallest]
        order = np.lexsort((lag, start))
        return self.doc[start[order]], start[order], length[order], lag[order]


def stuttered(doc_ids: list, bounds: np.ndarray) -> np.ndarray:
    """The given order of words, but in every tenth document, by checksum, the tail repeats its first words.

    With h the CRC-32 of the doc_id as text (a null one is empty), g = h div 10 and n words: if h mod 10 is 0, each word
    i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    source = np.arange(bounds[-1])
    for d, name in enumerate(doc_ids):
        h = zlib.crc32(b"" if name is None else str(name).encode())
        n = int(bounds[d + 1] - bounds[d])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        first = int(bounds[d]) + a
        source[first : bounds[d + 1]] = first + np.arange(n - a) % p
    return source


def _join(words: Words, source: np.ndarray) -> bytes:
    """The words of these places, joined by one space."""
    parts = []
    for a in range(0, len(source), COPIED):
        begins = words.offsets[source[a : a + COPIED]]
        sizes = words.offsets[source[a : a + COPIED] + 1] - begins
        shift = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
        parts.append(words.data[shift + np.arange(len(shift))].tobytes())
    return b"".join(parts)[:-1]


def find_runs(documents: DataFrame, rearrange: Rearrange | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words with smallest period q, max(LEAST, 2 * q) long at least, that no neighbouring word extends
    keeping period q. `collapsed` has the words joined by one space, without those that stand in a run behind its first q
    words. Words are runs of bytes other than ASCII white space. Null, empty and blank texts have no words, no runs and an
    empty text; repeated rows each have a row; an empty table gives none. The pass has no shuffle, and a text is
    worked on in one piece, in memory in proportion to it times the logarithm of its longest repeated gram.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=TOGETHER):
            words = Words(text_bytes(batch.column("text")), SPACES)
            bounds, names = words.bounds, batch.column("doc_id")
            source = np.arange(len(words)) if rearrange is None else rearrange(names.to_pylist(), bounds)
            ids, _ = words.dictionary()
            doc, start, length, period = Diagonals(ids[source], bounds).runs()
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            cuts = np.searchsorted(doc, np.arange(len(names) + 1))
            runs = [{"start": s, "length": n, "period": q} for s, n, q in zip((start - bounds[doc]).tolist(), length.tolist(), period.tolist())]
            collapsed = [_join(words, source[a:z][kept[a:z]]).decode() for a, z in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    names, pa.array(np.diff(bounds)), pa.array([runs[a:z] for a, z in zip(cuts, cuts[1:])], RUN_TYPE),
                    pa.array(collapsed, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"], r["period"])))
    length = -F.col("best.size")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.size div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

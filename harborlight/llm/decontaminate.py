"""Benchmark decontamination: Wu-Manber search for many word patterns at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from harborlight.llm.common import held, share
from harborlight.llm.words import NOT_ALNUM, Words, mix, slices, text_bytes

#: Words of a pattern, and words of the blocks that the shift table knows.
WINDOW, BLOCK = 10, 2
#: Benchmark bytes in one set of tables. A larger benchmark is searched set by set.
BENCHMARK_BYTES = 1 << 20
#: Words that one search cursor looks after.
LANE = 4096
#: Bytes of text searched together. A task's arrays take about six times as much.
SEARCH_BYTES = 2 << 20


class Patterns:
    """Shift and suffix tables over the patterns of one length.

    All patterns have `length` words. A block of up to two words has as its shift how far the
    search may move when it meets the block at a window's end: length - block if no pattern holds
    it, 0 if a pattern ends with it. Blocks at shift 0 lead, by a hash of the whole window, to the patterns
    to compare with.
    """

    def __init__(self, windows: np.ndarray, vocabulary: int):
        self.windows, self.length = windows, windows.shape[1]
        self.block = min(BLOCK, self.length)
        self.base = vocabulary + 1
        self.furthest = self.length - self.block + 1
        keys, shifts = [], []
        for end in range(self.block, self.length + 1):
            keys.append(self.blocks(windows[:, end - self.block : end]))
            shifts.append(np.full(len(windows), self.length - end))
        keys, shifts = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.keys, self.shifts = keys[first], shifts[first]
        suffix = self.fingerprints(windows)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order

    def blocks(self, words: np.ndarray) -> np.ndarray:
        key = words[:, 0]
        for j in range(1, self.block):
            key = key * self.base + words[:, j]
        return key

    def fingerprints(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), np.uint64)
        for j in range(self.length - 1, -1, -1):
            out = mix(out * np.uint64(31) + windows[:, j].astype(np.uint64))
        return out

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in the texts, and the pattern that occurs there."""
        first, last = bounds[:-1] + self.length, bounds[1:]
        lanes = np.maximum(0, -(-(last - first + 1) // LANE))
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first, lanes) + nth * LANE
        stop = np.minimum(at + LANE - 1, np.repeat(last, lanes))
        places = []
        while len(at):
            key = ids[at - self.block]
            for j in range(self.block - 1, 0, -1):
                key = key * self.base + ids[at - j]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            shift = np.where(self.keys[slot] == key, self.shifts[slot], self.furthest)
            places.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at <= stop
            at, stop = at[going], stop[going]
        starts = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64) - self.length
        return self.compare(ids, starts)

    def compare(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        windows = ids[starts[:, None] + np.arange(self.length)]
        found = self.fingerprints(windows)
        low, high = np.searchsorted(self.suffix, found), np.searchsorted(self.suffix, found, side="right")
        each = high - low
        row = np.repeat(np.arange(len(starts)), each)
        pattern = self.order[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)]
        same = (windows[row] == self.windows[pattern]).all(axis=1)
        return starts[row[same]], pattern[same]


class Index:
    """Benchmark items as patterns over their own vocabulary."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        words = Words([text for _, text in items], NOT_ALNUM, lower=True)
        ids, names = words.dictionary()
        self.vocabulary = {w: i + 1 for i, w in enumerate(names.to_pylist())}
        self.items = [None if item is None else str(item) for item, _ in items]
        self.patterns: list[tuple[Patterns, np.ndarray, np.ndarray]] = []
        sizes = np.diff(words.bounds)
        for length in np.unique(np.minimum(sizes, window)):
            if length == 0:
                continue
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            count = sizes[own] - length + 1
            item = np.repeat(own, count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.bounds[own], count)
            every = ids[start[:, None] + np.arange(length)] + 1
            unique, number = np.unique(every, axis=0, return_inverse=True)
            number = number.reshape(-1)
            order = np.argsort(number, kind="stable")
            at = np.searchsorted(number[order], np.arange(len(unique) + 1))
            self.patterns.append((Patterns(unique, len(self.vocabulary)), at, item[order]))

    def search(self, words: Words, coded: tuple[np.ndarray, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A difference array of hit words, and pairs (text, item) of occurrences."""
        ids, names = coded
        known = np.fromiter((self.vocabulary.get(w, 0) for w in names.to_pylist()), np.int64, len(names))
        ids = known[ids]
        edges = np.zeros(len(words) + 1, np.int64)
        texts, items = [], []
        for patterns, at, item in self.patterns:
            starts, pattern = patterns.search(ids, words.bounds)
            edges += np.bincount(starts, minlength=len(edges)) - np.bincount(starts + patterns.length, minlength=len(edges))
            text = np.searchsorted(words.bounds, starts, side="right") - 1
            pair = np.unique(np.stack([text, pattern], 1), axis=0) if len(text) else np.empty((0, 2), np.int64)
            each = at[pair[:, 1] + 1] - at[pair[:, 1]]
            texts.append(np.repeat(pair[:, 0], each))
            items.append(item[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(at[pair[:, 1]], each)])
        empty = np.empty(0, np.int64)
        return edges, np.concatenate([empty, *texts]).astype(np.int64), np.concatenate([empty, *items]).astype(np.int64)


SPANS = "array<struct<start:long,stop:long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, text (if `texts`), n_words, n_hit, items (sorted as strings), hits (word spans).

    Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.
    An item's windows are its runs of `window` words, or all its words if there are fewer; words
    inside any occurrence are hit. The benchmark is read in sets of about BENCHMARK_BYTES, each
    broadcast and searched in a pass over the texts; one pass hands its findings on to the next,
    without a shuffle. Nulls and empty texts have no words; items without words never occur; an
    item without an id hits words but is not listed; rows of one item_id count as one item;
    repeated documents each get their row. An empty benchmark gives rows without hits. `doc_id` is
    handed on as it is and may be of any type.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    parts = max(1, 8 * (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BENCHMARK_BYTES)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    sets, room = [[]], BENCHMARK_BYTES
    for part, size in sorted(items.groupBy("part").agg(F.sum(F.octet_length("text"))).collect()):
        if size > room and sets[-1]:
            sets, room = [*sets, []], BENCHMARK_BYTES
        sets[-1].append(part)
        room -= size
    found = documents.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("hits"),
    )
    for k, chosen in enumerate(sets):
        rows = items.where(F.col("part").isin(chosen)).collect() if chosen else []
        index = Index([(r.item_id, r.text.encode()) for r in rows], window)
        found = _search(found, index, texts=texts or k < len(sets) - 1)
    return found


def _search(found: DataFrame, index: Index, texts: bool) -> DataFrame:
    shared = share(found.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(shared)
        for batch in slices(batches, size=SEARCH_BYTES):
            words = Words(text_bytes(batch.column("text")), NOT_ALNUM, lower=True)
            edges, text, item = index.search(words, words.dictionary())
            names = [set(x) for x in batch.column("items").to_pylist()]
            for d, spans in enumerate(batch.column("hits").to_pylist()):
                for s in spans:
                    edges[words.bounds[d] + s["start"]] += 1
                    edges[words.bounds[d] + s["stop"]] -= 1
            hit = np.cumsum(edges[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(hit)))
            for t, i in zip(text.tolist(), item.tolist()):
                if index.items[i] is not None:
                    names[t].add(index.items[i])
            spans = [_spans(hit[a:b]) if total[b] > total[a] else [] for a, b in zip(words.bounds, words.bounds[1:])]
            columns = {
                "doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": pa.array(np.diff(words.bounds)),
                "n_hit": pa.array(np.diff(total[words.bounds])),
                "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())), "hits": pa.array(spans, SPAN_TYPE),
            }
            if not texts:
                del columns["text"]
            yield pa.RecordBatch.from_pydict(columns)

    given = [StructField(f.name, f.dataType) for f in found.schema if f.name in (("doc_id", "text") if texts else ("doc_id",))]
    found_out = _parse_datatype_string(f"n_words long, n_hit long, items array<string>, hits {SPANS}")
    return found.mapInArrow(run, StructType([*given, *found_out]))


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def digest(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, all their columns kept.

    Null, empty and blank texts hold no words and stay; repeated rows share one fate; an empty benchmark keeps all documents.
    """
    text = next(c for c in documents.columns if c.lower() == "text")
    # The other columns go along as the id, so the documents are read once and neither joined nor moved.
    rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text])
    found = find_contamination(documents.select(rest.alias("doc_id"), F.col(text).alias("text")), benchmark, texts=True)
    kept = [F.col("text" if c == text else f"doc_id.`{c}`").alias(c) for c in documents.columns]
    return found.where("n_hit = 0").select(*kept)

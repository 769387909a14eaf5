"""Token-id files: Simple-8b coded blocks in document order.

A 64-bit word holds a selector in its upper four bits and, in the other 60, as many ids of equal width as fit. Ids of
ESCAPE and more are written as ESCAPE; their values follow in a list of their own. A group of 256 ids begins a new word, and its place in
the block is stored, so that groups are coded and decoded side by side.
"""

from __future__ import annotations

import gc
import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborlight.llm.common import held, share
from harborlight.llm.words import SPACES, encode_words, slices, text_bytes
from harborlight.session import written

#: Ids in a word, and bits of each, by selector. These values are part of the format.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 15) - 1
GROUP = 256
#: The width that each number up to ESCAPE needs.
NEEDED = np.unique(BITS)[np.searchsorted(1 << np.unique(BITS), np.arange(ESCAPE + 1), side="right")].astype(np.int8)
#: Ids of a block, about; a document is never cut.
BLOCK = 1 << 16
#: Blocks decoded together.
BLOCKS_TOGETHER = 16
#: Groups coded side by side, and text bytes encoded together.
TOGETHER, TEXT_BYTES = 8192, 6 << 20
#: Stretches whose ids a worker process remembers.
KNOWN = 300_000

#: A space, letters whose class no Unicode version has changed (ASCII and Latin-1, in UTF-8), and a mark or none.
PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[,.;:!?]?")
#: The characters under which byte-level models know the bytes: printable ones stand for themselves, the others follow at 256.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
BYTE_NAMES = "".join(chr(b if b in _PRINTABLE else next(_OTHERS)) for b in range(256))

#: White space beyond ASCII: a text that holds any is given to the tokenizer whole.
WIDE_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

WIDE_FIRST = sorted({s[:1] for s in WIDE_SPACES})


def pack(groups: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all groups one after the other, and the number of words of each.

    `groups` has a row of GROUP numbers up to ESCAPE for each group, of which the first `sizes` count;
    the others must be 0.
    """
    need = NEEDED[groups]
    best = np.zeros(groups.shape, np.int8)  # selectors that don't fit; all after the first that fits do
    window, width = need.copy(), 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[selector])
        while width < count:
            step = min(width, count - width)
            window[:, : GROUP - step] = np.maximum(window[:, : GROUP - step], window[:, step:])
            width += step
        best += window > BITS[selector]
    padded = np.concatenate((groups, np.zeros((len(groups), int(COUNTS[0])), np.uint16)), axis=1)
    rows, at = np.flatnonzero(sizes > 0), np.zeros(len(groups), np.int64)
    out, owner = [], []
    while len(rows):
        selectors = best[rows, at[rows]]
        words = selectors.astype(np.uint64) << np.uint64(60)
        for s in np.unique(selectors).tolist():
            own = np.flatnonzero(selectors == s)
            bits = int(BITS[s])
            if bits:
                values = padded[rows[own][:, None], at[rows[own]][:, None] + np.arange(COUNTS[s])].astype(np.uint64)
                words[own] |= np.bitwise_or.reduce(values << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(bits)), axis=1)
        out.append(words)
        owner.append(rows)
        at[rows] += COUNTS[selectors]
        rows = rows[at[rows] < sizes[rows]]
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(groups), np.int64)
    out, owner = np.concatenate(out), np.concatenate(owner)
    return out[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(groups))


def unpack(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of some groups; `offsets` says at which word each group begins, `sizes` how many ids it has."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.uint32)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.append(offsets[1:], len(words)) - 1
    sums = np.concatenate(([0], np.cumsum(counts)))
    counts[ends] = sizes - (sums[ends] - sums[offsets])
    begins = np.cumsum(counts) - counts
    out = np.zeros(total, np.uint64)
    for s in np.unique(selectors).tolist():
        bits = int(BITS[s])
        if not bits:
            continue
        own = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[s])):
            live = own[counts[own] > j]
            if not len(live):
                break
            out[begins[live] + j] = words[live] >> np.uint64(bits * j) & mask
    out = out.astype(np.uint32)
    out[out == ESCAPE] = escapes
    return out


def unpack_rows(rows: list[dict]) -> np.ndarray:
    """The ids of some blocks, one after the other."""
    offsets, sizes, before = [], [], 0
    for row in rows:
        own = np.frombuffer(row["offsets"], "<u4").astype(np.int64)
        held = np.full(len(own), GROUP)
        held[-1:] = row["n_ids"] - GROUP * (len(own) - 1)
        offsets.append(own + before)
        sizes.append(held)
        before += len(row["words"]) // 8
    words, escapes = (np.frombuffer(b"".join(row[c] for row in rows), kind) for c, kind in (("words", "<u8"), ("escapes", "<u4")))
    return unpack(words, np.concatenate(offsets), np.concatenate(sizes), escapes)


def block_rows(ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, dict]]:
    """Cut documents into blocks and code them: first document, end, and the block's fields."""
    cuts, total = [0], 0
    for d, n in enumerate(counts.tolist()):
        total += n
        if total >= BLOCK:
            cuts.append(d + 1)
            total = 0
    if cuts[-1] < len(counts):
        cuts.append(len(counts))
    ends = np.concatenate(([0], np.cumsum(counts)))[cuts]
    sizes = np.diff(ends)
    groups = -(-sizes // GROUP)
    held = np.full(int(groups.sum()), GROUP)
    last = np.cumsum(groups) - 1
    held[last[groups > 0]] = (sizes - GROUP * (groups - 1))[groups > 0]
    begins = np.concatenate(([0], np.cumsum(held)))
    parts = []
    for g in range(0, len(held), TOGETHER):
        own = held[g : g + TOGETHER]
        matrix = np.zeros((len(own), GROUP), np.uint16)
        matrix[np.arange(GROUP) < own[:, None]] = np.minimum(ids[begins[g] : begins[g + len(own)]], ESCAPE)
        parts.append(pack(matrix, own))
    words = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)])
    used = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
    where = np.concatenate(([0], np.cumsum(used)))
    first = np.cumsum(groups) - groups
    for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
        g, h = int(first[b]), int(first[b] + groups[b])
        own = ids[ends[b] : ends[b + 1]]
        yield a, z, {
            "n_ids": len(own),
            "counts": counts[a:z].astype("<u4").tobytes(),
            "offsets": (where[g:h] - where[g]).astype("<u4").tobytes(),
            "words": words[where[g] : where[h]].astype("<u8").tobytes(),
            "escapes": own[own >= ESCAPE].astype("<u4").tobytes(),
        }


class PieceEncoder:
    """A tokenizer that encodes each different stretch of a slice once.

    A byte-level tokenizer's pattern never takes white space after other characters into one match, so
    stretches of white space and what follows can be encoded alone.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary, self.tokenizer = vocabulary, None

    def ready(self) -> PieceEncoder:
        """Load the tokenizer where it isn't yet; a worker process does so once."""
        if self.tokenizer is not None:
            return self
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(self.vocabulary)
        self.known, self.numbers = {}, list(range(self.tokenizer.get_vocab_size()))
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normaliser is needed")
        direct = [t.id for t in self.tokenizer.model.tokenize(BYTE_NAMES[32] + "a")]
        if direct != self.tokenizer.encode(" a", add_special_tokens=False).ids:
            raise ValueError("the model's names of bytes are others")
        self.marks = {ord(m): self.tokenizer.encode(m, add_special_tokens=False).ids for m in ",.;:!?"}
        return self

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        every = b"\xff".join(texts)
        wide = [s for s in WIDE_SPACES if s in every] if any(s in every for s in WIDE_FIRST) else []
        if wide:
            whole = [any(s in t for s in wide) for t in texts]
            parts = [self._whole(t) if w else self._stretches([t]) for t, w in zip(texts, whole)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._stretches(texts)

    def _different(self, stretches: list[bytes]) -> list[list[int]]:
        """The ids of different stretches.

        What isn't remembered and is a space and letters, with a mark behind at most, goes to the library's model at
        once, as the pattern would give it: the letters with their space, and the mark.
        """
        tokens, numbers, plain, marks = self.tokenizer.model.tokenize, self.numbers, PLAIN.fullmatch, self.marks
        coded = list(map(self.known.get, stretches))
        missing = [i for i, c in enumerate(coded) if c is None]
        for i in missing:
            s = stretches[i]
            if not plain(s):
                coded[i] = self.tokenizer.encode(s.decode(), add_special_tokens=False).ids
                continue
            name, mark = charmap_decode(s, "strict", BYTE_NAMES)[0], marks.get(s[-1])
            if mark is None:
                coded[i] = [numbers[t.id] for t in tokens(name)]
            else:
                coded[i] = [numbers[t.id] for t in tokens(name[:-1])] + mark
        kept = missing[: KNOWN - len(self.known)]
        if kept:
            self.known.update((stretches[i], coded[i]) for i in kept)
        return coded

    def _whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int64)
        return ids, np.array([len(ids)])

    def _stretches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        space = SPACES[data]
        first = space.copy()
        first[1:] &= ~space[:-1]
        begins = np.cumsum(sizes) - sizes
        first[begins[sizes > 0]] = True
        offsets = np.append(np.flatnonzero(first), len(data))
        words, names = encode_words(data, offsets)
        gc.disable()  # so many lists would set it off again and again; none of them is in a cycle
        coded = self._different(names.to_pylist())
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int64, lengths.sum())
        gc.enable()
        starts = np.cumsum(lengths) - lengths
        each = lengths[words]
        ends = np.cumsum(each)
        at = np.repeat(starts[words] - (ends - each), each)
        at += np.arange(len(at))
        ids = flat[at]
        done = np.concatenate(([0], ends))[np.searchsorted(offsets, np.concatenate(([0], begins + sizes)))]
        return ids, np.diff(done)


BLOCKS = (
    "part int, block int, offset long, n_ids long, doc_ids array<long>, counts binary, offsets binary, words binary, escapes binary"
)


def write_blocks(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The blocks of all documents in ascending doc_id order, written to the shared folder and read back.

    Null texts are empty: they have the end id only. Rows of one doc_id are ordered by text; rows
    without a doc_id come first. Each file holds one range of ids; `part` numbers the ranges,
    `offset` counts the ids before the block in its part.
    """
    with open(tokenizer) as file:
        shared = share(documents.sparkSession, PieceEncoder(file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(shared).ready()
        part, block, offset = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, size=TEXT_BYTES):
            ids, counts = encoder.encode(text_bytes(batch.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            names = batch.column("doc_id").cast(pa.int64()).to_pylist()
            rows = []
            for a, z, fields in block_rows(ids, counts + 1):
                rows.append({"part": part, "block": block, "offset": offset, "doc_ids": names[a:z], **fields})
                block += 1
                offset += fields["n_ids"]
            yield pa.RecordBatch.from_pylist(
                rows,
                pa.schema(
                    [
                        ("part", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("offsets", pa.binary()),
                        ("words", pa.binary()), ("escapes", pa.binary()),
                    ]
                ),
            )

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, BLOCKS), "token-ids")


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document, decoded from the blocks: doc_id, start, n_tokens, ids."""
    totals = blocks.groupBy(F.col("part").alias("own")).agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("own", F.coalesce(before, F.lit(0)).alias("before"))
    # A row per part, and so few: without the hint the blocks are moved before their number is known.
    placed = blocks.join(F.broadcast(starts), F.col("part") == F.col("own")).withColumn("offset", F.col("offset") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCKS_TOGETHER):
                rows = batch.slice(a, BLOCKS_TOGETHER).to_pylist()
                ids = unpack_rows(rows).astype("<u4").tobytes()
                counts = [np.frombuffer(row["counts"], "<u4").astype(np.int64) for row in rows]
                starts = [row["offset"] + np.cumsum(c) - c for row, c in zip(rows, counts)]
                counts = np.concatenate(counts)
                ends = (4 * np.cumsum(counts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for row in rows for d in row["doc_ids"]], pa.int64()), pa.array(np.concatenate(starts)),
                        pa.array(counts), pa.array([ids[x:y] for x, y in zip([0, *ends], ends)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = placed.select("offset", "n_ids", "doc_ids", "counts", "offsets", "words", "escapes")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

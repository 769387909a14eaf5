"""SentencePiece encoding with the original place of every piece, and decoding.

Normalisation takes, again and again, the longest prefix that the model's compiled character map
knows, and notes for each byte it writes where the source stood. A piece of the normalised text is
so projected to bytes of the original. Where a model can't join pieces across a space, equal words of a slice are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import held, share
from harborlight.llm.words import encode_words, slices, text_bytes

SPACE = "▁".encode()
#: Text bytes that are encoded together; ids and spans take many times that.
TOGETHER = 2 << 20


class CharacterMap:
    """The compiled map of a model: a double-array trie over byte strings, and the strings to write instead.

    The blob holds the trie's size in bytes, its 32-bit units, and replacements that end in a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a place, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = self._jump(units[0])
        for length, byte in enumerate(memoryview(text)[at:], 1):
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = length, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    @staticmethod
    def _jump(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Normaliser:
    """Normalises a text and keeps, for each byte it writes and for the end, the byte of the source it comes from."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool):
        self.map = CharacterMap(charsmap)
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        self.space = SPACE if escape else b" "

    def align(self, text: bytes) -> tuple[bytes, list[int]]:
        written, source = bytearray(), []

        def write(piece: bytes, at: int) -> None:
            piece = piece.replace(b" ", self.space)
            written.extend(piece)
            source.extend([at] * len(piece))

        at, after_space = 0, self.remove_extra
        pieces = []
        while at < len(text):
            length, piece = self.step(text, at)
            pieces.append((at, piece))
            at += length
        if self.remove_extra:
            while pieces and not pieces[0][1].strip(b" "):
                pieces.pop(0)
        if not pieces:
            return b"", [len(text)]
        if self.dummy_prefix:
            write(b" ", pieces[0][0])
        for at, piece in pieces:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                write(piece, at)
                after_space = self.remove_extra and piece.endswith(b" ")
        end = len(text)
        if self.remove_extra:
            while written.endswith(self.space):
                del written[-len(self.space) :]
                end = source[len(written)]
                del source[len(written) :]
        return bytes(written), [*source, end]

    def step(self, text: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(text, at)
        if found:
            return found
        first = text[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, text[at : at + size]


class Encoder:
    """A model's library object with what is needed to place pieces."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.normaliser = Normaliser(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        )
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        # Bytes that a piece covers, a space counted as one byte; a byte piece covers one.
        self.width = np.array(
            [
                1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.replace("▁", " ").encode())
                for p in proto.pieces
            ]
        )
        self.bytes = {i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.space = self.library.piece_to_id("▁")
        # Without such pieces no merge goes from one word to the next, so words can be encoded alone.
        self.by_word = (
            proto.trainer_spec.model_type == 2
            and proto.trainer_spec.byte_fallback
            and not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == kinds.USER_DEFINED for p in proto.pieces)
            and not any("▁" in p.piece.lstrip("▁") for p in proto.pieces if p.type == kinds.NORMAL)
        )

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts without the begin and end ids, their number per text, and each id's span in the text."""
        plain = np.array([self.by_word and SPACE not in t for t in texts], bool)
        if plain.all():
            return self._by_word(texts)
        parts = [self._by_word([t]) if p else self._whole(t) for t, p in zip(texts, plain)]
        return tuple(np.concatenate([part[i] for part in parts]) for i in range(4))

    def _by_word(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As the normaliser would write them, but with spaces left as they are: one space goes before each text."""
        data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not len(data):
            return (np.empty(0, np.int64), np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        begins = np.cumsum(sizes) - sizes
        first[begins[sizes > 0]] = True
        offsets = np.append(np.flatnonzero(first), len(data))
        words, names = encode_words(data, offsets)
        coded = self.library.encode([w[1:].decode() for w in names.to_pylist()], num_threads=1)
        coded = [c or [self.space] for c in coded]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int64, lengths.sum())
        starts = np.cumsum(lengths) - lengths
        each = lengths[words]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[words], each)
        ids = flat[place]
        stops = np.cumsum(self.width[ids])
        counts = np.searchsorted(stops, begins + sizes, side="right")
        counts = np.diff(np.concatenate(([0], counts)))
        origin = np.repeat(begins + 1, counts)
        stops = stops - origin
        return ids, counts, np.maximum(0, stops - self.width[ids]), stops

    def _whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One text by the library, placed by the normaliser's alignment."""
        if not text:
            return (np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        pieces = self.library.encode(text.decode(), return_type="proto").pieces
        ids = np.array([p.id for p in pieces], np.int64)
        width = [1 if p.id in self.bytes else len(p.piece.encode()) for p in pieces]
        source = np.array(self.normaliser.align(text)[1], np.int64)
        stops = np.cumsum(width, dtype=np.int64)
        return ids, np.array([len(ids)]), source[stops - width], source[stops]


class LazyEncoder:
    """A model that a worker process loads when it first needs it."""

    def __init__(self, model: bytes):
        self.model, self.encoder = model, None

    def ready(self) -> Encoder:
        if self.encoder is None:
            self.encoder = Encoder(self.model)
        return self.encoder


SCHEMA = "n_tokens long, ids binary, starts binary, stops binary, decoded string"


def encode(documents: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, starts, stops, decoded.

    `ids` are little-endian unsigned 32-bit numbers, begin and end ids included; `starts` and `stops` are the bytes of the
    text that each of them stands for, in the same form (begin and end ids have empty spans).
    `decoded` is the library's decode of the ids. A null or empty text has the two ids only. The
    pass has no shuffle; a repeated row is encoded again; an empty table gives no rows.
    """
    with open(model, "rb") as file:
        shared = share(documents.sparkSession, LazyEncoder(file.read()))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(shared).ready()
        for batch in slices(batches, size=TOGETHER):
            texts = text_bytes(batch.column("text"))
            ids, counts, starts, stops = encoder.encode(texts)
            cuts = np.concatenate(([0], np.cumsum(counts)))[1:-1]
            around = lambda x, a, b: [
                np.concatenate(([a(i)], part, [b(i)])).astype("<u4") for i, part in enumerate(np.split(x, cuts))
            ]
            every = around(ids, lambda i: encoder.bos, lambda i: encoder.eos)
            decoded = [encoder.library.decode(x.tolist()) for x in every]
            last = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts + 2),
                    pa.array([x.tobytes() for x in every], pa.binary()),
                    pa.array([x.tobytes() for x in around(starts, lambda i: 0, lambda i: last[i])], pa.binary()),
                    pa.array([x.tobytes() for x in around(stops, lambda i: 0, lambda i: last[i])], pa.binary()),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "starts", "stops", "decoded"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def digest(encoded: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "stops"), 256).alias("spans_sha256"),
    )

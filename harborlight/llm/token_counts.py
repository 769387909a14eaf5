"""Token counts behind a cache of content digests.

The cache holds a row for each different content and version of a tokenizer: SHA-256 digests and the count. Documents
meet it by digest; only contents that it lacks are encoded, once each, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborlight.llm.common import held, look_up, share
from harborlight.llm.token_files import PieceEncoder
from harborlight.llm.words import slices, text_bytes
from harborlight.session import written

#: Text bytes encoded together.
TOGETHER = 2 << 20
CACHE = "version string, digest binary, n_tokens long"


class Counter:
    """Counts the tokens of texts by one vocabulary file; a worker process loads it when it first needs it.

    `.json` files go to the tokenizers library, `.model` files to sentencepiece. Special strings inside texts are handled
    as the library does by default; none are added.
    """

    def __init__(self, name: str, content: bytes):
        self.kind, self.content, self.count = os.path.splitext(name)[1], content, None
        library = {".json": "tokenizers", ".model": "sentencepiece"}[self.kind]
        #: Counts of another file, or of another release of the library, are never taken for this one's.
        self.version = hashlib.sha256(f"{library} {version(library)} ".encode() + content).hexdigest()

    def ready(self) -> Counter:
        if self.count is None:
            self.count = self._pieces() if self.kind == ".model" else self._pairs()
        return self

    def _pieces(self) -> Callable[[list[bytes]], np.ndarray]:
        model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        return lambda texts: np.array([len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)], np.int64)

    def _pairs(self) -> Callable[[list[bytes]], np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(self.content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            encoder = PieceEncoder(tokenizer.to_str()).ready()
            return lambda texts: encoder.encode(texts)[1]
        return lambda texts: np.array(
            [len(x.ids) for x in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)], np.int64
        )


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; none where nothing was stored yet. Every append has a folder of its own, so appends of several jobs don't meet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(folder)


def normalised(text: str = "text") -> Column:
    """What a count depends on. No rewriting of a text is safe for every tokenizer, so this is the text itself, and null is empty."""
    return F.coalesce(F.col(text), F.lit(""))


def encode_misses(documents: DataFrame, counter: Counter) -> DataFrame:
    """Rows (version, digest, n_tokens) for documents (digest, text)."""
    shared, kind = share(documents.sparkSession, counter), counter.version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held(shared).ready().count
        last = None
        for batch in slices(batches, size=TOGETHER):
            # Repeated rows of one id and text lie side by side after a join by key.
            names = batch.column("digest").to_pylist()
            different = [i for i, (a, b) in enumerate(zip([last, *names], names)) if a != b]
            last, batch = names[-1], batch.take(pa.array(different, pa.int64()))
            if not different:
                continue
            counts = count(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(counts), pa.string()), batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    return documents.select("digest", "text").mapInArrow(run, CACHE)


def count_tokens(documents: DataFrame, vocabulary: str, cache: str) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens.

    `cache` is a folder that all executors reach; it is filled by this call and can be used by later ones. A null text is
    empty: no bytes, no tokens. Repeated rows and copies are encoded once and all counted; rows without a doc_id are
    counted too. An empty table gives no rows. Digests, not texts, are grouped, with one row per content after the
    map side; a text moves only if its content is not in the cache and the list of misses is too long to broadcast.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as file:
        counter = Counter(vocabulary, file.read())
    rows = documents.select(
        "doc_id", normalised().alias("text"), F.unhex(F.sha2(normalised(), 256)).alias("digest"),
        F.octet_length(normalised()).cast("long").alias("n_bytes"),
    )
    # Of the documents of a content, the one with the smallest id is the one to be encoded.
    contents = rows.groupBy("digest").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first"), F.count("*").alias("rows"))
    contents = written(contents, "contents")
    own = F.col("version") == counter.version
    stored = cached(spark, cache).where(own).select("digest")
    misses = contents.join(stored, "digest", "left_anti").select(F.col("digest").alias("miss"), "first")
    texts = rows.join(misses, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first")))
    encode_misses(texts, counter).write.parquet(f"{cache}/{uuid.uuid4().hex}")
    stored = cached(spark, cache).where(own).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = contents.join(stored, "digest").select("digest", "rows", "n_tokens")
    return look_up(rows.select("doc_id", "n_bytes", "digest"), counts, "digest", "n_tokens").select("doc_id", "n_bytes", "n_tokens")


def digest(counted: DataFrame, limit: int) -> DataFrame:
    """The columns that the registered query returns."""
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

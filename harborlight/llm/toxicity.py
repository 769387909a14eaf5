"""Toxicity: class-conditional Kneser-Ney models of word pairs over models of letters, over shared counts.

A word's probability in a class, given the word before it, is that of the pair, less a discount; the rest goes to
the pair's share in both classes together and to the word's letters. Letters are code points, each given the four before it in the
word. In the class models of letters, words count by the number of different words that they follow, so copied passages weigh little.
Each order keeps its counts less a discount and leaves the rest to the next shorter one; below three letters both
classes share one model of all orders up to five, counted over the words of all documents in Spark and joined by key.
The score compares the log-likelihoods of the classes, normalised for the length of the text.
Letters tell toxic stems with unseen endings, pairs tell expressions of ordinary words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.common import crc_remainder, held, parts_for, share
from harborlight.llm.words import NOT_ALNUM, Words, hashes, mix, slices, text_bytes
from harborlight.session import written

#: Labelled documents of each class at most that the class models are fitted on, chosen by a hash of the id.
SAMPLE = 6000
#: Letters of the longest and shortest sequences that are counted by class.
LONGEST, SHORTEST = 5, 3
#: Documents of a class that a pair of words must stand in to have a probability of its own.
LEAST_PAIRS = 2
DISCOUNT = 0.75
#: Log-likelihoods are divided by this power of the number of words.
LENGTH_POWER = 0.75
#: Bytes of different words whose letters ask for shared probabilities together.
LOT_BYTES = 4 << 20


def read_words(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, pa.Array]:
    words = Words(text_bytes(batch.column("text")), NOT_ALNUM, lower=True)
    return words, *words.dictionary()


def sequences(names: pa.Array, longest: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each letter of the words: numbers of the last 1, 2, ... letters up to it, numbers of the same without
    the letter, how many letters there are up to it, and the first place of each word.

    A space stands before and after each word; sequences don't reach beyond the one before, longer ones equal the longest there.
    """
    raw = [x.decode() for x in names.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer((" " + "".join(raw)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.arange(len(data))
    space = np.maximum.accumulate(np.where(data == 32, at, 0))
    room = at[1:] - space[:-1] + 1
    whole = np.zeros(len(data), np.uint64)
    keys, contexts = [], []
    for m in range(1, longest + 1):
        before = np.concatenate(([np.uint64(0)], whole[:-1]))
        longer = mix((before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + data)
        if m == 1:
            keys.append(longer[1:])
            contexts.append(before[1:])
        else:
            keys.append(np.where(room >= m, longer[1:], keys[-1]))
            contexts.append(np.where(room >= m, before[1:], contexts[-1]))
        whole = longer
    return keys, contexts, room, np.cumsum([0, *map(len, raw[:-1])]) if raw else np.empty(0, np.int64)


def runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows by the columns, and where new rows begin in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def before_each(words: Words, ids: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of the one before it; a text's first word follows 0."""
    own = hashes(names).view(np.int64)[ids]
    before = np.concatenate(([0], own[:-1]))
    before[words.bounds[:-1][np.diff(words.bounds) > 0]] = 0
    return own, before


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to (toxic, before, word, name, n): hashes of a word and of the one before it, the word, and the texts with both."""
    for batch in slices(batches):
        words, ids, names = read_words(batch)
        if not len(words):
            continue
        own, before = before_each(words, ids, names)
        text = words.document()
        order, first = runs([before, ids, text])
        own, before, ids, text = (x[order][first] for x in (own, before, ids, text))
        toxic = batch.column("toxic").to_numpy().astype(np.int64)[text]
        order, first = runs([toxic, before, ids])
        some = order[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic[some]), pa.array(before[some]), pa.array(own[some]), names.cast(pa.binary()).take(pa.array(ids[some])),
             pa.array(np.diff(np.append(first, len(order))))],
            names=["toxic", "before", "word", "name", "n"],
        )


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n): how often each word occurs in a slice."""
    for batch in slices(batches):
        _, ids, names = read_words(batch)
        if len(ids):
            yield pa.RecordBatch.from_arrays([names.cast(pa.binary()), pa.array(np.bincount(ids, minlength=len(names)))], names=["word", "n"])


def count_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) to (m, key, context, low, n): sequences of m = 1 to LONGEST letters, without their last and without their first."""
    for batch in slices(batches, "word", 1 << 20):
        keys, before, room, first = sequences(batch.column("word"), LONGEST)
        times = np.repeat(batch.column("n").to_numpy(), np.diff(np.append(first, len(room))))
        for m in range(1, LONGEST + 1):
            real = room >= m
            low = keys[m - 2] if m > 1 else ~keys[0]
            key, context, low, n = keys[m - 1][real], before[m - 1][real], low[real], times[real]
            order, first_ = runs([key])
            some = order[first_]
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), m, np.int32)), *(pa.array(x[some].view(np.int64)) for x in (key, context, low)),
                     pa.array(np.add.reduceat(n[order], first_))],
                    names=["m", "key", "context", "low", "n"],
                )


def count_by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, n0, n1) to (m, key, context, n0, n1): sequences of the orders that are counted by class."""
    for batch in slices(batches, "name", 1 << 20):
        keys, before, room, first = sequences(batch.column("name"), LONGEST)
        sizes = np.diff(np.append(first, len(room)))
        times = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("n0", "n1")]
        for m in range(SHORTEST, LONGEST + 1):
            order, at = runs([keys[m - 1]])
            some = order[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), m)), *(pa.array(x[m - 1][some].view(np.int64)) for x in (keys, before)),
                 *(pa.array(np.add.reduceat(n[order], at)) for n in times)],
                names=["m", "key", "context", "n0", "n1"],
            )


def asked(lot: pa.Table) -> pa.Table:
    """The words of a lot to (lot, key): the different longest sequences up to their letters."""
    keys = [np.unique(sequences(batch.column("word"), LONGEST)[0][-1]) for batch in slices(iter(lot.to_batches()), "word", 1 << 20)]
    every = np.unique(np.concatenate(keys))
    return pa.table({"lot": pa.array(np.full(len(every), lot.column("lot")[0].as_py(), np.int32)), "key": pa.array(every.view(np.int64))})


def shared_model(words: DataFrame) -> DataFrame:
    """(key, p): the probability of the last letter of each sequence given the others, from rows (word, n) of all documents.

    Kneser-Ney's interpolation down to single letters. Each order is joined once with the next shorter one and stored, so that
    Spark knows how long it is; a context has no more sequences than there are different letters.
    """
    counted = (
        words.mapInArrow(count_sequences, "m int, key long, context long, low long, n long")
        .groupBy("m", "key", "context", "low")
        .agg(F.sum("n").alias("n"))
    )
    of_context = Window.partitionBy("context")
    total, types = F.sum("n").over(of_context), F.count("*").over(of_context)
    single = F.col("m") == 1
    orders = written(
        counted.select(
            "m", "key", "low",
            F.when(single, F.col("n") / total).otherwise((F.col("n") - DISCOUNT) / total).alias("own"),
            F.when(single, F.lit(0.0)).otherwise(DISCOUNT * types / total).alias("rest"),
        ),
        "toxicity-orders",
    )
    found = every = written(orders.where(single).select("key", F.col("own").alias("p")), "toxicity-shared")
    for m in range(2, LONGEST + 1):
        shorter = found.select(F.col("key").alias("low"), F.col("p").alias("lower"))
        longer = orders.where(F.col("m") == m).join(shorter, "low")
        found = written(longer.select("key", (F.col("own") + F.col("rest") * F.col("lower")).alias("p")), "toxicity-shared")
        every = every.unionAll(found)
    return every


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))


def lookup(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in a sorted array, and whether it is there."""
    slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return slot, known[slot] == keys


class Model:
    """The class models: counts of letters and of pairs of words, from the sample alone.

    A letter's probability in a class is a + b * p, where p is the shared one; a and b come from the class's orders.
    """

    def __init__(self, counts: pa.Table):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 0.0, -30.0
        self.known, self.own = np.empty(0, np.int64), np.empty(0)
        self.pairs, self.extra, self.firsts, self.rests = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64), np.empty(0)
        order = counts.column("m").to_numpy()
        for m in range(SHORTEST, LONGEST + 1) if len(order) else ():
            seen, context, *n = (counts.column(c).to_numpy()[order == m] for c in ("key", "context", "n0", "n1"))
            seen, context = seen.view(np.uint64), context.view(np.uint64)
            sort = np.argsort(seen)
            seen, n = seen[sort], [x[sort].astype(float) for x in n]
            context, group = np.unique(context[sort], return_inverse=True)
            own, rest = np.zeros((2, len(seen))), np.ones((2, len(context)))
            for k in (0, 1):
                total, types = np.bincount(group, n[k]), np.bincount(group, n[k] > 0)
                some = total >= 1
                rest[k][some] = DISCOUNT * types[some] / total[some]
                own[k] = np.where(some[group], np.maximum(n[k] - DISCOUNT, 0) / np.maximum(total[group], 1), 0.0)
            self.orders.append((seen, own, context, rest))

    def word_ratios(self, lot: pa.Table, shared: pa.Table) -> pa.Table:
        """The words of a lot to (word, ratio), with the shared probabilities (key, p) of all sequences that they asked for."""
        known, p = shared.column("key").to_numpy().view(np.uint64), shared.column("p").to_numpy()
        order = np.argsort(known)
        known, p = known[order], p[order]
        found, ratio = [], []
        for batch in slices(iter(lot.to_batches()), "word", 1 << 20):
            names = batch.column("word")
            keys, before, room, first = sequences(names, LONGEST)
            a, b = np.zeros((2, len(room))), np.ones((2, len(room)))
            for m in range(LONGEST, SHORTEST - 1, -1):
                seen, own, context, rest = self.orders[m - SHORTEST]
                slot, there = lookup(seen, keys[m - 1])
                a += np.where(there, b * own[:, slot], 0.0)
                slot, there = lookup(context, before[m - 1])
                b *= np.where(there, rest[:, slot], 1.0)
            like = np.log(a + b * p[np.searchsorted(known, keys[-1])])
            found.append(hashes(names).view(np.int64))
            ratio.append(np.add.reduceat(like[1] - like[0], first))
        return pa.table({"word": pa.array(np.concatenate(found)), "ratio": pa.array(np.concatenate(ratio))})

    def learn_pairs(self, known: pa.Table, pairs: pa.Table) -> None:
        """Take the words' differences (word, ratio) and the pairs (before, word, n0, n1, total0, total1)."""
        word, ratio = known.column("word").to_numpy(), known.column("ratio").to_numpy()
        order = np.argsort(word)
        self.known, self.own = word[order], ratio[order]
        if not pairs.num_rows or not len(word):
            return
        before, second = pairs.column("before").to_numpy(), pairs.column("word").to_numpy()
        n, total = ([pairs.column(f"{c}{k}").to_numpy().astype(float) for k in (0, 1)] for c in ("n", "total"))
        kept = [np.where(n[k] >= LEAST_PAIRS, n[k] - DISCOUNT, 0.0) / np.maximum(total[k], 1) for k in (0, 1)]
        self.firsts, group = np.unique(before, return_inverse=True)
        rest = [np.maximum(1 - np.bincount(group, kept[k]), 1e-9) for k in (0, 1)]
        self.rests = np.log(rest[1]) - np.log(rest[0])
        both = (n[0] + n[1]) / (total[0] + total[1])
        slot, there = lookup(self.known, second)
        half = np.where(there, self.own[slot], 0.0).clip(-20, 20) / 2
        like = [np.log(kept[k] + rest[k][group] * both * np.exp(half * (2 * k - 1))) for k in (0, 1)]
        keys = pair_keys(before, second)
        order = np.argsort(keys)
        self.pairs, self.extra = keys[order], (like[1] - like[0])[order]

    def sums(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[list[dict[str, int]]]]:
        """For each text its number of words, the difference over all that the model knows, and the other words."""
        words, ids, names = read_words(batch)
        count = np.diff(words.bounds)
        if not len(words):
            return count, np.zeros(len(count)), [[] for _ in count]
        own, before = before_each(words, ids, names)
        value, missing = np.zeros(len(own)), np.ones(len(own), bool)
        if len(self.known):
            slot, there = lookup(self.known, own)
            value, missing = np.where(there, self.own[slot], 0.0), ~there
        if len(self.pairs):
            slot, there = lookup(self.firsts, before)
            value += np.where(there, self.rests[slot], 0.0)
            slot, there = lookup(self.pairs, pair_keys(before, own))
            value[there], missing = self.extra[slot[there]], missing & ~there
        total = np.diff(np.concatenate(([0.0], np.cumsum(value)))[words.bounds])
        others: list[list[dict[str, int]]] = [[] for _ in count]
        at = np.flatnonzero(missing)
        text, own = words.document()[at], own[at]
        order, first = runs([text, own])
        some = order[first]
        for d, w, n in zip(text[some].tolist(), own[some].tolist(), np.diff(np.append(first, len(order))).tolist()):
            others[d].append({"word": w, "n": n})
        return count, total, others

    def calibrate(self, ratios: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression of the label on the ratio, both classes weighing alike."""
        if len(np.unique(toxic)) < 2:
            return
        weight = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
        centre, spread = ratios.mean(), max(ratios.std(), 1e-9)
        x = np.stack([(ratios - centre) / spread, np.ones(len(ratios))], 1)
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (toxic - p)) - 1e-4 * beta
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
            beta += np.linalg.solve(curve, slope)
        self.slope, self.shift = float(max(beta[0], 0.0) / spread), float(beta[1] - max(beta[0], 0.0) * centre / spread)


def chosen(labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled documents of each class: (labelled_id, toxic). Of labels that differ the toxic one holds."""
    rows = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
        .agg(F.max("toxic").cast("long").alias("toxic"))
    )
    order = F.xxhash64("labelled_id", F.lit(10))
    parts = [rows.where(F.col("toxic") == k).orderBy(order, "labelled_id").limit(sample) for k in (0, 1)]
    return parts[0].unionAll(parts[1])


def word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """(word, ratio): for the hash of each word the difference of its letters' log-likelihoods, over the shared model.

    Words lie in lots by a hash. A lot asks for each sequence of its words once, however many of them hold it, so a
    frequent sequence has no more rows than there are lots, and the words' letters are not moved.
    """
    if not model.orders:
        return words.select(F.lit(0).cast("long").alias("word"), F.lit(0.0).alias("ratio")).limit(0)
    sent = share(words.sparkSession, model)

    def run(lot: pa.Table, shared: pa.Table) -> pa.Table:
        return held(sent).word_ratios(lot, shared)

    lots = parts_for(words.agg(F.sum(F.octet_length("word"))).first()[0], LOT_BYTES)
    lot = F.pmod(F.xxhash64("word"), F.lit(lots)).cast("int").alias("lot")
    dealt = words.select(lot, "word").groupBy("lot")
    answers = dealt.applyInArrow(asked, "lot int, key long").join(shared_model(words), "key").select("lot", "key", "p")
    return written(dealt.cogroup(answers.groupBy("lot")).applyInArrow(run, "word long, ratio double"), "toxicity-words")


def ratios(texts: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """Add `ratio` to rows with a text, which goes: the difference of its log-likelihoods, normalised for its length.

    Words that the model doesn't hold are joined by key to their differences.
    """
    sent = share(texts.sparkSession, model)
    kept = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    parts = "words long, total double, others array<struct<word:long,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count, total, others = held(sent).sums(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(count, pa.int64()), pa.array(total),
                 pa.array(others, pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))],
                names=[*kept, "words", "total", "others"],
            )

    rows = texts.mapInArrow(run, f"{kinds}, {parts}").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "toxicity-texts")
    power = F.pow(F.greatest("words", F.lit(1)).cast("double"), F.lit(LENGTH_POWER))
    more = rows.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n").join(words, "word")
    more = more.groupBy("row").agg(F.sum(F.col("n") * F.col("ratio")).alias("more"))
    whole = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.drop("others").join(more, "row", "left").select(*kept, (whole / power).alias("ratio"))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """Class models from a bounded sample of labelled rows, and (word, ratio) for the words of all documents.

    The driver gets the sample's sequences, the hashes of its words and of its pairs that repeat. The shared counts stay in
    Spark and grow with the documents. A fifth of the sample, chosen by another hash, calibrates the score instead of teaching the models.
    """
    spark = documents.sparkSession
    every = [(r.labelled_id, r.toxic) for r in chosen(labels, sample).collect()]
    rows = spark.createDataFrame(every, "labelled_id long, toxic long")
    rows = F.broadcast(rows.withColumn("calibrates", F.pmod(F.xxhash64("labelled_id", F.lit(11)), F.lit(5)) == 0))
    texts = documents.select("doc_id", "text").where("text is not null").join(rows, F.col("doc_id") == F.col("labelled_id"))
    pairs = (
        texts.where("not calibrates")
        .select("text", "toxic")
        .mapInArrow(contexts, "toxic long, before long, word long, name binary, n long")
        .groupBy("before", "word", "name")
        .agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    )
    pairs = written(pairs, "toxicity-pairs")
    own = written(pairs.groupBy("word", "name").agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in (0, 1)]), "toxicity-own")
    by_class = own.select("name", "n0", "n1").mapInArrow(count_by_class, "m long, key long, context long, n0 long, n1 long")
    model = Model(by_class.groupBy("m", "key", "context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    counted = documents.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = word_ratios(written(counted, "toxicity-counts"), model)
    totals = pairs.groupBy("before").agg(*[F.sum(f"n{k}").alias(f"total{k}") for k in (0, 1)])
    strong = pairs.drop("name").where(F.greatest("n0", "n1") >= LEAST_PAIRS).join(totals, "before").toArrow()
    model.learn_pairs(words.join(own.select("word"), "word", "left_semi").toArrow(), strong)
    seen = ratios(texts.where("calibrates").select("text", "toxic"), model, words).toArrow()
    model.calibrate(seen.column("ratio").to_numpy(), seen.column("toxic").to_numpy())
    return model, words


def score(documents: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per document: doc_id, score (0 to 1; higher: more likely toxic).

    Null and empty texts have a ratio of 0; words that the documents of fit() lack are neutral. Repeated rows are
    scored alike; an empty table gives no rows. Without labels of both classes every score is about 0.
    """
    bounded = F.least(F.greatest(F.lit(model.slope) * F.col("ratio") + model.shift, F.lit(-30.0)), F.lit(30.0))
    return ratios(documents.select("doc_id", "text"), model, words).select("doc_id", (1 / (1 + F.exp(-bounded))).alias("score"))


def held_out():
    return crc_remainder("doc_id", 3) == 1


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return score(documents, *fit(documents, labels.where(~held_out()))).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )

"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import crc_remainder, free_name
from harborlight.llm.words import slices
from harborlight.session import written

#: Most frequent n-grams of a profile and of a document that are compared.
RANKS = 400
UNKNOWN = "und"
#: Text bytes whose n-grams are counted together; the counting takes many times that.
TOGETHER = 1 << 20


def letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


class Grams:
    """The n-grams of one to three characters of several texts, counted for each owner.

    Texts are lower-cased; what is no letter parts words. A mark stands before and after each
    word and counts as a character, except alone. Rows are sorted by owner, falling count and key.
    """

    def __init__(self, texts: list[str | None], owners: np.ndarray, letter: np.ndarray):
        lowered = [" " + (t or "").lower() for t in texts]
        codes = np.frombuffer("".join([*lowered, " "]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        is_letter = letter[codes]
        keep = is_letter.copy()
        keep[:-1] |= is_letter[1:]
        keep[-1] = True
        owner = np.append(np.repeat(owners, sizes), 0)[keep]
        codes = np.where(is_letter, codes, 0)[keep]
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        seen[0] = True
        self.alphabet = np.flatnonzero(seen)  # the mark first
        place = np.zeros(0x110000, np.int64)
        place[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        c = place[codes]
        self.base = len(self.alphabet) + 1
        is_mark = c == 1
        # Digits of a key are the characters' places; 0 stands for none.
        one, two = c * self.base**2, c * self.base**2
        two[:-1] += c[1:] * self.base
        three = two.copy()
        three[:-2] += c[2:]
        use_one, use_two, use_three = ~is_mark, np.ones(len(c), bool), ~is_mark
        use_two[:-1] = ~(is_mark[:-1] & is_mark[1:])
        use_two[-1:] = False
        use_three[:] = True
        use_three[:-2] = ~is_mark[1:-1]
        use_three[-2:] = False
        keys = np.concatenate((one[use_one], two[use_two], three[use_three]))
        owner = np.concatenate((owner[use_one], owner[use_two], owner[use_three]))
        self._count(owner, keys)

    def _count(self, owner: np.ndarray, keys: np.ndarray) -> None:
        room = self.base**3
        if room < 1 << 40:
            both = np.sort(owner * room + keys)
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(both)))
            owner, keys = both[first] // room, both[first] % room
        else:
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(keys)))
            owner, keys = owner[first], keys[first]
        order = np.lexsort((keys, -counts, owner))
        self.owner, self.keys, self.counts = owner[order], keys[order], counts[order]

    def text(self, keys: np.ndarray) -> list[str]:
        """The n-grams behind the keys, with _ for the mark."""
        names = ["", "_", *map(chr, self.alphabet[1:].tolist())]
        a, b, c = keys // self.base**2, keys // self.base % self.base, keys % self.base
        return [names[x] + names[y] + names[z] for x, y, z in zip(a.tolist(), b.tolist(), c.tolist())]


def count_grams(letter):
    """Rows (text, lang) to (lang, gram, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=TOGETHER):
            coded = batch.column("lang").dictionary_encode()
            owners = coded.indices.to_numpy().astype(np.int64)
            grams = Grams(batch.column("text").to_pylist(), owners, letter.value)
            names = coded.dictionary.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in grams.owner.tolist()], pa.string()), pa.array(grams.text(grams.keys), pa.string()), pa.array(grams.counts)],
                names=["lang", "gram", "n"],
            )

    return run


def fit_profiles(labelled: DataFrame, ranks: int = RANKS) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, counted over all rows (text, lang); rows without either teach nothing.

    Counts add up per slice before they move. The driver gets `ranks` n-grams for each language.
    """
    letter = labelled.sparkSession.sparkContext.broadcast(letters())
    counts = (
        labelled.where("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(count_grams(letter), "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = written(counts, "grams")
    top = None
    for row in counts.select("lang").distinct().collect():
        own = counts.where(F.col("lang") == row.lang).orderBy(F.desc("n"), "gram").limit(ranks)
        top = own if top is None else top.unionAll(own)
    found: dict[str, list] = {}
    for row in top.collect() if top is not None else []:
        found.setdefault(row.lang, []).append((-row.n, row.gram))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in sorted(found.items())}


def identify(documents: DataFrame, profiles: dict[str, list[str]], ranks: int = RANKS) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    The distance to a language is the sum over the document's most frequent n-grams of how far
    each is out of place in the profile, `ranks` if it isn't there. The nearest language wins, the
    first by name in a tie. The score is the share by which the second nearest is farther. Texts
    that are null or have no letter are 'und' with score 0, as are all texts if no language is known.
    """
    langs = list(profiles)
    names = sorted({g for own in profiles.values() for g in own})
    rank = np.full((len(names) + 1, len(langs)), ranks, np.int64)
    number = {g: i for i, g in enumerate(names)}
    for k, own in enumerate(profiles.values()):
        rank[[number[g] for g in own], k] = np.arange(len(own))
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((letters(), number, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, number, rank = shared.value
        for batch in slices(batches, size=TOGETHER):
            n = batch.num_rows
            grams = Grams(batch.column("text").to_pylist(), np.arange(n), letter)
            first = np.searchsorted(grams.owner, np.arange(n + 1))
            place = np.arange(len(grams.owner)) - first[grams.owner]
            top = place < ranks
            owner, place, keys = grams.owner[top], place[top], grams.keys[top]
            different, inverse = np.unique(keys, return_inverse=True)
            known = np.array([number.get(g, len(number)) for g in grams.text(different)], np.int64)
            best, score = np.full(n, -1), np.zeros(n)
            if len(langs) and len(owner):
                known = known[inverse.reshape(-1)]
                far = np.stack(
                    [np.bincount(owner, np.abs(np.where(rank[known, k] < ranks, rank[known, k] - place, ranks)), n) for k in range(len(langs))], 1
                )
                some = first[1:] > first[:-1]
                best[some] = np.argmin(far[some], axis=1)
                ordered = np.sort(far, axis=1)
                second = ordered[:, 1] if len(langs) > 1 else np.bincount(owner, minlength=n) * float(ranks)
                score = np.where(some & (second > 0), (second - ordered[:, 0]) / np.maximum(second, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([langs[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string()),
                    pa.array(np.clip(score, 0.0, 1.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out():
    return crc_remainder("doc_id", 5) == 0


def learned(documents: DataFrame) -> dict[str, list[str]]:
    """Profiles from the documents that are not held out."""
    return fit_profiles(documents.where(~held_out()))


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    found = identify(documents, learned(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(documents: DataFrame) -> DataFrame:
    """The documents in which a language is recognised, all their columns kept.

    Null, empty and blank texts, and texts without letters, go; repeated rows share one fate; an empty table stays empty.
    """
    key = F.xxhash64("doc_id", "text")
    found = identify(documents.select(key.alias("doc_id"), "text"), learned(documents)).where(F.col("lang_pred") == UNKNOWN)
    gone = free_name(documents, "gone")
    return documents.join(found.select(F.col("doc_id").alias(gone)).distinct(), key == F.col(gone), "left_anti")

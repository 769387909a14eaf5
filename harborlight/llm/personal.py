"""Personal data by weak supervision, in DataFrame functions only.

Four patterns give the base spans. Further spans come from tokens that hold a digit or an at sign: labelers (patterns, a
gazetteer of cue words, the context) vote on each; expectation-maximisation over the counts of vote combinations
estimates how reliable each labeler is; the resulting posteriors train a naive Bayes classifier on the token's form and surroundings,
which decides on the spans that are added.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order. Each pattern takes what the plain one takes from left to right; possessive
#: quantifiers and the look behind only spare it to try again inside a run of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
#: Tokens that may be personal data: runs without ASCII spaces that hold a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: The kind of added spans, and the posterior that adds one.
OTHER, SURE = "other", 0.9
#: Cue words before a token that speak for and against personal data.
FOR = "email|mail|e-mail|phone|tel|telephone|call|mobile|cell|fax|contact|ssn|passport|iban|account|card|dob|born|address|whatsapp|reach"
AGAINST = "password|token|secret|key|version|page|chapter|isbn|figure|table|section|license|copyright|port|line|year|id"
#: Steps of expectation-maximisation, and the share of personal tokens it begins with.
STEPS, PRIOR = 50, 0.2
_BLOCK = 128


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array; summed by blocks, so that long arrays take little more than linear time."""
    blocks = F.when(F.size(lengths) == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), ((F.size(lengths) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
        )
    )
    running = lambda values, start: F.aggregate(
        values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )
    zero = F.lit(0).cast("int")
    totals = running(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda acc, v: acc + v)), zero)
    return F.flatten(
        F.transform(blocks, lambda x, i: F.slice(running(x, F.element_at(totals, i + 1)), F.lit(2), F.size(x)))
    )


SPANS = "array<struct<start:int,stop:int,value:string>>"


def with_matches(frame: DataFrame, name: str, pattern: str, tried: Column) -> DataFrame:
    """Add the column `name`: start, stop (code points) and value of all matches in `text`."""
    vals, gaps, ends = f"_{name}_values", f"_{name}_gaps", f"_{name}_ends"
    frame = frame.withColumn(vals, F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    frame = frame.withColumn(gaps, F.when(F.size(vals) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    lengths = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(vals)), F.col(vals), lambda g, v: F.length(g) + F.length(v))
    frame = frame.withColumn(gaps, lengths).withColumn(ends, prefix_sums(F.col(gaps)))
    spans = F.zip_with(
        F.col(ends), F.col(vals), lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("stop"), v.alias("value"))
    )
    return frame.withColumn(name, spans).drop(vals, gaps, ends)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(backwards, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(backwards, i, F.lit(1)).cast("int") * 2)
            - F.when(F.substring(backwards, i, F.lit(1)) > "4", 9).otherwise(0)
        ),
    )
    return total % 10 == 0


TESTS = {
    "ip": lambda x: x["value"].rlike(rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){{4}}$"),
    "card": lambda x: F.when(F.length(digits_of(x["value"])).between(13, 19), luhn(digits_of(x["value"]))).otherwise(False),
    "phone": lambda x: F.length(digits_of(x["value"])).between(9, 15),
}


def with_base(frame: DataFrame) -> DataFrame:
    """Add a column of spans for each base kind."""
    has_digit = F.col("text").rlike("[0-9]")
    for kind, pattern in PATTERNS.items():
        tried = F.col("text").contains(NEEDS[kind]) if kind in NEEDS else has_digit
        frame = with_matches(frame, kind, pattern, tried)
        if kind in TESTS:
            frame = frame.withColumn(kind, F.filter(kind, TESTS[kind]))
    return frame


#: Labelers: each votes 1 (personal), 0 (not) or 2 (abstains) on a token, given its value and the words before it.
def votes(value: Column, before: Column) -> list[Column]:
    digits = F.length(digits_of(value))
    core = F.regexp_replace(value, r"^[\p{Punct}&&[^+@]]+|[\p{Punct}&&[^@]]+$", "")
    cue = F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1))
    pick = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(2)
    return [
        # Patterns: what the token looks like.
        pick(
            core.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$|^\+?[0-9][0-9().-]{7,18}[0-9]$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
            core.rlike(r"^[0-9]{1,4}$|^[0-9]+(?:st|nd|rd|th|%)$|^[A-Za-z]+=|^[0-9a-f]{16,}$|^https?:"),
        ),
        # Gazetteer: cue words in front.
        pick(cue.rlike(rf"^\W*(?:{FOR})\W*$"), cue.rlike(rf"^\W*(?:{AGAINST})\W*$") | F.lower(value).rlike(rf"^\W*(?:{AGAINST})\W*[=:]")),
        # Context: how much of the token is digits, and what joins it to its surroundings.
        pick(
            (digits >= 9) & ~value.rlike("[A-Za-z]") | value.contains("@"),
            value.rlike("[=#/%*$&]{1,}") & ~value.contains("@") | (digits <= 4) & ~value.contains("@"),
        ),
    ]


def features(value: Column, before: Column) -> list[Column]:
    """What the classifier sees: small numbers of categories each."""
    digits = F.length(digits_of(value))
    shape = (
        F.when(value.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]"), "a").when(value.contains("@"), "b").when(~value.rlike("[^0-9]"), "c")
        .when(~value.rlike("[^0-9.+() -]"), "d").when(value.rlike("[=#/%*$&]"), "e").when(value.rlike("[A-Za-z]"), "f").otherwise("g")
    )
    cue = F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1))
    return [
        shape,
        F.least(digits, F.lit(16)).cast("string"),
        F.least((F.length(value) / 4).cast("int"), F.lit(8)).cast("string"),
        F.when(cue.rlike(rf"^\W*(?:{FOR})\W*$"), "+").when(cue.rlike(rf"^\W*(?:{AGAINST})\W*$"), "-").otherwise(""),
        F.regexp_extract(value, r"^([+(\[\"']?)", 1),
    ]


def with_tokens(frame: DataFrame) -> DataFrame:
    """Add `tokens`: start, stop, votes and features of each candidate."""
    frame = with_matches(frame, "_found", TOKEN, F.col("text").rlike("[0-9@]"))
    described = F.transform(
        "_found",
        lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"),
            F.concat_ws("", *[v.cast("string") for v in votes(x["value"], _before(x["start"]))]).alias("votes"),
            F.array(*features(x["value"], _before(x["start"]))).alias("features"),
        ),
    )
    return frame.withColumn("tokens", described).drop("_found")


def _before(start: Column) -> Column:
    """The 24 characters before a place."""
    return F.substring(F.col("text"), F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))


class Labels:
    """Reliabilities by expectation-maximisation and a classifier trained on the posteriors, from grouped counts."""

    def __init__(self, groups: list[tuple[str, tuple[str, ...], int]]):
        counts: dict[str, int] = {}
        for vote, _, n in groups:
            counts[vote] = counts.get(vote, 0) + n
        self.posterior = self._reliabilities(counts)
        self._train(groups)

    def _reliabilities(self, counts: dict[str, int]) -> dict[str, float]:
        """P(personal) of each combination of votes. Labelers are taken as independent given the truth."""
        size = len(next(iter(counts), ""))
        # says[c][j][v]: how often labeler j says v of tokens of class c; better than chance to begin with.
        says = [[{"1": 0.1, "0": 0.5, "2": 0.4}] * size, [{"1": 0.7, "0": 0.05, "2": 0.25}] * size]
        prior, posterior = PRIOR, {}
        for _ in range(STEPS):
            for vote in counts:
                like = [math.prod(says[c][j][v] for j, v in enumerate(vote)) for c in (0, 1)]
                yes, no = prior * like[1], (1 - prior) * like[0]
                posterior[vote] = yes / (yes + no)
            total = sum(counts.values())
            mass = [sum(n * abs(1 - c - posterior[v]) for v, n in counts.items()) for c in (0, 1)]
            prior = min(max(mass[1] / max(total, 1), 1e-3), 0.999)
            says = [
                [
                    {
                        s: (0.5 + sum(n * abs(1 - c - posterior[v]) for v, n in counts.items() if v[j] == s)) / (1.5 + mass[c])
                        for s in "012"
                    }
                    for j in range(size)
                ]
                for c in (0, 1)
            ]
        return posterior

    def _train(self, groups: list[tuple[str, tuple[str, ...], int]]) -> None:
        width = len(groups[0][1]) if groups else 0
        total = [1.0, 1.0]
        seen: list[dict[str, list[float]]] = [{} for _ in range(width)]
        for vote, values, n in groups:
            for c, share in ((0, 1 - self.posterior[vote]), (1, self.posterior[vote])):
                total[c] += n * share
                for j, value in enumerate(values):
                    seen[j].setdefault(value, [0.5, 0.5])[c] += n * share
        self.bias = math.log(total[1] / total[0])
        self.weights = [{v: math.log(yes / total[1]) - math.log(no / total[0]) for v, (no, yes) in own.items()} for own in seen]

    def accepts(self, values: Column) -> Column:
        """Whether the classifier's posterior for a token with these features is at least SURE."""
        if not self.weights:
            return F.lit(False)
        score = F.lit(self.bias)
        for j, own in enumerate(self.weights):
            table = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
            score = score + F.coalesce(F.element_at(table, F.element_at(values, j + 1)), F.lit(0.0))
        return score >= math.log(SURE / (1 - SURE))


def learn(documents: DataFrame) -> Labels:
    """Labels from all candidate tokens of all documents; they are counted by votes and features before they move."""
    tokens = with_tokens(documents.select(F.coalesce("text", F.lit("")).alias("text")))
    # The outer form: for the plain one, a filter on the array's size would run all patterns twice.
    tokens = tokens.select(F.explode_outer("tokens").alias("t")).where("t is not null")
    counted = tokens.groupBy(F.col("t.votes").alias("v"), F.col("t.features").alias("f")).agg(F.count("*").alias("n"))
    return Labels([(r.v, tuple(r.f), r.n) for r in counted.orderBy("v", "f").collect()])


def with_spans(documents: DataFrame, labels: Labels) -> DataFrame:
    """Add `found`, an array of (kind, start, stop) in the order of kinds and places, to doc columns.

    An added span is a token that the classifier accepts and that no base span touches.
    """
    frame = with_tokens(with_base(documents.withColumn("text", F.coalesce("text", F.lit("")))))
    frame = frame.withColumn("base", F.concat(*[_placed(kind, kind) for kind in PATTERNS]))
    free = F.filter(
        F.filter("tokens", lambda t: labels.accepts(t["features"])),
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    return frame.withColumn("added", _placed(free, OTHER)).withColumn("found", F.concat("base", "added"))


def _placed(spans: Column | str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def find_personal(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base and found (arrays of kind, start, stop).

    Places count code points, stops are exclusive. Null texts are empty and hold nothing; repeated rows are judged alike; kinds
    may overlap each other; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text")
    return with_spans(rows, learn(documents)).select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS], "base", "found"
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in PATTERNS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans")
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each found span replaced by its kind in brackets; n_chars follows. Other columns stay.

    Overlapping spans are replaced together, by the kind that begins first. Null texts stay null.
    """
    key = "_personal_row"
    labels = learn(documents)
    frame = with_spans(documents.select(F.struct("*").alias(key), "text"), labels)
    merged = F.aggregate(
        F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], x["stop"]).alias("at"))).otherwise(
            F.struct(
                F.concat(
                    acc["done"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")
                ).alias("done"),
                x["stop"].alias("at"),
            )
        ),
    )
    frame = frame.withColumn("_merged", merged)
    text = F.when(F.col(f"{key}.text").isNull(), None).otherwise(
        F.concat("_merged.done", F.substring("text", F.col("_merged.at") + 1, F.length("text")))
    )
    frame = frame.withColumn("_text", text)
    columns = [
        F.col("_text").alias(c) if c == "text" else F.coalesce(F.length("_text").cast("long"), F.col(f"{key}.{c}")).alias(c) if c == "n_chars" else F.col(f"{key}.`{c}`").alias(c)
        for c in documents.columns
    ]
    return frame.select(*columns)

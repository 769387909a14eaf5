"""Token counts, conversation repair and periodic runs against brute-force versions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborlight.llm import conversations, periodic, queries, token_counts
from harborlight.llm.common import look_up

SPACES = r"\x20\x09-\x0D"
PAIRS, WORD_PAIRS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- token counts

TEXTS = [
    None, "", " ", "\n\n", "one", "One ", "a <|endoftext|> b<|endoftext|>", "x" * 30_000, "the end. " * 4_000, "nbsp  here   wide　x",
    "日本語 テスト é😀", "tab\there  two   three \n\n lines\n", "same text", "same text", "same text ", "<s> </s> <unk> ▁piece", "\x00\x1c\x85",
]
DOCS = "doc_id long, text string, digest string, miss string, first long, rows long, n_tokens long, version string, _hot string"


@pytest.fixture(scope="module")
def token_docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "one"), (4, "one"), (4, "another"), (None, "one"), (None, None), (None, "same text")]
    return spark.createDataFrame([(i, t, "a", "b", 1, 2, 3, "v", "h") for i, t in rows], DOCS).repartition(5)


def library(name):
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=name)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(name)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", [PAIRS, WORD_PAIRS, PIECES])
def test_counts_equal_the_library(spark, token_docs, tmp_path, name):
    count = library(name)
    want = Counter((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in token_docs.collect())
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert Counter(map(tuple, token_counts.count_tokens(token_docs, name, cache).collect())) == want
    different = len({r.text or "" for r in token_docs.collect()})
    stored = token_counts.cached(spark, cache)
    assert stored.select("digest").distinct().count() == different
    assert stored.count() == different, "every content is encoded once"


def test_only_misses_are_encoded(spark, token_docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(token_docs.where("doc_id < 9"), PAIRS, cache).collect()
    before = token_counts.cached(spark, cache).count()
    # A stored count is taken as it is, and only for its version.
    wrong = token_counts.cached(spark, cache).select("version", F.unhex(F.sha2(F.lit("stored"), 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    wrong.limit(1).write.parquet(f"{cache}/own")
    docs = spark.createDataFrame([(1, "stored"), (2, "one"), (3, "new to it")], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PAIRS, cache).collect()}
    assert found == {1: 77, 2: 1, 3: library(PAIRS)("new to it")}
    assert token_counts.cached(spark, cache).count() == before + 2
    other = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES, cache).collect()}
    assert other[1] == library(PIECES)("stored")


def test_counts_of_nothing(spark, token_docs, tmp_path):
    assert token_counts.count_tokens(token_docs.where("false"), PAIRS, str(tmp_path / "cache")).collect() == []


def test_hot_keys_are_looked_up(spark):
    rows = spark.range(4000).select("id", F.sha2(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("string"), 256).alias("key"), F.lit("x").alias("y"))
    table = rows.where("id % 3 <> 1").groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("least"))
    want = {r.key: r.least for r in table.collect()}
    for r in look_up(rows, table, "key", "least").collect():
        assert r.least == want.get(r.key)


# ---------------------------------------------------------------- conversations

CONVERSATIONS = "conv_id long, turn long, role string, text string, part long, key string, line string, audit string, cost long, copies_of long"


def damaged(rows):
    """conv_id, turn, role, text after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)

    def digest(row):
        return hashlib.sha256(json.dumps({"conv_id": row[0], "role": row[2], "text": row[3]}, separators=(",", ":"), ensure_ascii=False).encode()).digest()

    key = lambda v: (v is not None, v or 0)
    return sorted(out, key=lambda r: (key(r[0]), key(r[1]), r[2].encode(), digest(r)))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.sub(f"[{SPACES}]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows, marks):
    """Every state of the automaton that the pattern stands for, with the whole best audit and result kept in each."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def insert(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    to = step.get((state, name[0]))
                    if to:
                        new = (cost + 2, audit + "I", (*lines, f"{name}:"))
                        states[to] = min(states.get(to, new), new)
        return states

    # Insertions before each row are tried on top of every way so far; the least (cost, audit) of a state is enough,
    # because audits of the same rows never begin one another.
    for (role, text), mark in zip(rows, marks):
        new = {}
        plain = dict(best)
        ways = [(s, w) for s, w in plain.items()]
        for _ in range(3):
            ways += [
                (step[s, n[0]], (c + 2, a + "I", (*x, f"{n}:"))) for s, (c, a, x) in list(ways) for n in ("user", "assistant") if (s, n[0]) in step
            ]
            ways = list(dict.fromkeys(ways))
        for state, (cost, audit, lines) in ways:
            options = [(3, "D", state, lines)]
            if mark not in ("blank", "duplicate"):
                cut = mark == "truncated"
                options += [(2 + cut, "R", step.get((state, n[0])), (*lines, f"{n}:{text}")) for n in ("user", "assistant")]
                options.append((int(cut), "K", step.get((state, role[:1])), (*lines, f"{role}:{text}")))
            for paid, letter, to, result in options:
                if to is not None:
                    way = (cost + paid, audit + letter, result)
                    new[to] = min(new.get(to, way), way)
        best = new
    ends = insert(dict(best))
    return min(ends[s] for s in ("", "a") if s in ends)


def expected(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", sha("")) for conv, *_ in rows}
    for conv, group in groupby(damaged(rows), key=lambda r: r[0]):
        group = list(group)
        turns = [r[1] for r in group if r[1] is not None]
        pairs = [(r[2], r[3]) for r in group]
        marks = faults(pairs)
        cost, audit, lines = cheapest(pairs, marks)
        assert GOOD.fullmatch("".join(x[0] for x in lines))
        count = Counter(marks)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def conversation_rows():
    rng, rows = random.Random(3), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys", "a"]
    said = ["Yes.", "No?", "cut", "", " \n", None, "Well! \t", "Why . ", "\u0085", "ends. ", "x"]
    for conv in range(160):
        for turn in range(rng.randint(1, 14)):
            if rng.random() < 0.9:
                text = rng.choice(said) if rng.random() < 0.5 else f"Words {rng.random()}."
                role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
                rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
                if rng.random() < 0.05:
                    rows.append(rows[-1])
    rows += [(None, t, "user", "Hi.") for t in range(4)] + [(None, None, None, None)] * 3 + [(500, None, "user", "Q.")] * 2
    rows += [(600, t, ("user", "assistant")[t % 2 if t % 17 else 0], f"{t}." if t % 11 else "same") for t in range(1200)]
    rows += [(700, 5, "user", "again.")] * 300
    return rows + [(800 + k, 3, "user", "long " * 50_000 + ".") for k in range(2)]


@pytest.fixture(scope="module")
def talk(spark):
    rows = conversation_rows()
    extra = [(*r, 1, "k", "l", "a", 2, 3) for r in rows]
    return rows, spark.createDataFrame(extra, CONVERSATIONS).repartition(6)


@pytest.mark.parametrize("size", [conversations.SEGMENT, 7, 1])
def test_repair_equals_brute_force(talk, size):
    rows, given = talk
    found = conversations.digest(given, conversations.repair(conversations.damage(given), size)).collect()
    got = {r.conv_id: tuple(r[c] for c in (*conversations.FIGURES, "audit", "repaired_sha256")) for r in found}
    want = expected(rows)
    assert len(found) == len(want)
    wrong = {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v}
    assert not wrong, list(wrong.items())[:3]


def test_splitting_anywhere_gives_the_same_edits():
    rng = random.Random(9)
    solver, costs = conversations.Solver(), tuple(2 * n for n in conversations.CLOSING)
    for _ in range(300):
        codes = bytes(rng.randrange(len(conversations.STEPS)) for _ in range(rng.randint(1, 12)))
        whole = solver.edits(codes, 0, costs)
        for cut in range(1, len(codes)):
            vector = solver.forward(codes[:cut], conversations.entering(0))[1]
            across = solver.crossing(vector, solver.backward(codes[cut:], costs))
            left = solver.edits(codes[:cut], 0, tuple(0 if s == across else conversations.NEVER for s in range(4)))
            assert left + solver.edits(codes[cut:], across, costs) == whole


def test_repaired_rows(spark):
    given = spark.createDataFrame(
        [(1, 0, "user", "Hi."), (1, 1, "user", "Really?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes.")],
        "conv_id int, turn int, role string, text string",
    )
    rows, audits, figures = conversations.repair(given)
    assert [tuple(r) for r in rows.orderBy("part", "place").select("role", "text", "edit").collect()] == [
        ("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Really?", "K"), ("assistant", "Yes.", "K"),
    ]
    assert [r.audit for r in audits.collect()] == ["KIKKD"]
    assert [tuple(r) for r in figures.collect()] == [(1, 0, 0, 1, 0, 2, 5)]


def test_no_conversations(spark, talk):
    none = talk[1].where("false")
    assert conversations.digest(none, conversations.repair(conversations.damage(none))).collect() == []


# ---------------------------------------------------------------- periodic runs


def words(text):
    return re.findall(f"[^{SPACES}]+", text or "")


def brute_runs(w):
    out = set()
    for d in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - d:
            first = i
            while i < len(w) - d and w[i] == w[i + d]:
                i += 1
            size = i - first + d
            if size >= max(12, 2 * d) and i > first and smallest(w[first : first + size]) == d:
                out.add((first, size, d))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def smallest(w):
    return next(q for q in range(1, len(w) + 1) if all(a == b for a, b in zip(w, w[q:])))


def stutter(doc_id, w):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected_runs(doc_id, text):
    w = stutter(doc_id, words(text))
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def run_texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a " * 700, "a b " * 6, "a b " * 5 + "a", "é ü  " * 9, "x y z w v u " * 2 + "x y z w v u"]
    out += ["a a a a a a a b " * 40, ("a " * 60 + "b ") * 3, " ".join(rng.choices("ab", k=600)), "one\x0btwo\x0cthree " * 8]
    out += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(120)]
    for _ in range(60):
        root = rng.choices("abcdefgh", k=rng.randint(1, 30))
        out.append(" ".join(rng.choices("xyz", k=rng.randint(0, 9)) + (root * 9)[: rng.randint(1, 120)] + rng.choices("xyz", k=rng.randint(0, 9))))
    return out


RUN_DOCS = "doc_id long, text string, runs string, n_words long, best string, collapsed string, start long"


def test_runs_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(run_texts())]
    rows += [(None, "a b c d " * 9), (None, None), (6, rows[6][1]), (6, rows[6][1]), *((i, "p q r s t u v w x y z " * 3) for i in range(900, 960))]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], RUN_DOCS).repartition(3)
    got = periodic.digest(periodic.find_runs(docs, periodic.stuttered)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    assert Counter(map(tuple, got.collect())) == Counter(expected_runs(*r) for r in rows)


def test_runs_of_long_texts_take_no_pairs_of_words():
    many = np.zeros(200_000, np.int64)
    _, start, length, period = periodic.Diagonals(many, np.array([0, len(many)])).runs()
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [1])
    marked = np.tile(np.append(np.zeros(30_000, np.int64), 1), 3)
    _, start, length, period = periodic.Diagonals(marked, np.array([0, len(marked)])).runs()
    assert sorted(zip(length.tolist(), period.tolist())) == [(30_000, 1)] * 3 + [(len(marked), 30_001)]


def test_plain_runs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "so " + "na na hey " * 5 + "end")], "doc_id string, text string")
    row = periodic.find_runs(docs).collect()[0]
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "so na na hey end" and row.n_words == 17
    assert periodic.find_runs(docs.where("false")).collect() == []


def test_new_queries_are_registered():
    assert {"op11_token_counts", "op12_conversation_repair", "op13_periodic_runs"} <= set(queries.QUERIES)

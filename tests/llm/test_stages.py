"""The pipeline's stages on clashing columns, shared ids, repeated rows and nothing."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from harborlight.llm import decontaminate, jaccard

HELPERS = "gone long, gone_ long, gone_id long, gone_key long, own_key long, text_hash long, node long, kept long, component_id long, key long, found long, own long"
COLUMNS = f"doc_id long, text string, lang string, source string, n_chars long, {HELPERS}"
ENGLISH = "the ship sailed over the sea to the harbour and the crew went on land for the night while the wind was blowing from the west "
GERMAN = "das schiff fuhr über das meer zum hafen und die mannschaft ging für die nacht an land während der wind aus dem westen wehte "


def rows():
    texts = [ENGLISH + f"number {i} of the {w} words" for i, w in enumerate("red blue green brown black white".split())]
    texts += [GERMAN + f"nummer {i} der {w} worte" for i, w in enumerate("roten blauen grünen braunen".split())]
    out = [(i, t, "en" if i < 6 else "de") for i, t in enumerate(texts)]
    out += [(20, ENGLISH * 3, "en"), (21, ENGLISH * 3, "en"), (21, ENGLISH * 3, "en"), (None, ENGLISH * 3, "en"), (23, None, None), (24, "", "en")]
    out += [(30, "one two three four five six seven " + ENGLISH, "en"), (30, "quite another text under one id, with words of its own, that nobody else has", "en")]
    return [(*r, "s", 1, *range(12)) for r in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    benchmark = spark.createDataFrame([("b1", "quite another text under one id with words of its own")], "item_id string, text string")
    benchmark.write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{place}/documents.parquet")
    return str(place)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_that_clash(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage(spark, docs, sf_dir)
    assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
    assert out.count() <= docs.count()
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_one_of_each_loses_no_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect())
    every = Counter((r[0], r[1]) for r in rows())
    # Of the equal texts 20 and 21 the first stays, once; both texts under 30 stay, and rows that link with nothing.
    assert kept == Counter({k: 1 for k in every if k != (21, ENGLISH * 3)}) | Counter({k: n for k, n in every.items() if k[0] is None})


def test_smallest_id_stays_whatever_the_hashes(spark):
    texts = [ENGLISH + " ".join(f"w{i}" for i in range(40)), ENGLISH + " ".join(f"w{i}" for i in range(40)) + " end"]
    docs = spark.createDataFrame([(9, texts[0]), (7, texts[1]), (7, "another text of seven words in all"), (8, texts[0])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()) == sorted([(7, texts[1]), (7, "another text of seven words in all")])


def test_decontamination_moves_no_texts(spark, sf_dir, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    left = decontaminate.without_contaminated(docs, benchmark)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    wanted = Counter(r for r in rows() if not (r[1] or "").startswith("quite another"))
    assert Counter(map(tuple, left.collect())) == wanted
    # Texts are searched a few at a time, whatever the size of the batch.
    monkeypatch.setattr(decontaminate, "SEARCH_BYTES", 100)
    assert Counter(map(tuple, decontaminate.without_contaminated(docs, benchmark).collect())) == wanted

"""Registered queries against their SQL, and the shape of the entry points."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import connect, differences

SF = "/root/testdata/sf0.001"
#: All registered queries take over seven minutes; set ALL_QUERIES to run them.
NAMES = [
    "a11_normalize_ais", "a22_extract_ofac_vessels", "e12_convoy_means", "f07_last_120_minutes", "f12_thin_track", "h02_union_sources",
    "j04_rendezvous", "j05_fishing", "j06_cable_proximity", "j09_spoofing", "j11_anchor_drag", "j13_vessel_risk",
]
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES) if os.environ.get("ALL_QUERIES") else NAMES)
def test_query_equals_sql(spark, name):
    problem, rows, _, _ = differences(spark, SF, name, entry.queries()[name], entry.oracle_sql().get(name), connect(SF))
    assert problem is None


@pytest.mark.parametrize("hidden", ["sentencepiece", "tokenizers", "xxhash", "public_tokenizers"])
def test_core_queries_stay_without_a_corpus_library(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[-1]) == len(registry.QUERIES)

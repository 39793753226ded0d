import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from compare import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = (
    "resolved_pairs", "classify_pairs", "wide_compare", "corrections_manifest", "friendly_review", "salary_delta_buckets",
    "wave_rows", "run_overview", "dedupe_best", "diff_pairs", "crowded_candidates", "comp_band_annotate", "audit_row_checks",
    "issue_frame", "split_first_middle",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_is_registered_once():
    modules = entry_module.catalog._modules()
    assert sum(len(m.QUERIES) for m in modules) == len(entry_module.catalog.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF).toArrow()
    expected = duck.sql(entry_module.oracle_sql()[name]).to_arrow_table()
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

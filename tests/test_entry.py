from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gaugewise.plans import queries as screening

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
FAST = ["missing_intervals", "monthly_stats", "pair_availability", "l1_long_gaps", "l1_duplicates", "l1_timestep", "l1_zero_flow", "l1_spike_counts", "l2_baseflow", "l2_events", "c_daily_metrics", "c_jsd", "peers_local", "ctx_validate", "sel_timespan", "l1_step_blocks", "c_supplied", "manifest", "net_failures", "provenance", "l1_step_boundaries", "l1_epoch_overview_fine", "net_counts"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(screening.ORACLE_SQL) > 70
    # those are held against brute force in test_contract.py and test_context.py
    assert set(screening.QUERIES) - set(screening.ORACLE_SQL) <= {"l1_summary", "l2_contract", "l3_run", "l3_summary", "l3_summary_evidence", "station_summary"}


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = screening.QUERIES[name](spark, SF).toPandas(), con.sql(screening.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
        return sorted(str([round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r]) for r in df.values.tolist())

    assert rows(a) == rows(b)


def test_imports_without_the_corpus_operators(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('gaugewise.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'l1_missing' in names and not any(n.startswith('op') or n == 'pipeline' for n in names) and set(e.oracle_sql()) <= set(names)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_nothing_else_imports_them():
    for path in (ROOT / "gaugewise").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gaugewise.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()

"""The driver's contract, with and without the training-data folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__spark_entry__.__file__).parent


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["best_view_summary", "method_grouping_sets", "topk_select", "external_agreement", "knn_join_topk"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(None if v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


def test_imports_without_the_training_data_folders(tmp_path):
    for p in ROOT.rglob("*.py"):
        own = p.relative_to(ROOT)
        if "llm" not in own.parts and own.name != "corpus_pipeline.py":
            (tmp_path / own).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / own).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_view_summary' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)

import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "coverage", "complete", "n_tiles"] and df.count() > 0


def test_area_is_pruned_in_the_scan(spark, tmp_path):
    """The area's tile range reaches the Parquet scan of a table of versions, and only the columns needed are read."""
    from terrachron.functions import grids as G
    from terrachron.operators.coverage import coverage_by_date, in_bounds
    from terrachron.plans import queries, views

    views.captures(spark, SMALL).withColumn("provider", F.lit("p")).withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / "versions"))
    versions = in_bounds(spark.read.parquet(str(tmp_path / "versions")), "1995-01-01", None)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = coverage_by_date(versions, queries.AOI, G.MERCATOR, 17)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[[^\]]*\]", plan)[0]
    c0, c1, r0, r1 = queries.AOI.tile_range(G.MERCATOR, 17)
    for part in (f"GreaterThanOrEqual(tile_col,{c0})", f"LessThanOrEqual(tile_col,{c1})", f"GreaterThanOrEqual(tile_row,{r0})", f"LessThanOrEqual(tile_row,{r1})", "GreaterThanOrEqual(capture_date,1995-01-01)"):
        assert part in pushed, pushed
    assert "unused" not in plan and "object_id" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_catalogue_does_not_need_the_other_subpackage(monkeypatch):
    code = (
        "import builtins, sys\n"
        "real = builtins.__import__\n"
        "def gone(name, *a, **k):\n"
        "    if name == 'corpus_pipeline' or name.startswith('terrachron.llm'):\n"
        "        raise ModuleNotFoundError(name, name='corpus_pipeline' if name == 'corpus_pipeline' else 'terrachron.llm')\n"
        "    return real(name, *a, **k)\n"
        "builtins.__import__ = gone\n"
        "import __spark_entry__ as e\n"
        "assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for p in (ROOT / "terrachron").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p

"""Plans: no cross products, filters and columns reach the scan."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

CHECKED = ["fire_flash_holdover", "radius_pairs", "coverage_daily", "storm_coverage", "gap_episodes", "flash_thunder_pairs",
           "asof_backward", "preferred_sensor", "point_in_area", "watch_sectors", "counter_delta", "topk_per_group"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_products(spark, name):
    p = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_pushdown(spark):
    p = plan(entry.queries()["fire_flash_holdover"](spark, DATA))
    assert "EqualTo(l_returnflag,A)" in p and "l_comment" not in p and "l_tax" not in p


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["topk_per_group"](spark, DATA))


def test_catalog_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    from stormlens.plans.catalog import build_catalog
    from workload import base
    n = base.nodes(spark, DATA).withColumn("mic", F.col("nation") % 2 == 0).withColumn("first_day", F.lit(9496))
    paths = build_catalog(
        spark, str(tmp_path), nodes=n, fires=base.fires(spark, DATA), flashes=base.flashes(spark, DATA, good=False),
        uploads=base.uploads(spark, DATA), rain=base.rain(spark, DATA), min_storm_flashes=2, dry_mm=100.0, natural="building")
    rows = {k: spark.read.parquet(p).count() for k, p in paths.items()}
    assert len(rows) == 16 and all(rows.values()), rows
    natural = spark.read.parquet(paths["fires_natural"])
    assert {r.cause.lower() for r in natural.select("cause").distinct().collect()} == {"building"} and natural.count() < rows["fires_all"]
    best = spark.read.parquet(paths["study_candidates"]).orderBy(F.desc("study_score")).first()
    assert 0 < best.study_score <= 1 and best.n_flashes > 0


def test_detection_head(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from stormlens.operators.patrol import apply_head

    @F.pandas_udf("bigint")
    def head(a: pd.Series, b: pd.Series) -> pd.Series:
        return ((b - a).abs() > 5).astype("int64")
    df = spark.createDataFrame([(1.0, 9.0), (1.0, 2.0)], "a double, b double")
    assert [r.detections for r in apply_head(df, head, ["a", "b"]).collect()] == [1, 0]

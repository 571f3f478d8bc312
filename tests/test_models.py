"""One forest for all horizons, by SQL over its leaves; scores with given seeds; forecasts found among names."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dekadal.operators import models
from dekadal.sources import files, sinks


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(8)
    rows = []
    for s in "ab":
        v = [rng.gauss(0, 1) + (k % 6) for k in range(160)]
        for d in range(8, 160):
            ahead = [v[d + h] if d + h < 160 else None for h in range(3)]
            rows.append((s, d, v[d - 8 : d], ahead))
    rows += [("a", 500, None, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "series string, date int, window array<double>, targets array<double>")


def test_leaf_means_and_spread_by_sql(spark, windows, tmp_path):
    pca, forest, leaves = models.grow_forest(windows, k=4, trees=7, depth=3)
    score = windows.where("exists(targets, t -> t is null)")
    put = lambda df, name: df.write.parquet(str(tmp_path / name)) or f"'{tmp_path / name}/*.parquet'"
    features = lambda df: forest.transform(pca.transform(df.where("window is not null").withColumn("x", models.array_to_vector("window"))))
    train = put(models.leaf_rows(features(windows.where("forall(targets, t -> t is not null)")), ["series", "date", "targets"]), "train")
    scored = put(models.leaf_rows(features(score), ["series", "date"]), "scored")
    stored = put(leaves, "leaves")
    got = put(models.score_forest(score, pca, forest, leaves, ["series", "date"]), "got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW m AS SELECT tree, leaf, h, avg(targets[h + 1]) AS mean, count(*) AS n FROM {train}, range(0, 3) t(h) GROUP BY ALL")
    assert con.execute(f"SELECT count(*) FROM m JOIN {stored} l ON m.tree = l.tree AND m.leaf = l.leaf WHERE abs(mean - means[h + 1]) > 1e-9 OR m.n <> l.n").fetchone()[0] == 0
    assert con.execute("SELECT count(DISTINCT (tree, leaf)) FROM m").fetchone()[0] == leaves.count() <= 7 * 8
    con.execute(f"CREATE VIEW s AS SELECT series, date, h, avg(mean) AS mean, stddev_pop(mean) AS std FROM {scored} JOIN m USING (tree, leaf) GROUP BY ALL")
    bad, n = con.execute(f"SELECT count(*) FILTER (abs(s.mean - g.mean) > 1e-9 OR abs(s.std - g.std) > 1e-9 OR abs(g.upper - g.mean - 1.96 * g.std) > 1e-9), count(*) FROM s JOIN {got} g ON s.series = g.series AND s.date = g.date AND s.h = g.horizon").fetchone()
    assert (bad, n) == (0, 2 * 2 * 3)
    assert con.execute(f"SELECT count(*) FROM {got}").fetchone()[0] == n


def test_a_forest_beats_the_mean(windows):
    """On a season of six steps that windows tell: the error of each horizon is well below the targets' spread."""
    known = windows.where("window is not null and forall(targets, t -> t is not null)")
    pca, forest, leaves = models.grow_forest(known.where("date < 110"))
    got = models.score_forest(known.where("date >= 110"), pca, forest, leaves, ["series", "date"]).join(known, ["series", "date"])
    error = got.select("horizon", ((F.get("targets", "horizon") - F.col("mean")) ** 2).alias("e"), F.get("targets", "horizon").alias("t"))
    for r in error.groupBy("horizon").agg(F.avg("e").alias("mse"), F.var_pop("t").alias("spread")).collect():
        assert r.mse < 0.8 * r.spread


def test_one_scoring_pass(windows):
    """The plan of a forecast puts the rows through the trees once, whatever the number of horizons."""
    plan = models.rf_forecast(windows, k=3, trees=4, depth=2, ahead=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("posexplode") == 2


def test_only_the_newest_run_is_opened(spark, tmp_path):
    base = str(tmp_path / "runs")
    day = lambda d: F.lit(d).cast("date").alias("date")
    fc = lambda a, b, v: spark.range(1).select(F.explode(F.array(F.lit(a).cast("date"), F.lit(b).cast("date"))).alias("date"), F.lit(v).alias("percent_inundation"), F.lit(0.0).alias("lower_bound_95"), F.lit(1.0).alias("upper_bound_95"))
    none = spark.range(0).select(day("2020-01-01"), F.lit(0.0).alias("percent_inundation"))
    for a, b, v in (("2021-01-01", "2021-02-21", 1.0), ("2020-12-01", "2021-03-01", 2.0), ("2021-02-01", "2021-02-11", 3.0)):
        sinks.write_forecast(none, fc(a, b, v), base)
    (tmp_path / "runs" / "notes").mkdir()
    (tmp_path / "runs" / "notes" / "x.csv").write_text("no run")
    got = files.latest_forecast(spark, base)
    assert {r.percent_inundation for r in got.collect()} == {2.0} and len(got.inputFiles()) == 1
    (tmp_path / "runs" / "2020-12-01_to_2021-03-01" / "again.csv").write_text("date\n")
    with pytest.raises(ValueError):
        files.latest_forecast(spark, base)

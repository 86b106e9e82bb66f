"""Joins broadcast what is measured or named as small, never what an estimate says is small."""

from pyspark.sql import functions as F

from atrium.session import tune


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_by_estimate(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "few"))
    tune(spark)
    few = spark.read.parquet(str(tmp_path / "few"))
    many = few.select("id", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("n"))  # estimated as large as its file
    assert "BroadcastHashJoin" not in plan(many.join(many.withColumnRenamed("n", "m"), "id"))
    assert "BroadcastHashJoin" in plan(many.join(F.broadcast(few), "id"))


def test_limit_of_the_caller_holds_for_measured_sizes(spark):
    tune(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") in ("10m", spark.sparkContext.getConf().get("spark.sql.autoBroadcastJoinThreshold"))

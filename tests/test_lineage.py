"""Numbering, running sums and staged tables, with and without a checkpoint folder."""

import pytest
from pyspark.sql import functions as F

from millbook.functions.paging import dense_number
from millbook.functions.prefix import range_parts, running_sum, sums_over_parts
from millbook.plans import lineage
from tests.test_plans import plan_of


@pytest.mark.parametrize("folder", [True, False])
def test_dense_number_is_gapless(spark, folder, monkeypatch):
    """Wide rows from 48 partitions; also without any checkpoint folder in the session."""
    if not folder:
        monkeypatch.setattr(lineage, "checkpoint_dir_of", lambda _spark: None)
    df = (spark.range(0, 60_000, numPartitions=48)
          .select((F.xxhash64("id")).alias("k"), F.repeat(F.lit("x"), 200).alias("wide")))
    got = dense_number(df, ["k"], "n", start=5).agg(
        F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (60_000, 60_000, 5, 60_004)


def test_no_folder_on_a_cluster_raises(spark, monkeypatch):
    monkeypatch.setattr(lineage, "checkpoint_dir_of", lambda _spark: None)

    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_running_sum_of_a_hot_group(spark):
    df = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 4).cast("string")).alias("g"),
        (F.col("id") * 7919 % 5000).alias("o"), (F.col("id") % 11).alias("v"))
    got = running_sum(df, ["o"], "v", "s", group=["g"]).collect()
    want, total = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        total[r["g"]] = total.get(r["g"], 0) + r["v"]
        want[r["g"], r["o"]] = total[r["g"]]
    assert {(r["g"], r["o"]): r["s"] for r in got} == want
    assert len(got) == 5_000


def test_running_sum_without_a_group(spark):
    got = running_sum(spark.range(1_000).withColumn("v", F.lit(2)), ["id"], "v", "s").collect()
    assert all(r["s"] == 2 * (r["id"] + 1) for r in got) and len(got) == 1_000


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_group_sums_shuffle_the_rows_once(spark, kind):
    """Where the earlier parts' sums are too many to broadcast, they join the rows as the window left them; NULL is a group."""
    df = spark.range(300).select(F.when(F.col("id") % 4 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 3).cast("int"))).alias("g"),
                                 F.col("id").alias("o"), F.lit(1).alias("v"))
    df = df.withColumn("g", F.unix_date("g").cast("long") if kind == "long" else F.col("g").cast(kind))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = range_parts(df, ["g", "o"], "_range")
        for out in (running_sum(df, ["o"], "v", "s", group=["g"]), sums_over_parts(rows, "_range", ["g"], ["o"], {"s": F.col("v")})):
            plan = plan_of(out, "simple")
            assert plan.count("Exchange hashpartitioning(") == 4, plan  # the rows, their totals by part, by group and for the join
            seen, want = {}, {}
            for r in sorted(df.collect(), key=lambda r: r.o):
                seen[r.g] = want[r.o] = seen.get(r.g, 0) + 1
                want[r.o] = seen[r.g]
            assert {r.o: r.s for r in out.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

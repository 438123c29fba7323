"""Rows are dealt to tasks by their number, and no task gets all of a kind."""

import pytest
from pyspark.sql import functions as F

from evimap.functions import tables
from evimap.operators import compare, selection
from evimap.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("of", [queries.segments, queries.all_segments, queries.peptides])
def test_tasks_grow_with_rows(spark, monkeypatch, of):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    assert of(spark, SF).rdd.getNumPartitions() >= -(-n // 100)


def test_merged_models_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(3000).select(F.lit("c").alias("seqid"), F.lit("x").alias("source"), F.lit("cds").alias("type"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"), F.lit(0.0).alias("score"), F.lit("+").alias("strand"), F.lit("0").alias("frame"), F.lit("g").alias("gene"), (F.col("id") % 500).cast("string").alias("protein"), F.col("id").alias("line_no"))
    out = compare.merged_models(rows, count=3000)
    assert out.rdd.getNumPartitions() >= 30 and out.count() == 3500
    assert sorted(out.collect()) == sorted(compare.merged_models(rows).collect())


def test_lines_that_name_nothing_are_spread(spark):
    line = lambda attrs: F.concat(F.lit("c\tx\tcds\t1\t9\t.\t+\t.\t"), attrs)
    lines = spark.range(0, 4000, 1, 4).select(line(F.when(F.col("id") == 7, "ID=c7;Parent=m7").otherwise("note=1; x")).alias("value"), F.col("id").alias("place"))
    named = spark.createDataFrame([("c\tx\tmRNA\t1\t9\t.\t+\t.\tID=m7", 5000)], "value string, place long")
    out = selection.resolved(lines.unionByName(named)).withColumn("task", F.spark_partition_id())
    got = out.collect()
    assert len(got) == 4001 and {(r.place, r.protein) for r in got if r.protein} == {(7, "m7"), (5000, "m7")}
    most = out.where("protein is null").groupBy("task").count().agg(F.max("count")).first()[0]
    assert most < 3900


def test_fields_of_a_line_are_split_once(spark):
    from evimap.sources import annotations

    lines = spark.createDataFrame([("c\tx\tCDS\t1\t9\t.\t+\t0\tParent=m1;gene_id=g#c", 1), ("# note", 2), ("c\tx\texon\t1\t9\t.\t+\t.\ttranscript_id \"t\"", 3)], "value string, place long")
    for out, want in ((annotations.feature_rows(lines), ("m1", "g")), (annotations.transcript_models(lines).selectExpr("transcript as protein", "gene"), ("t", "t"))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(value") + plan.count("split(CASE") + plan.count("split(if") + plan.count("split(regexp") == 1
        assert [(r.protein, r.gene) for r in out.collect()] == [want]


def test_peptides_of_a_score_table_stay_dealt(spark, monkeypatch):
    tables_, write = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df: tables_.append(df.columns) or write(df))
    queries.score_table(spark, SF)
    assert tables_ and not any("peptide" in t for t in tables_)

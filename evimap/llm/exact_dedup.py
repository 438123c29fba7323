"""Exact deduplication by salted combining.

Texts are equal when they are equal without white space ([\\x20\\x09-\\x0D]). Each task first combines its own
copies, then groups of (digest, content, salt) combine across tasks, then the salts' winners combine globally.
The content is part of the grouping key at both stages, so equality is decided by the whole text and not by a
digest; a group holds counters only (winner, size), never its rows. Rows get their winner by joining on the
32-byte digest and a salt, over which the winners of groups of two or more are copied; a row that finds none is the
only one of its text. Digests under which two contents meet, should that ever happen, are joined on the content.

Defined results: a null text is empty; a null id is written back as null and loses all ties; rows repeated
with the same id are counted each, and all of them are marked kept if their text is the winner's
(drop_exact_duplicates leaves one of them); an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.llm.common import materialise, quoted

#: Salts that a group's local winners are spread over before the global merge.
SALTS = 16
#: One unit of length in the packed winner, above any id's absolute value.
_STEP = "100000000000000000000"
_NO_ID = "9223372036854775808"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _best(length: str, id_col: str) -> Column:
    """Longest text first, then the smallest id, as one decimal: length * STEP - id."""
    return (F.col(length).cast("decimal(38,0)") * F.lit(_STEP).cast("decimal(21,0)")).cast("decimal(38,0)") - F.coalesce(F.col(id_col).cast("decimal(19,0)"), F.lit(_NO_ID).cast("decimal(19,0)")).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id_col (doc_id, where that is one of the other names), keep_id, group_size, kept, text_sha256."""
    found = _winners(docs, id_col, text_col, salts)
    name = "doc_id" if id_col.lower() in [c.lower() for c in found.columns] else id_col
    return found.withColumnRenamed("_id", name)


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_n"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("_digest", F.sha2(F.col("_norm"), 256))
    salted = rows.select("_digest", "_norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), _best("_n", "_id").alias("_best"))
    by_salt = salted.groupBy("_digest", "_norm", "_salt").agg(F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_size"))
    groups = by_salt.groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    # what is kept of a content from here on: its digest, counters and, for the digests of several contents, itself
    winners = materialise(groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents"), F.max("_best").alias("_best"), F.sum("_size").alias("_size")).where("_size > 1"), "winners")
    # a row without a winner is the only one of its text; the copies of one text are dealt over salts, as its winner is
    spread = winners.where("_contents = 1").select("_digest", "_best", "_size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    lone = rows.select("_id", "_n", "_digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    clashing = winners.where("_contents > 1").select("_digest")
    clash = not clashing.isEmpty()  # two contents under one digest: those rows are joined on the content
    if clash:
        lone = lone.join(clashing, "_digest", "left_anti")
    found = lone.join(spread, ["_digest", "_salt"], "left").select("_id", "_n", "_digest", F.coalesce("_best", _best("_n", "_id")).alias("_best"), F.coalesce("_size", F.lit(1)).alias("_size"))
    if clash:
        exact = rows.join(clashing, "_digest", "left_semi").join(groups.join(clashing, "_digest", "left_semi"), ["_digest", "_norm"])
        found = found.unionByName(exact.select("_id", "_n", "_digest", "_best", "_size"))
    step = F.lit(_STEP).cast("decimal(21,0)")
    keep = (F.col("_n_best") * step - F.col("_best")).cast("decimal(38,0)")
    found = found.withColumn("_n_best", F.round((F.col("_best").cast("decimal(38,0)") / step).cast("decimal(38,6)")).cast("decimal(19,0)"))
    keep_id = F.when(keep < F.lit(_NO_ID).cast("decimal(19,0)"), keep.cast("long"))
    return found.select(
        "_id",
        keep_id.alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(keep_id) & (F.col("_n") == F.col("_n_best"))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Of rows that share the winner's id, text and length, the first one by all columns that have an order stays."""
    kept = _winners(docs, id_col, text_col, SALTS).where("kept").select(F.col("_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("_id"), F.sha2(normalised(text), 256).alias("_sha"), F.length(text).alias("_len"))
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi")
    order = [F.col(f"doc.{quoted(c)}") for c, t in docs.dtypes if not re.search("map|variant|interval", t)]
    nth = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy(F.col("_len").desc(), *order))
    return rows.withColumn("_nth", nth).where("_nth = 1").select("doc.*")

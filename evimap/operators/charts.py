"""The numbers behind the figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimap.functions.scalars import rounded

#: Groups of the coverage histogram, of rows with supported and confidence.
COVERAGE_GROUPS = {"supported": "supported = '+'", "not_supported": "supported <> '+'", "high": "confidence = 'high'", "moderate": "confidence = 'moderate'"}


def histogram(rows: DataFrame, groups: dict[str, str], value: str, bins: int = 20) -> DataFrame:
    """group, bin (from 0), n, density (6 places): each group (a condition) over its own range, the last bin closed.

    A group of one value has the range of half a unit on both sides of it. The ranges are one row."""
    known = rows.where(F.col(value).isNotNull())
    facts = [f.alias(f"{what}_{i}") for i, e in enumerate(groups.values()) for what, f in (("lo", F.min(F.when(F.expr(e), F.col(value)))), ("hi", F.max(F.when(F.expr(e), F.col(value)))), ("n", F.count_if(F.expr(e))))]
    ranges = known.agg(*facts).select(F.struct("*").alias("r"))
    spread = lambda i: (F.col(f"r.hi_{i}") == F.col(f"r.lo_{i}")).cast("double") / 2
    entries = [F.when(F.expr(e), F.struct(F.lit(name).alias("group"), (F.col(f"r.lo_{i}") - spread(i)).alias("lo"), (F.col(f"r.hi_{i}") + spread(i)).alias("hi"), F.col(f"r.n_{i}").alias("all"))) for i, (name, e) in enumerate(groups.items())]
    each = known.withColumn("r", ranges.scalar()).select(F.col(value).alias("_x"), F.explode(F.array_compact(F.array(*entries))).alias("g")).select("_x", "g.*")
    at = F.least(F.floor((F.col("_x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = each.groupBy("group", at.alias("bin"), "lo", "hi", "all").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("group", "bin", "n", rounded(F.col("n") / (F.col("all") * ((F.col("hi") - F.col("lo")) / bins)), 6).alias("density"))


def coverage_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(scores, COVERAGE_GROUPS, "sequence_coverage", bins)


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(scores, {"all": "true", "supported": "supported = '+'"}, "external_score", bins)


def evidence_bars(scores: DataFrame) -> DataFrame:
    """bar, supported, peptide_evidence, no_peptides, total: of the proteins with a kind of evidence, those supported and others."""
    kinds = ("mapped_peptides", "n_terminal_peptides", "c_terminal_peptides", "splice_peptides")
    n = scores.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(f"{k} > 0")).alias(f"e_{k}") for k in kinds], *[F.count_if(F.expr(f"{k} > 0 and supported in ('+', 'Yes')")).alias(f"s_{k}") for k in kinds])
    rows = ", ".join(f"'{k}', s_{k}, greatest(e_{k} - s_{k}, 0), greatest(n - e_{k}, 0), n" for k in kinds)
    return n.select(F.expr(f"stack(4, {rows}) as (bar, supported, peptide_evidence, no_peptides, total)"))


def legacy_bars(summary: DataFrame) -> DataFrame:
    """The same from a summary of bar, supported (or mapped), partial (if any) and unsupported (or unmapped); none is known to be supported."""
    names = set(summary.columns)
    yes, no = ("mapped", "unmapped") if {"mapped", "unmapped"} <= names else ("supported", "unsupported")
    part = F.coalesce("partial", F.lit(0)) if "partial" in names else F.lit(0)
    rows = summary.select("bar", (F.coalesce(yes, F.lit(0)) + part).cast("long").alias("peptide_evidence"), F.coalesce(no, F.lit(0)).cast("long").alias("no_peptides"))
    return rows.select("bar", F.lit(0).cast("long").alias("supported"), "peptide_evidence", "no_peptides", (F.col("peptide_evidence") + F.col("no_peptides")).alias("total"))


def difference_counts(novel: DataFrame, summary: DataFrame) -> DataFrame:
    """what, n: novel proteins, and those of each kind of difference that peptides speak for; 0 where there are none."""
    kinds = ("novel", "peptide_support_different_splice", "peptide_support_different_start", "peptide_support_different_stop")
    every = reduce(DataFrame.unionAll, [novel.select(F.lit("novel").alias("what"), F.countDistinct("protein").alias("n")), summary.select(F.trim("category").alias("what"), F.col("n").cast("long").alias("n"))])
    counts = every.groupBy("what").agg(F.max("n").alias("n"))
    names = counts.sparkSession.createDataFrame([(k,) for k in kinds], "what string")
    return names.join(counts, "what", "left").na.fill(0, ["n"])


def type_counts(located: DataFrame) -> DataFrame:
    """type, n: located peptides of each type."""
    return located.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

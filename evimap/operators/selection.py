"""Subsets of annotations by model ids, merged annotations, and what two branches have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap.functions.scalars import extracted
from evimap.functions.tables import dealt, written
from evimap.operators.compare import ACCEPTED, class_code_summary

#: Groups of the lines that ask for no id.
SPREAD = 1 << 12
FEATURE = ("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attrs")


def by_ids(rows: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("protein", "gene")) -> DataFrame:
    """Rows one of whose columns is among ids (column id), each once. Null ids match nothing."""
    wanted = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    out, found = rows, F.lit(False)
    for i, c in enumerate(columns):
        out = out.join(wanted.select(F.col("id").alias(f"_id{i}")), rows[c].cast("string") == F.col(f"_id{i}"), "left")
        found = found | F.col(f"_id{i}").isNotNull()
    return out.where(found).drop(*[f"_id{i}" for i in range(len(columns))])


def _attr(key: str) -> Column:
    return extracted(F.col("attrs"), rf'(?:^|;)\s*{key}[=\s]+"?([^";]+?)"?\s*(?:;|$)')


def resolved(lines: DataFrame) -> DataFrame:
    """Lines (value, place) of an annotation with the protein that each belongs to, all kinds of feature included.

    A line names its protein, or an id or a parent that stands for one. Of several meanings of an id the last line's
    holds; a gene stands for the protein of its first transcript. Comments and lines of under nine fields go."""
    rows = lines.where(~F.col("value").startswith("#")).withColumn("_f", F.split("value", "\t")).where("size(_f) >= 9")
    rows = rows.select("value", "place", F.lower(F.col("_f")[2]).alias("type"), F.col("_f")[8].alias("attrs"))
    bare = F.when(F.trim("attrs").rlike(r"^[\w.\-]+$"), F.trim("attrs"))
    transcript, model = _attr("transcript_id"), F.col("type").isin("mrna", "transcript")
    rows = rows.select(
        "value", "place", "type", F.coalesce(_attr("ID"), transcript, bare).alias("id"), F.coalesce(_attr("protein_id"), transcript).alias("named"),
        F.coalesce(_attr("Parent"), transcript).alias("parent"), F.coalesce(_attr("Parent"), _attr("gene_id")).alias("above"), bare.alias("bare"),
    )
    # written once: three branches of the plan read it, and its attributes are searched for many patterns
    rows = written(rows)
    own = rows.where(model & F.col("id").isNotNull()).select("id", F.col("id").alias("protein"), "place")
    coding = rows.where("type = 'cds' and named is not null and parent is not null").select(F.col("parent").alias("id"), F.col("named").alias("protein"), "place")
    known = own.unionByName(coding).groupBy("id").agg(F.max_by("protein", "place").alias("protein"))
    genes = rows.where(model & F.col("id").isNotNull() & F.col("above").isNotNull()).groupBy("above").agg(F.min_by("id", "place").alias("first"))
    genes = genes.join(known, F.col("first") == known["id"]).select(F.col("above").alias("id"), "protein", F.lit(1).alias("_rank"))
    meaning = known.withColumn("_rank", F.lit(0)).unionByName(genes).groupBy("id").agg(F.max_by("protein", "_rank").alias("protein"))
    # only lines that don't name their protein ask; those that no longer do in a join are spread over its tasks by _no, and not one group
    means = lambda key: meaning.select(F.col("id").alias(f"_{key}"), F.col("protein").alias(f"by_{key}"), F.lit(0).alias("_yes"))
    ask, answers = rows.where("named is null"), []
    n = ask.count()
    for key in ("id", "above", "bare"):
        asked = F.when(F.coalesce(*answers, F.lit(None)).isNull(), F.col(key))
        no = F.when(asked.isNull(), 1 + F.pmod(F.xxhash64("value", "place"), F.lit(SPREAD)).cast("int")).otherwise(0)
        ask = dealt(ask.withColumns({"_asked": asked, "_no": no}), n, "_asked", "_no")
        ask = ask.join(means(key), (F.col("_asked") == F.col(f"_{key}")) & (F.col("_no") == F.col("_yes")), "left").drop("_asked", "_no", "_yes", f"_{key}")
        answers.append(F.col(f"by_{key}"))
    answered = ask.select("value", "place", F.coalesce(*answers, "bare").alias("protein"))
    return rows.where("named is not null").select("value", "place", F.col("named").alias("protein")).unionByName(answered)


def merge_annotations(*parts: DataFrame) -> DataFrame:
    """All rows of the feature tables, equal ones once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.dropDuplicates([c for c in FEATURE if c in out.columns])


def merge_sequences(*parts: DataFrame) -> DataFrame:
    """id and sequence, each id once, as the first part that has it says."""
    numbered = [p.select("id", "sequence", F.lit(i).alias("_part")) for i, p in enumerate(parts)]
    out = numbered[0]
    for part in numbered[1:]:
        out = out.unionByName(part)
    return out.groupBy("id").agg(F.min(F.struct("_part", "sequence"))["sequence"].alias("sequence"))


def branch_comparison(codes: DataFrame, reverse: DataFrame, assembly: DataFrame, prediction: DataFrame, assembly_proteins: DataFrame, prediction_proteins: DataFrame) -> dict[str, DataFrame]:
    """What a comparison of two supported branches reports, by name.

    codes: qry_id, ref_id, class_code of the assembly against the prediction; reverse: the other way round. A branch's
    sequences are part of the merged ones if any of its models overlaps the other branch's."""
    ids = lambda t, *c: t.where(F.col("class_code").isin(*c)).select(F.col("qry_id").alias("id")).distinct()
    alone, alone_too = ids(codes, "u"), ids(reverse, "u")
    shared, shared_too = ids(codes, *ACCEPTED), ids(reverse, *ACCEPTED)
    some = lambda t, s: t.join(s.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_semi")
    return {
        "summary": class_code_summary(codes, "class_code"),
        "assembly_only": codes.where("class_code = 'u'"),
        "assembly_only_features": by_ids(assembly, alone),
        "assembly_only_sequences": assembly_proteins.join(alone, "id", "left_semi"),
        "prediction_only_features": by_ids(prediction, alone_too),
        "prediction_only_sequences": prediction_proteins.join(alone_too, "id", "left_semi"),
        "shared_features": merge_annotations(by_ids(prediction, shared_too), by_ids(assembly, shared)),
        "shared_sequences": merge_sequences(some(prediction_proteins, shared_too), some(assembly_proteins, shared)),
    }

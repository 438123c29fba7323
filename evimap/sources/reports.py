"""Writing what the engine found: tables, id lists, annotations and the reports of the peptide lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimap.functions.scalars import general_number
from evimap.operators.compare import NOVEL, merged_models
from evimap.operators.evidence import in_order
from evimap.sources.annotations import write_fasta


def write_table(rows: DataFrame, path: str) -> None:
    """A tab-separated table with a header in each part file, in the order of rows."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_scores(f: DataFrame, path: str) -> None:
    """The labelled score table, supported proteins first."""
    write_table(in_order(f), path)


def write_ids(ids: DataFrame, path: str, column: str = "protein") -> None:
    """Distinct ids, sorted, one a line."""
    ids.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_id_lists(f: DataFrame, folder: str) -> None:
    """The five lists of a labelled table: all, high, low, supported and unsupported proteins."""
    for name, which in (("all", "true"), ("high_confident", "high"), ("low_confident", "low"), ("supported", "supported = '+'"), ("unsupported", "supported <> '+'")):
        write_ids(f.where(which), f"{folder}/{name}_proteins")


def unmapped(mapping: DataFrame) -> DataFrame:
    """peptide: those that a mapping table says are unmapped, once, sorted."""
    return mapping.where("upper(protein) = 'UNMAPPED' and peptide is not null").select("peptide").distinct().orderBy("peptide")


def write_lines(lines: DataFrame, path: str, order: str = "place") -> None:
    """Lines (value) as they were, in their order."""
    lines.orderBy(order).select("value").write.mode("overwrite").text(path)


def write_merged(rows: DataFrame, path: str) -> None:
    """merged_models() as a file: by protein, its transcript first."""
    m = merged_models(rows)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) if c != "score" else general_number(F.col(c)) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attrs")]
    ordered = m.orderBy("protein", F.when(F.col("type") == "transcript", 0).otherwise(1), "start", "end")
    ordered.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def novel(codes: DataFrame, rows: DataFrame, sequences: DataFrame, scores: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """What is new against the reference, by name: CDS rows, sequences and scores of the novel models, and the reference's
    sequences with theirs (both bags: equal ids stay)."""
    ids = codes.where(F.col("class_code").isin(*NOVEL)).select(F.col("qry_id").alias("id")).distinct()
    of = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    new = of(sequences, "id")
    return {"features": of(rows.where("type = 'cds'"), "protein"), "sequences": new, "scores": of(scores, "protein"), "with_reference": reference.select("id", "sequence").unionAll(new.select("id", "sequence"))}


def write_novel(parts: dict[str, DataFrame], folder: str) -> None:
    write_table(parts["features"], f"{folder}/new_predicted_proteins")
    write_fasta(parts["sequences"], f"{folder}/new_predicted_proteins_fa")
    write_table(parts["scores"], f"{folder}/new_predicted_proteins_scores")
    write_fasta(parts["with_reference"], f"{folder}/reference_and_new_proteins_fa")


def write_comparison(report: DataFrame, summary: DataFrame, lines: DataFrame, sequences: DataFrame, folder: str) -> None:
    """The report, its summary (most frequent category first) and, by category, the lines (value, place, protein) and
    sequences of its models. What an earlier run left goes."""
    write_table(report, f"{folder}/annotation_comparison_report")
    write_table(summary.orderBy(F.desc("n"), summary.columns[0]), f"{folder}/annotation_comparison_summary")
    members = report.select(F.col("predicted_id").alias("protein"), F.col("peptide_evidence_category").alias("category")).distinct()
    lines.join(members, "protein").select("category", "value", "place").sortWithinPartitions("category", "place").select("category", "value").write.mode("overwrite").partitionBy("category").text(f"{folder}/different_gtf")
    wrapped = F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n")
    found = sequences.select(F.col("id").alias("protein"), F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped).alias("value")).join(members, "protein")
    found.select("category", "value").write.mode("overwrite").partitionBy("category").text(f"{folder}/different_faa")


def write_branches(parts: dict[str, DataFrame], folder: str) -> None:
    """What branch_comparison() gives, under fixed names."""
    for name, df in parts.items():
        if name.endswith("sequences"):
            write_fasta(df, f"{folder}/{name}")
        else:
            write_table(df, f"{folder}/{name}")


def _context(found: DataFrame, proteins: DataFrame) -> DataFrame:
    """Adds before, original and after: the letters around a hit and under it; -, the peptide in lower case and - where there is none."""
    j = found.join(proteins.select(F.col("id").cast("string").alias("protein"), F.col("sequence").alias("_s")), "protein", "left")
    letter = lambda at: F.coalesce(F.nullif(F.expr(f"if({at} between 1 and length(_s), substring(_s, int({at}), 1), '')"), F.lit("")), F.lit("-"))
    original = F.coalesce(F.expr("substring(_s, int(position), length(peptide))"), F.lower("peptide"))
    return j.select("peptide", "protein", "position", letter("position - 1").alias("before"), original.alias("original"), letter("position + length(peptide)").alias("after"))


def lookup_report(found: DataFrame, kind: str = "tsv", proteins: DataFrame | None = None, positions: bool = True, with_unmapped: bool = True, isoforms: bool = True) -> DataFrame:
    """value: the lines of a report on lookup() rows, sorted by peptide, protein and position. kind: tsv, html, json, text or pepx.

    proteins: adds the context of each hit (tsv, html, json). Without positions a protein is listed once a peptide.
    isoforms: whether pepx tells isoforms of a protein apart."""
    rows = found if with_unmapped else found.where("protein <> 'UNMAPPED'")
    cells = ["peptide", "protein", "position"] if positions else ["peptide", "protein"]
    extra = ["before", "original", "after"] if proteins is not None and positions else []
    rows = _context(rows, proteins) if extra else rows.select("peptide", "protein", "position")
    rows = rows.select(*cells, *extra).distinct()
    order = [F.col(c) for c in cells]
    heads = dict(zip(["peptide", "protein", "position", "before", "original", "after"], ["peptide", "protein", "location", "prevAA", "in_fasta", "nextAA"], strict=True))
    keys = dict(zip(["protein", "peptide", "position", "before", "original", "after"], ["protein", "peptide", "location", "prevAA", "orig_seq", "follAA"], strict=True))
    names = [*cells, *extra]
    spark = found.sparkSession

    def framed(head: str, body: DataFrame, foot: str | None) -> DataFrame:
        """body: value and sort columns; the head is before all of it, the foot after."""
        rank = body.withColumn("_part", F.lit(1))
        ends = [(0, head)] + ([(2, foot)] if foot is not None else [])
        edge = spark.createDataFrame(ends, "_part int, value string")
        sort = [c for c in body.columns if c != "value"]
        return rank.unionByName(edge, allowMissingColumns=True).orderBy("_part", *sort).select("value")

    if kind == "tsv":
        return framed("\t".join(heads[c] for c in names), rows.select(*cells, F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value")), None)
    if kind == "html":
        value = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in names], F.lit("</tr>"))
        return framed("<table>\n<tr>" + "".join(f"<th>{heads[c]}</th>" for c in names) + "</tr>", rows.select(*cells, value.alias("value")), "</table>")
    if kind == "json":
        first = rows.agg(F.min(F.struct(*cells)).alias("f")).scalar()
        comma = F.when(F.struct(*order) == first, "").otherwise(",")
        value = F.concat(comma, F.to_json(F.struct(*[F.col(c).alias(k) for c, k in sorted(((c, keys[c]) for c in names), key=lambda x: list(keys).index(x[0]))])))
        n = found.where("protein <> 'UNMAPPED'").count()
        return framed('{"mappings" : [', rows.select(*cells, value.alias("value")), f'],\n"message" : "{n} mappings found",\n"status" : "OK"}}')
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in cells[1:]])))
    hit = F.max("protein") != "UNMAPPED"
    if kind == "text":
        shown = F.array_join(F.transform(listed, lambda x: F.concat(x["protein"], F.lit(","), x["position"].cast("string")) if positions else x["protein"]), " ")
        value = F.when(F.max("protein") == "UNMAPPED", F.concat(F.col("peptide"), F.lit(" NOT found!"))).otherwise(F.concat(F.col("peptide"), F.lit(" found at following proteins" + ",locations" * positions + ": "), shown))
    elif kind == "pepx":
        short = lambda p: F.regexp_replace(p if isoforms else F.regexp_replace(p, "-.*", ""), r".*\|(.*)\|.*", "$1")
        value = F.when(hit, F.concat(F.array_join(F.array_distinct(F.transform(listed, lambda x: short(x["protein"]))), ","), F.lit(" "), F.col("peptide"))).otherwise(F.concat(F.lit("NO_MATCH "), F.col("peptide")))
    else:
        raise ValueError(f"no report of kind {kind}")
    return rows.groupBy("peptide").agg(value.alias("value")).orderBy("peptide").select("value")

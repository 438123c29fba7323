"""Reading annotations, sequences and evidence, and writing them back."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.functions.scalars import attribute_map, extracted, once
from evimap.operators import genome

#: The order in which attributes name a gene: fixed patterns of the two formats.
GENE_PATTERNS = (r'gene_id\s*[= ]?"?([^";,\s]+)"?', r"GeneID=([^;,\s]+)", r'(?:^|;)\s*gene\s*[= ]?"?([^";,\s]+)"?')
MODEL_TYPES = ("mrna", "transcript", "gene")


def _id(attrs: Column, key: str) -> Column:
    return extracted(attrs, rf'{key}\s*[= ]?"?([^";,\s]+)"?')


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place, which sorts as the lines stand in the file, however it is split."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("place"))


def genome_tiles(spark: SparkSession, path: str) -> DataFrame:
    """seqid, tile, text: a FASTA file of long sequences, each id once, as tiles; read by lines, wherever the file is split."""
    lines = placed_lines(spark, path).select("value", F.struct("place.file_path", "place.file_block_start").alias("block"), F.col("place.n").alias("place"))
    return genome.tiles(genome.placed(lines))


def features(spark: SparkSession, path: str) -> DataFrame:
    """A GTF or GFF3 file as a feature table with gene and protein."""
    return feature_rows(placed_lines(spark, path))


def feature_rows(lines: DataFrame) -> DataFrame:
    """Lines (value, place) as a feature table with gene and protein; a # ends a line wherever it stands."""
    f = F.split(F.when(F.contains("value", F.lit("#")), F.regexp_replace("value", "#.*$", "")).otherwise(F.col("value")), "\t")
    rows = lines.withColumnRenamed("place", "line_no").select("*", once(f).alias("f")).where(F.size("f") >= 8)
    part = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    rows = rows.select(
        part(0).alias("seqid"), part(1).alias("source"), F.lower(part(2)).alias("type"), part(3).try_cast("long").alias("start"), part(4).try_cast("long").alias("end"),
        F.coalesce(part(5).try_cast("double"), F.lit(0.0)).alias("score"), part(6).alias("strand"), part(7).alias("frame"), part(8).alias("attrs"), "line_no",
    ).where(F.col("seqid").isNotNull() & F.col("type").isin(*MODEL_TYPES, "cds"))
    a, model = F.col("attrs"), F.col("type").isin(*MODEL_TYPES)
    gene = F.coalesce(*[extracted(a, p) for p in GENE_PATTERNS], F.when(F.col("type") != "gene", extracted(a, "Parent=([^;,\\s]+)")), F.when(F.col("type") == "gene", extracted(a, "ID=([^;,\\s]+)")), F.when(model, F.trim(a)))
    protein = F.when(model, F.coalesce(extracted(a, "ID=([^;,\\s]+)"), _id(a, "transcript_id"), F.trim(a))).otherwise(F.coalesce(_id(a, "protein_id"), _id(a, "transcript_id"), extracted(a, "Parent=([^;,\\s]+)")))
    return rows.withColumn("gene", gene).withColumn("protein", protein)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, header, sequence: one row per record."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("v", F.regexp_replace("value", r"^>|\r", ""))
    header = F.substring_index("v", "\n", 1)
    body = F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\\n', 1)) + 1)"), r"\s", "")
    return rows.select(F.regexp_extract(header, r"^\s*(\S+)", 1).alias("id"), header.alias("header"), body.alias("sequence")).where("id <> ''")


def mapping(spark: SparkSession, path: str, with_unmapped: bool = False) -> DataFrame:
    """peptide, protein, peptide_length from a three-column table with a header; several proteins in a cell are split."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="peptide string, protein string, location long", enforceSchema=True).select("peptide", "protein").distinct()
    rows = rows if with_unmapped else rows.where(F.lower(F.trim("protein")) != "unmapped")
    rows = rows.select("peptide", F.explode(F.split(F.trim("protein"), r"\s+")).alias("protein"))
    return rows.withColumn("peptide_length", F.length("peptide"))


CODES = "qry_id string, ref_id string, class_code string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def class_codes(spark: SparkSession, path: str) -> DataFrame:
    """qry_id, ref_id, class_code and what else a table with a header has; a missing or empty file, or one without these, gives no rows."""
    rows = spark.read.csv(path, sep="\t", header=True) if exists(spark, path) else None
    return rows if rows is not None and {"qry_id", "ref_id", "class_code"} <= set(rows.columns) else spark.createDataFrame([], CODES)


def bed12(spark: SparkSession, path: str) -> DataFrame:
    """seqid, start, end, name, strand, protein, blocks (from 1, closed).

    Comments (#), lines with fewer than six fields or without two numbers for their ends (a track line, say) are no rows. A
    line without block fields is one block; blocks that can't be read, or are not as many as their count says, are none.
    protein: of the first field from the seventh on that speaks of a protein or a parent, what follows its last = up to a ;."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    rows = rows.where("size(f) >= 6 and try_cast(get(f, 1) as bigint) is not null and try_cast(get(f, 2) as bigint) is not null")
    whole = "array(struct(bigint(get(f, 1)) + 1 as start, bigint(get(f, 2)) as end))"
    numbers = lambda i: f"transform(filter(split(get(f, {i}), ','), x -> trim(x) <> ''), x -> try_cast(x as bigint))"
    parts = f"zip_with({numbers(10)}, {numbers(11)}, (n, s) -> struct(bigint(get(f, 1)) + s + 1 as start, bigint(get(f, 1)) + s + n as end))"
    none = "cast(array() as array<struct<start:bigint,end:bigint>>)"
    counted = f"try_cast(trim(get(f, 9)) as int) <=> size({numbers(10)}) and try_cast(trim(get(f, 9)) as int) <=> size({numbers(11)})"
    blocks = f"case when size(f) < 12 then {whole} when not ({counted}) or exists({parts}, b -> b.start is null or b.end is null) then {none} else {parts} end"
    named = "get(filter(slice(f, 7, size(f)), x -> lower(x) like '%protein%' or lower(x) like '%parent%'), 0)"
    protein = f"if(size(f) > 6, substring_index(substring_index({named}, '=', -1), ';', 1), null)"
    return rows.select(
        F.get("f", F.lit(0)).alias("seqid"), (F.get("f", F.lit(1)).cast("long") + 1).alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"), F.get("f", F.lit(3)).alias("name"),
        F.get("f", F.lit(5)).alias("strand"), F.expr(protein).alias("protein"), F.expr(blocks).alias("blocks"),
    )


def _fields(lines: DataFrame) -> DataFrame:
    """Lines (value, place) of nine fields or more, comments left out: fields f, type in lower case, attributes as a map."""
    rows = lines.where(~F.col("value").startswith("#")).select("place", once(F.split("value", "\t")).alias("f")).where("size(f) >= 9")
    return rows.select("place", "f", F.lower(F.get("f", F.lit(2))).alias("type")).select("*", once(attribute_map(F.get("f", F.lit(8)))).alias("a"))


def _named(*keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at("a", F.lit(k)), F.lit("")) for k in keys])


def cds_segments(lines: DataFrame) -> DataFrame:
    """protein, gene, seqid, strand, start, end, place of the CDS lines (value, place): what compare.models() takes.

    A line's model is its Parent, else its transcript_id; its gene its gene_id, else its GeneID."""
    rows = _fields(lines).where("type = 'cds'").select(_named("Parent", "transcript_id").alias("protein"), _named("gene_id", "GeneID").alias("gene"), F.get("f", F.lit(0)).alias("seqid"), F.get("f", F.lit(6)).alias("strand"), F.get("f", F.lit(3)).try_cast("long").alias("start"), F.get("f", F.lit(4)).try_cast("long").alias("end"), "place")
    return rows.where("protein is not null and start is not null and end is not null")


def transcript_models(lines: DataFrame) -> DataFrame:
    """transcript, seqid, strand, score, gene, start, end, exons (sorted) from transcript, mRNA and exon lines (value, place).

    Of a transcript's lines the last one says sequence, strand, gene and score; without exons it is one exon from end to end."""
    rows = _fields(lines).where("type in ('transcript', 'mrna', 'exon')").withColumn("transcript", _named("transcript_id", "ID")).where("transcript is not null")
    rows = rows.select("transcript", "type", "place", F.coalesce(_named("gene_id", "gene", "Parent"), "transcript").alias("gene"), *[F.get("f", F.lit(i)).alias(c) for i, c in ((0, "seqid"), (6, "strand"))], F.nullif(F.get("f", F.lit(5)), F.lit("")).alias("score"), *[F.get("f", F.lit(i)).try_cast("long").alias(c) for i, c in ((3, "start"), (4, "end"))])
    last = [F.max_by(c, "place").alias(c) for c in ("seqid", "strand")] + [F.max_by("score", F.when(F.col("score").isNotNull(), F.col("place"))).alias("score"), F.max_by("gene", "place").alias("gene")]
    exon = F.when(F.col("type") == "exon", F.struct("start", "end"))
    found = rows.groupBy("transcript").agg(*last, F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(exon)).alias("exons"))
    return found.withColumn("exons", F.when(F.size("exons") > 0, F.col("exons")).otherwise(F.array(F.struct("start", "end"))))


def orfs(lines: DataFrame) -> DataFrame:
    """orf, transcript, source, score, parts (start, end, frame on the transcript, sorted) from lines (value, place) in transcript coordinates.

    mRNA lines name an ORF, CDS lines belong to their Parent, else protein_id, else transcript_id; a frame of . is 0."""
    rows = _fields(lines).where("type in ('mrna', 'transcript', 'cds')").withColumn("orf", F.when(F.col("type") == "cds", _named("Parent", "protein_id", "transcript_id")).otherwise(_named("ID", "transcript_id"))).where("orf is not null")
    rows = rows.select("orf", "place", F.get("f", F.lit(0)).alias("transcript"), F.get("f", F.lit(1)).alias("source"), F.nullif(F.get("f", F.lit(5)), F.lit("")).alias("score"), F.when(F.col("type") == "cds", F.expr("struct(try_cast(get(f, 3) as bigint) as start, try_cast(get(f, 4) as bigint) as end, if(get(f, 7) = '.', '0', get(f, 7)) as frame)")).alias("part"))
    return rows.groupBy("orf").agg(F.max_by("transcript", "place").alias("transcript"), F.min_by("source", "place").alias("source"), F.max_by("score", F.when(F.col("score").isNotNull(), F.col("place"))).alias("score"), F.sort_array(F.collect_list("part")).alias("parts"))


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines (value and others) with keep: comments, and rows of nine fields, not of a gene, on + or -, that name an id in either format."""
    f = F.split(F.rtrim("value"), "\t")
    attrs = F.get(f, F.lit(8))
    # k=v: the first part that begins with the key must have a value
    parts = F.transform(F.split(attrs, ";"), lambda p: F.trim(p))
    valued = lambda key: F.coalesce(F.get(F.filter(parts, lambda p: p.startswith(key)), F.lit(0)).rlike(rf"^{key}\s*\S"), F.lit(False))
    # k "v": the first such key must have one
    quoted = lambda key: F.coalesce(F.nullif(F.regexp_extract(attrs, rf'^.*?{key} "([^"]*)"', 1), F.lit("")).isNotNull(), F.lit(False))
    named = F.lit(False)
    for key in ("ID=", "transcript_id=", "protein_id=", "gene_id="):
        named = named | valued(key)
    for key in ("transcript_id", "gene_id", "protein_id"):
        named = named | quoted(key)
    row = (F.size(f) >= 9) & (F.get(f, F.lit(2)) != "gene") & F.get(f, F.lit(6)).isin("+", "-") & named
    return lines.withColumn("keep", F.col("value").startswith("#") | F.coalesce(row, F.lit(False)))


def removed_rows(cleaned_: DataFrame) -> DataFrame:
    """One row: how many lines cleaning removes."""
    return cleaned_.agg(F.count_if(~F.col("keep")).alias("removed"))


def peptide_list(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """peptide: one a line, trimmed, once."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select((F.upper(text) if upper else text).alias("peptide")).where("peptide <> ''").distinct()


def fasta_for_search(spark: SparkSession, path: str, least: int = 5, exclude: str | None = None) -> DataFrame:
    """id, sequence with I as L and variants (at, from 1, and residue), for the peptide lookup: without # lines, short and empty sequences, and ids that begin with exclude.

    Variants are what a header's VariantSimple lists: (12|V) or (12|V|name), one after the other."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("v", F.regexp_replace(F.regexp_replace("value", "(?m)^#.*$", ""), r"^\s*>|\r", ""))
    body = F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\\n', 1)) + 1)"), r"\s", "")
    listed = F.regexp_extract_all(F.regexp_extract(F.substring_index("v", "\n", 1), r"VariantSimple=(\S*)", 1), F.lit(r"\(\d+\|.[|)]"), F.lit(0))
    variant = lambda x: F.struct(F.regexp_extract(x, r"\((\d+)", 1).try_cast("int").alias("at"), F.translate(F.regexp_extract(x, r"\|(.)", 1), "I", "L").alias("residue"))
    rows = rows.select(F.regexp_extract("v", r"^\s*(\S+)", 1).alias("id"), F.translate(F.upper(body), "I", "L").alias("sequence"), F.transform(listed, variant).alias("variants")).where((F.col("id") != "") & (F.length("sequence") >= least))
    return rows.where(~F.col("id").startswith(exclude)) if exclude else rows


def external_scores(spark: SparkSession, path: str) -> DataFrame:
    """protein and external_score of a comma-separated file; lines before the first comma are a preamble.

    The header names a description and an external_score or in-frame_score, in any case. Lines of too many fields and
    blank ones go; a missing or unreadable score is null."""
    rows = placed_lines(spark, path).where("trim(value) <> ''")
    head = rows.where(F.col("value").contains(",")).orderBy("place").select("value", "place").first()
    names = [n.strip().lower() for n in next(csv.reader([head.value]))] if head else []
    score = next((n for n in ("external_score", "in-frame_score") if n in names), None)
    if "description" not in names or score is None:
        raise ValueError(f"{path}: no columns for protein and score among {names}")
    start = F.struct(F.lit(head.place.file_path).alias("file_path"), F.lit(head.place.file_block_start).alias("file_block_start"), F.lit(head.place.n).alias("n"))
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    rows = rows.where(F.col("place") > start).select(F.from_csv("value", schema).alias("r")).where(F.col(f"r.c{len(names)}").isNull())
    return rows.select(F.trim(f"r.c{names.index('description')}").alias("protein"), F.col(f"r.c{names.index(score)}").try_cast("double").alias("external_score"))


def pepxml_peptides(spark: SparkSession, path: str) -> DataFrame:
    """peptide: each best-ranked search hit's, once. A hit without a rank, or of rank 0, counts as ranked first."""
    tags = spark.read.text(path, lineSep=">").where(F.col("value").rlike(r"<search_hit\s"))
    attribute = lambda name: extracted(F.col("value"), rf"""\s{name}\s*=\s*["']([^"']*)["']""")
    hits = tags.select(attribute("peptide").alias("peptide"), F.coalesce(F.nullif(attribute("hit_rank").try_cast("int"), F.lit(0)), F.lit(1)).alias("rank"))
    return hits.where("rank = 1 and peptide is not null").select("peptide").distinct()


def write_gtf(rows: DataFrame, path: str) -> None:
    """A feature table as lines, attributes as they were."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attrs")]
    rows.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """id and sequence as records, sequences wrapped."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped).alias("value")).write.text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    """BED12 rows, sorted by place, after a track line."""
    head = rows.sparkSession.createDataFrame([('track name=Peptides description="Mapped Peptides" itemRgb="On"',)], "value string").withColumn("_part", F.lit(0))
    body = rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"), F.lit(1).alias("_part"), "chrom", "chrom_start", "name")
    body.unionByName(head, allowMissingColumns=True).orderBy("_part", "chrom", "chrom_start", "name").select("value").write.text(path)

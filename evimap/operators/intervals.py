"""Interval operators: cumulative coordinates, union coverage, clusters, containment, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.scalars import rounded


def _along(key: str) -> Window:
    """Segments of a model in reading order: ascending on +, descending otherwise."""
    sign = F.when(F.col("strand") == "+", 1).otherwise(-1)
    return Window.partitionBy(key).orderBy(sign * F.col("start"), sign * F.col("end"))


def codon_coordinates(segments: DataFrame, key: str = "protein") -> DataFrame:
    """Adds cds_len, cds_start, cds_end (whole codons, counted along the model) and splice_sites."""
    length = ((F.col("end") - F.col("start") + 1) / 3).cast("long")
    out = segments.withColumn("cds_len", length)
    out = out.withColumn("cds_end", F.sum("cds_len").over(_along(key).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("cds_start", F.col("cds_end") - F.col("cds_len") + 1).withColumn("splice_sites", F.count(F.lit(1)).over(Window.partitionBy(key)) - 1)


def exon_offsets(exons: DataFrame, key: str = "transcript") -> DataFrame:
    """Adds tx_start and tx_end: where an exon lies on its transcript, from 1."""
    out = exons.withColumn("tx_end", F.sum(F.col("end") - F.col("start") + 1).over(_along(key).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("tx_start", F.col("tx_end") - (F.col("end") - F.col("start")))


def covered(key: str, start: str, end: str) -> Column:
    """What a closed interval adds to the union of those before it, by start, within its key; an invalid one adds nothing."""
    order = Window.partitionBy(key).orderBy(start, end)
    valid = f"coalesce({start}, 0) > 0 and coalesce({end}, 0) >= {start}"
    reach = F.max(F.expr(f"if({valid}, {end}, null)")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    more = F.col(end) - F.greatest(F.col(start) - 1, F.coalesce(reach, F.lit(0)))
    return F.when(F.expr(valid), F.greatest(more, F.lit(0))).otherwise(0)


def union_coverage(intervals: DataFrame, key: str = "protein", start: str = "pep_start", end: str = "pep_end", length: str = "prot_len") -> DataFrame:
    """key, coverage: the share of the length that closed intervals cover, to 4 places; 0 where none is valid."""
    each = intervals.select(key, F.when(F.col(length) > 0, F.col(length)).alias("_len"), covered(key, start, end).alias("_n"))
    return each.groupBy(key).agg(F.coalesce(rounded(F.sum("_n") / F.max("_len"), 4), F.lit(0.0)).alias("coverage"))


def clusters(loci: DataFrame, keys: list[str], branch: str = "branch", stretches: int = 1024) -> DataFrame:
    """One row per run of overlapping loci: keys, start, end, n, label (the branches in it).

    Few keys have most of the loci, so each key is cut into stretches of the coordinate. A locus begins a run if its
    start is beyond the reach of all loci before it: of those in its stretch, from a window over the stretch, and of the
    earlier stretches, of which only the reach and the number of runs are handed on."""
    span = loci.agg(F.min("start").alias("lo"), F.max("start").alias("hi")).select(F.struct("lo", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / stretches)).alias("width")).alias("s"))
    rows = loci.withColumn("_s", span.scalar()).withColumn("_stretch", F.floor((F.col("start") - F.col("_s.lo")) / F.col("_s.width"))).drop("_s")
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*keys, "_stretch").agg(F.max("end").alias("_end")).withColumn("_carried", F.max("_end").over(before)).drop("_end")
    order = Window.partitionBy(*keys, "_stretch").orderBy("start", "end")
    own = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(reach, [*keys, "_stretch"])
    new = F.when(F.col("start") <= F.coalesce(F.greatest(own, F.col("_carried")), F.col("start") - 1), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_nth", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_stretch", "_nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min(branch).alias("_lo"), F.max(branch).alias("_hi"))
    counts = runs.groupBy(*keys, "_stretch").agg(F.max("_nth").alias("_runs")).withColumn("_first", F.coalesce(F.sum("_runs").over(before), F.lit(0))).drop("_runs")
    runs = runs.join(counts, [*keys, "_stretch"]).groupBy(*keys, (F.col("_first") + F.col("_nth")).alias("_run"))
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return runs.withColumn("label", F.when(F.col("_lo") == F.col("_hi"), F.concat(F.col("_lo"), F.lit("-only"))).otherwise("shared")).select(*keys, "start", "end", "n", "label")


def contained(inner: DataFrame, outer: DataFrame, key: str = "protein") -> DataFrame:
    """Rows of inner whose codon interval lies within one of outer's of the same key."""
    o = outer.select(F.col(key).alias("_key"), F.col("cds_start").alias("_s"), F.col("cds_end").alias("_e")).distinct()
    return inner.join(o, (F.col(key) == F.col("_key")) & (F.col("_s") <= F.col("pep_start")) & (F.col("_e") >= F.col("pep_end")), "left_semi")


def extended(segments: DataFrame, peptides: DataFrame, key: str = "protein") -> DataFrame:
    """Peptides joined with the segments they touch; a peptide beyond the last codon stretches that segment by the codons it lacks."""
    last = Window.partitionBy(key)
    s = segments.withColumn("_last", F.max("cds_end").over(last))
    more = F.greatest(F.col("pep_end") - F.col("_last"), F.lit(0))
    joined = peptides.join(s, key).withColumn("_more", F.when(F.col("cds_end") == F.col("_last"), more).otherwise(0))
    plus = F.col("strand") == "+"
    joined = joined.withColumn("end", F.when(plus, F.col("end") + 3 * F.col("_more")).otherwise(F.col("end"))).withColumn("start", F.when(plus, F.col("start")).otherwise(F.col("start") - 3 * F.col("_more"))).withColumn("cds_end", F.col("cds_end") + F.col("_more"))
    return joined.where("pep_end >= cds_start and pep_start <= cds_end").drop("_last", "_more")


def project_codons(segments: DataFrame, peptides: DataFrame, key: str = "protein") -> DataFrame:
    """Adds genome_start and genome_end: the clipped codon overlap of each peptide and segment on the genome."""
    j = extended(segments, peptides, key).withColumn("_os", F.greatest("pep_start", "cds_start")).withColumn("_oe", F.least("pep_end", "cds_end"))
    a, b = (F.col("_os") - F.col("cds_start")) * 3, (F.col("_oe") - F.col("cds_start") + 1) * 3 - 1
    plus = F.col("strand") == "+"
    return j.withColumn("genome_start", F.when(plus, F.col("start") + a).otherwise(F.col("end") - b)).withColumn("genome_end", F.when(plus, F.col("start") + b).otherwise(F.col("end") - a)).drop("_os", "_oe")


def project_transcript(exons: DataFrame, features: DataFrame, key: str = "transcript") -> DataFrame:
    """features (key, f_start, f_end on the transcript) on the genome, one row per exon they touch."""
    j = features.join(exon_offsets(exons, key), key).where("f_end >= tx_start and f_start <= tx_end")
    a, b = F.greatest("f_start", "tx_start") - F.col("tx_start"), F.least("f_end", "tx_end") - F.col("tx_start")
    plus = F.col("strand") == "+"
    return j.withColumn("genome_start", F.when(plus, F.col("start") + a).otherwise(F.col("end") - b)).withColumn("genome_end", F.when(plus, F.col("start") + b).otherwise(F.col("end") - a))


def junctions(segments: DataFrame, key: str = "protein") -> DataFrame:
    """key, donor, acceptor: end of a segment and start of the next one on the genome."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return segments.withColumn("acceptor", F.lead("start").over(order)).where("acceptor is not null").select(key, F.col("end").alias("donor"), "acceptor")


def peptide_type() -> Column:
    """Of a located peptide with its blocks b: spliced, N-terminal, C-terminal or internal, the first that holds."""
    return F.when(F.size("b") > 1, "spliced").when(F.col("pep_start") == 1, "n_terminal").when(F.col("pep_end") == F.col("prot_len"), "c_terminal").otherwise("internal")


#: Colours of the types: fixed values of the format.
COLOURS = {"spliced": "255,0,0", "n_terminal": "0,255,0", "c_terminal": "0,0,255", "internal": "153,153,153"}


def located(projected: DataFrame, name: str = "peptide", key: str = "protein") -> DataFrame:
    """One row per located peptide and model with its blocks b (structs s, e), equal locations once, and its type."""
    blocks = projected.groupBy(key, name, "seqid", "strand", "pep_start", "pep_end", "prot_len").agg(F.sort_array(F.collect_list(F.struct(F.col("genome_start").alias("s"), F.col("genome_end").alias("e")))).alias("b"))
    blocks = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("seqid", "strand", name, "b").orderBy(key))).where("_n = 1").drop("_n")
    return blocks.withColumn("type", peptide_type())


def bed12(projected: DataFrame, name: str = "peptide", key: str = "protein") -> DataFrame:
    """BED12 rows, one per located peptide and model, equal locations once."""
    low, high = F.col("b")[0]["s"] - 1, F.array_max(F.transform("b", lambda x: x["e"]))
    sizes = F.array_join(F.transform("b", lambda x: (x["e"] - x["s"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("b", lambda x: (x["s"] - 1 - low).cast("string")), ",")
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("type"))
    return located(projected, name, key).select(
        F.col("seqid").alias("chrom"), low.alias("chrom_start"), high.alias("chrom_end"),
        F.when(F.col("strand") == "-", F.reverse(F.col(name))).otherwise(F.col(name)).alias("name"),
        F.lit(0).alias("score"), "strand", low.alias("thick_start"), high.alias("thick_end"), colour.alias("rgb"),
        F.size("b").alias("block_count"), sizes.alias("block_sizes"), starts.alias("block_starts"),
    )


def project_orfs(orfs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The transcript and CDS rows of ORFs on the genome: a feature table with gene and protein.

    orfs: orf, transcript, parts (structs start, end, frame on the transcript); transcripts: transcript, seqid, strand,
    score, gene, start, end, exons. ORFs without parts or of an unknown transcript go."""
    orfs = orfs.select("orf", "transcript", "parts").where("size(parts) > 0")
    j = orfs.join(transcripts, "transcript")
    whole = j.select("orf", "gene", "seqid", F.lit("transcript").alias("type"), "start", "end", "score", "strand", F.lit(".").alias("frame"))
    exons = transcripts.select("transcript", "seqid", "strand", F.explode("exons").alias("x")).select("transcript", "strand", "x.start", "x.end")
    parts = orfs.select("orf", "transcript", F.explode("parts").alias("p")).select("orf", "transcript", F.col("p.start").alias("f_start"), F.col("p.end").alias("f_end"), "p.frame")
    placed = project_transcript(exons, parts).select("orf", "genome_start", "genome_end", "frame")
    facts = transcripts.select("transcript", "gene", "seqid", "score", "strand").join(orfs.select("orf", "transcript"), "transcript")
    coding = placed.join(facts, "orf").select("orf", "gene", "seqid", F.lit("CDS").alias("type"), F.col("genome_start").alias("start"), F.col("genome_end").alias("end"), "score", "strand", "frame")
    return whole.unionByName(coding).withColumnRenamed("orf", "protein")

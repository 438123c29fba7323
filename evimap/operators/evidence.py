"""Peptide evidence: specificity, features, confidence rules, support, score cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.scalars import residues, rounded
from evimap.operators.intervals import codon_coordinates, covered


def specificity(mapping: DataFrame) -> DataFrame:
    """mapping (peptide, protein, gene and others) with protein_specific and gene_specific, + where a peptide has one only.

    One is what smallest and largest agree on, so nothing distinct has to be counted."""
    rows = mapping.na.drop(subset=["peptide", "protein", "gene"]).distinct()
    per = rows.groupBy("peptide").agg(*[f(c).alias(f"_{n}_{c}") for c in ("protein", "gene") for n, f in (("lo", F.min), ("hi", F.max))])
    flag = lambda c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), "+").otherwise("-")
    return rows.join(per, "peptide").select(*mapping.columns, flag("protein").alias("protein_specific"), flag("gene").alias("gene_specific"))


def locate(mapping: DataFrame, proteins: DataFrame) -> DataFrame:
    """Adds pep_start, pep_end (first occurrence with I as L; 0 if none), prot_len, n_terminal and c_terminal."""
    j = mapping.join(proteins.select("protein", residues(F.col("sequence")).alias("_seq")), "protein")
    start = F.expr("instr(_seq, translate(peptide, 'I', 'L'))")
    j = j.withColumn("pep_start", start).withColumn("pep_end", F.when(start > 0, start + F.length("peptide") - 1).otherwise(0)).withColumn("prot_len", F.length("_seq"))
    n_term = (F.col("pep_start") == 1) | ((F.col("pep_start") == 2) & F.col("_seq").startswith("M"))
    return j.withColumn("n_terminal", n_term).withColumn("c_terminal", F.col("pep_end") == F.col("prot_len")).drop("_seq")


def flagged(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Located peptides (protein, pep_start, pep_end, prot_len and others) of models with segments, with their model's
    coverage and splice_sites, and spliced: within no one segment."""
    span = F.struct(F.col("cds_start").alias("a"), F.col("cds_end").alias("b"))
    spans = codon_coordinates(segments.select("protein", "strand", "start", "end")).groupBy("protein").agg(F.collect_list(span).alias("_spans"), (F.count(F.lit(1)) - 1).alias("splice_sites"))
    rows = rows.withColumn("_n", covered("protein", "pep_start", "pep_end"))
    rows = rows.withColumn("coverage", F.coalesce(rounded(F.sum("_n").over(Window.partitionBy("protein")) / F.nullif("prot_len", F.lit(0)), 4), F.lit(0.0))).drop("_n")
    inside = F.exists("_spans", lambda s: (s["a"] <= F.col("pep_start")) & (s["b"] >= F.col("pep_end")))
    return rows.join(spans, "protein").withColumn("spliced", ~inside).drop("_spans")


def peptide_rows(segments: DataFrame, mapping: DataFrame, sequences: DataFrame, facts: DataFrame) -> DataFrame:
    """What features() takes: each mapped peptide of a model with a gene and a sequence, with its flags and the model's facts.

    segments: CDS; mapping: peptide, protein; sequences: id, sequence; facts: model_facts(). A peptide that isn't found
    in its protein keeps place 0."""
    genes = segments.select("protein", "gene").distinct()
    rows = specificity(mapping.select("peptide", "protein").join(genes, "protein"))
    located = locate(rows, sequences.select(F.col("id").alias("protein"), "sequence")).repartition("protein")
    return flagged(located, segments.select("protein", "strand", "start", "end").distinct()).drop("splice_sites").join(facts, "protein")


#: Measures that a model without peptides has at 0.
MEASURES = ("sequence_coverage", "mapped_peptides", "n_terminal_peptides", "c_terminal_peptides", "protein_specific_peptides", "gene_specific_peptides", "splice_peptides", "internal_peptides")


def features(rows: DataFrame) -> DataFrame:
    """One row per protein from peptide rows with flags: the measures that the rules and the classifier use."""
    is_ = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long")
    return rows.groupBy("protein").agg(
        F.max("prot_len").cast("long").alias("protein_length"),
        F.max("splice_sites").cast("long").alias("splice_sites"),
        *[F.avg(c).alias(c) for c in ("isoforms", "transcript_score") if c in rows.columns],
        rounded(F.avg("coverage"), 2).alias("sequence_coverage"),
        F.countDistinct("peptide").alias("mapped_peptides"),
        is_("n_terminal").alias("n_terminal_peptides"),
        is_("c_terminal").alias("c_terminal_peptides"),
        F.sum(F.when(F.col("protein_specific") == "+", 1).otherwise(0)).cast("long").alias("protein_specific_peptides"),
        F.sum(F.when(F.col("gene_specific") == "+", 1).otherwise(0)).cast("long").alias("gene_specific_peptides"),
        is_("spliced").alias("splice_peptides"),
        F.sum(F.when(F.col("spliced"), 0).otherwise(1)).cast("long").alias("internal_peptides"),
    )


def transcript_scores(rows: DataFrame) -> DataFrame:
    """protein and transcript_score of the transcript rows of a feature table."""
    return rows.where(F.col("type").isin("transcript", "mrna")).select("protein", F.col("score").alias("transcript_score"))


def model_facts(segments: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row per model and, where a model has several, transcript score: protein, isoforms (of its gene), splice_sites, low and high (its extent), transcript_score.

    A model without a transcript row has no score."""
    isoforms = segments.groupBy("gene").agg(F.countDistinct("protein").alias("isoforms"))
    sites = segments.select("seqid", "protein", "start", "end").distinct().groupBy("protein").agg((F.count(F.lit(1)) - 1).alias("splice_sites"), F.min("start").alias("low"), F.max("end").alias("high"))
    facts = segments.select("protein", "gene").distinct().join(isoforms, "gene").join(sites, "protein")
    facts = facts.join(scores.distinct(), "protein", "left") if scores is not None else facts.withColumn("transcript_score", F.lit(None).cast("double"))
    return facts.select("protein", "isoforms", "splice_sites", "low", "high", "transcript_score").distinct()


def with_unmatched(found: DataFrame, facts: DataFrame, lengths: DataFrame) -> DataFrame:
    """features() and, at 0, the models that no peptide is mapped to but that have a sequence (lengths: protein, protein_length)."""
    # one join, so that found is computed once: a model's own measures where it has any, else what is known of it
    known = facts.select("protein", *[F.col(c).alias(f"_{c}") for c in facts.columns if c != "protein"]).join(lengths.select("protein", F.col("protein_length").alias("_protein_length")), "protein", "left")
    all_ = known.join(found.withColumn("_found", F.lit(True)), "protein", "left").where("_found or _protein_length is not null")
    value = lambda c, t: F.lit(0).cast(t) if c in MEASURES else F.col(f"_{c}").cast(t) if f"_{c}" in known.columns else F.lit(None).cast(t)
    return all_.select("protein", *[F.when(F.col("_found"), F.col(c)).otherwise(value(c, t)).alias(c) for c, t in found.dtypes if c != "protein"]).distinct()


def with_external_scores(f: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Adds external_score (0 where a protein has none) and puts 0 for every missing number."""
    f = f.drop("external_score")
    out = f.withColumn("external_score", F.lit(0.0)) if scores is None else f.join(scores.select("protein", "external_score"), "protein", "left")
    return out.na.fill(0)


def partitions(f: DataFrame) -> DataFrame:
    """bar, supported, partial, unsupported: how many proteins have each kind of evidence."""
    yes = lambda e: F.count_if(F.expr(e))
    every, some = "splice_sites > 0 and splice_peptides >= splice_sites", "splice_sites > 0 and splice_peptides > 0 and splice_peptides < splice_sites"
    n = f.agg(F.count(F.lit(1)).alias("n"), *[yes(f"{c} > 0").alias(c) for c in ("mapped_peptides", "n_terminal_peptides", "c_terminal_peptides")], yes(every).alias("every"), yes(some).alias("some"))
    return n.select(
        F.expr(
            """stack(4, 'mapped_peptides', mapped_peptides, 0L, n - mapped_peptides, 'n_terminal_support', n_terminal_peptides, 0L, n - n_terminal_peptides,
                 'c_terminal_support', c_terminal_peptides, 0L, n - c_terminal_peptides, 'splice_site_support', every, some, n - every - some) as (bar, supported, partial, unsupported)"""
        )
    )


def engineered(f: DataFrame) -> DataFrame:
    """Rates and flags on top of features()."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    flag = lambda e: F.expr(f"cast({e} as int)")
    out = f.withColumns({
        "mapped_peptides_per_aa": per("mapped_peptides", "protein_length"),
        "protein_specific_rate": per("protein_specific_peptides", "mapped_peptides"),
        "gene_specific_rate": per("gene_specific_peptides", "mapped_peptides"),
        "splice_rate": per("splice_peptides", "mapped_peptides"),
        "internal_rate": per("internal_peptides", "mapped_peptides"),
        "terminal_rate": (F.col("n_terminal_peptides") + F.col("c_terminal_peptides")) / F.greatest(F.col("mapped_peptides"), F.lit(1)),
        "junction_evidence": per("splice_peptides", "internal_peptides"),
        "has_n_term": flag("n_terminal_peptides > 0"),
        "has_c_term": flag("c_terminal_peptides > 0"),
        "has_both_term": flag("n_terminal_peptides > 0 and c_terminal_peptides > 0"),
        "has_any_protein_specific": flag("protein_specific_peptides > 0"),
        "has_any_splice": flag("splice_peptides > 0"),
    })
    return out.withColumn("isoform_specificity", F.col("protein_specific_rate") - F.col("gene_specific_rate"))


#: Confidence rules: fixed values of the method.
HIGH = """protein_specific_peptides >= 2 or sequence_coverage >= 0.8
    or (n_terminal_peptides >= 1 and c_terminal_peptides >= 1 and gene_specific_peptides > 0)
    or (splice_peptides = splice_sites and splice_peptides > 0 and gene_specific_peptides > 0)"""
LOW = "mapped_peptides < 2 and gene_specific_peptides = 0 and (protein_length < 200 or protein_length > 500)"


def confidence(f: DataFrame) -> DataFrame:
    """Adds high and low."""
    return f.withColumn("high", F.expr(HIGH)).withColumn("low", F.expr(LOW))


def support(f: DataFrame, positive: str = "positive", scored: str = "score_supported") -> DataFrame:
    """Adds supported and confidence: high, or unlabelled and positive, or supported by its score."""
    on = F.col("high") | (~F.col("high") & ~F.col("low") & F.col(positive)) | F.col(scored)
    level = F.when(F.col("high"), "high").when(on, "moderate").otherwise("no-support")
    return f.withColumn("supported", F.when(on, "+").otherwise("-")).withColumn("confidence", level)


def in_order(f: DataFrame) -> DataFrame:
    """The score table as it is written: protein, supported, confidence, the rest; supported ones first."""
    first = ["protein", "supported", "confidence"]
    place = F.when(F.col("supported") == "+", 0).when(F.col("supported") == "-", 1).otherwise(2)
    return f.select(*first, *[c for c in f.columns if c not in first]).orderBy(place, "confidence", F.desc("mapped_peptides"), "protein")


def roc(scores: DataFrame, high: str = "high", score: str = "score", cutoffs: int = 1000) -> DataFrame:
    """i, cutoff, tpr, fpr, n_high, top: for cutoffs from 1 down to 0, the shares of high and of other scores at or above.

    Scores are binned by the first cutoff they reach, so the table is summed once and then runs over cutoffs only.
    Others are those whose value no high row has. A missing score is no score. n_high and top are the number of high
    scores and the largest absolute score of all."""
    values = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(high)).alias("_h"), F.count(F.lit(1)).alias("_o"))
    both = values.withColumn("_o", F.when(F.col("_h") > 0, 0).otherwise(F.col("_o")))
    n = cutoffs - 1
    guess = F.ceil((1.0 - F.col(score)) * n).cast("int")
    at = F.expr(f"case when {score} >= 1.0 - (_g - 1) / {n}.0D then _g - 1 when {score} >= 1.0 - _g / {n}.0D then _g else _g + 1 end")
    binned = both.withColumn("_g", guess).withColumn("i", F.greatest(F.lit(0), at)).groupBy("i").agg(F.sum("_h").alias("_h"), F.sum("_o").alias("_o"), F.max(F.abs(score)).alias("_top"))
    below = binned.where(f"i > {n}").select(F.lit(cutoffs).alias("i"), "_h", "_o", "_top")  # under every cutoff, still in the totals
    binned = binned.where(f"i <= {n}").unionByName(below).groupBy("i").agg(F.sum("_h").alias("_h"), F.sum("_o").alias("_o"), F.max("_top").alias("_top"))
    grid = scores.sparkSession.range(cutoffs + 1).select(F.col("id").cast("int").alias("i"))
    order, whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    joined = grid.join(binned, "i", "left").na.fill(0, ["_h", "_o"])
    total = joined.select("i", F.sum("_h").over(order).alias("_ch"), F.sum("_o").over(order).alias("_co"), F.sum("_h").over(whole).alias("_th"), F.sum("_o").over(whole).alias("_to"), F.max("_top").over(whole).alias("top"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return total.where(f"i <= {n}").select("i", (1.0 - F.col("i") / float(n)).alias("cutoff"), rate("_ch", "_th").alias("tpr"), rate("_co", "_to").alias("fpr"), F.col("_th").alias("n_high"), F.coalesce("top", F.lit(0.0)).alias("top"))


def cutoff(roc_: DataFrame) -> DataFrame:
    """One row: cutoff and youden. 0 where there is no high score or all scores are 0; else Youden's best cutoff if its
    index is over 0.2, else the elbow (slope below 1 from the third point), else 0."""
    order = Window.orderBy("fpr", "i")
    p = roc_.withColumn("nth", F.row_number().over(order) - 1).withColumn("j", F.col("tpr") + (1 - F.col("fpr")) - 1)
    d_fpr = F.col("fpr") - F.lag("fpr").over(order)
    p = p.withColumn("slope", F.when(d_fpr != 0, (F.col("tpr") - F.lag("tpr").over(order)) / d_fpr))
    best = F.max(F.struct(F.col("j"), (-F.col("nth")).alias("n"), F.col("cutoff").alias("c")))
    elbow = F.min(F.when((F.col("nth") >= 2) & (F.col("slope") < 1), F.struct(F.col("nth"), F.col("cutoff").alias("c"))))
    found = F.when((F.col("h") == 0) | (F.col("t") == 0), 0.0).when(F.col("b.j") > 0.2, F.col("b.c")).otherwise(F.coalesce(F.col("e.c"), F.lit(0.0)))
    return p.agg(best.alias("b"), elbow.alias("e"), F.max("n_high").alias("h"), F.max("top").alias("t")).select(found.alias("cutoff"), F.col("b.j").alias("youden"))


def score_filter(scores: DataFrame, high: str = "high", score: str = "score", least: float = 0.5) -> DataFrame:
    """Adds cutoff and score_supported: whether the score is above the ROC's cutoff, which is at least so much."""
    at = cutoff(roc(scores, high, score)).select(F.greatest("cutoff", F.lit(least)).alias("cutoff"))
    return scores.withColumn("cutoff", at.scalar()).withColumn("score_supported", F.coalesce(F.col(score) > F.col("cutoff"), F.lit(False)))

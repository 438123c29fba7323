"""From files to files: one branch of gene models against peptides, and two branches against each other.

    python -m evimap.run --gtf models.gff --proteins models.fa --peptides peptides.txt --output out

Assembling transcripts, finding ORFs and assigning class codes are other tools' work: their files are taken as they are.
Tables are written as folders of part files.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.functions.tables import written
from evimap.operators import charts, compare, evidence, genome, intervals, learning, overlap, search, selection
from evimap.sources import annotations, reports

log = logging.getLogger("evimap")


def label(f: DataFrame, with_scores: bool, model: str | None = None, iterative: bool = False, grid: str | None = None) -> DataFrame:
    """A score table with engineered features, rules, classification and support. Where a classifier can be neither
    loaded nor trained (for want of high or low models), none is positive."""
    rows = written(evidence.confidence(evidence.engineered(f)))
    try:
        scored, _, how = learning.classify(rows, model, iterative, grid=grid)
        log.info("classifier: %s", how)
        rows = written(scored.drop("label", "probability"))
    except ValueError as e:
        log.warning("no classifier: %s", e)
        rows = rows.withColumn("positive", F.lit(False))
    rows = evidence.score_filter(rows, "high", "external_score") if with_scores else rows.withColumn("score_supported", F.lit(False))
    return evidence.support(rows).drop("positive", "score_supported", "cutoff")


def run_branch(
    spark: SparkSession,
    gtf: str,
    output: str,
    proteins: str | None = None,
    assembly: str | None = None,
    peptides: str | None = None,
    mapping: str | None = None,
    scores: str | None = None,
    reference_gtf: str | None = None,
    reference_fasta: str | None = None,
    codes: str | None = None,
    model: str | None = None,
    iterative: bool = False,
    grid: str | None = None,
) -> dict[str, DataFrame]:
    """Writes scores, id lists, supported models and located peptides of one annotation to output and, with a reference,
    what is new and what differs. Without class codes they are assigned here. grid: "default" searches the classifier's
    parameters by cross-validation. Returns the tables by name."""
    rows = written(annotations.features(spark, gtf))
    cds = rows.where("type = 'cds'")
    if proteins:
        sequences = annotations.fasta(spark, proteins)
    else:
        sequences = genome.translated(cds, annotations.genome_tiles(spark, assembly)).select(F.col("protein").alias("id"), "sequence")
    if mapping:
        reports.write_ids(reports.unmapped(annotations.mapping(spark, mapping, with_unmapped=True)), f"{output}/unmapped_peptides", "peptide")
        found = annotations.mapping(spark, mapping)
    else:
        if proteins:  # with the variants that headers list
            searched = written(annotations.fasta_for_search(spark, proteins))
            looked = written(search.variant_lookup(annotations.peptide_list(spark, peptides), searched).select("peptide", "protein", "position").distinct())
        else:
            looked = search.lookup(annotations.peptide_list(spark, peptides), written(sequences.select("id", "sequence")))
        reports.lookup_report(looked).write.mode("overwrite").text(f"{output}/mapping")
        reports.write_ids(reports.unmapped(looked), f"{output}/unmapped_peptides", "peptide")
        found = looked.where("protein <> 'UNMAPPED'").select("peptide", "protein").distinct()
    facts = written(evidence.model_facts(cds, evidence.transcript_scores(rows)).drop("low", "high"))
    measured = written(evidence.peptide_rows(cds, found, sequences, facts))
    if measured.isEmpty():
        raise ValueError("no peptide could be mapped to a protein: the ids in the mapping must be the sequences'")
    lengths = sequences.select(F.col("id").alias("protein"), F.length(F.translate("sequence", "*", "")).cast("long").alias("protein_length"))
    external = annotations.external_scores(spark, scores) if scores else None
    f = evidence.with_external_scores(evidence.with_unmatched(evidence.features(measured), facts, lengths), external)
    labelled = written(label(f, bool(scores), model, iterative, grid))
    reports.write_scores(labelled.drop("high", "low"), f"{output}/all_proteins_scores")
    reports.write_id_lists(labelled, f"{output}/lists")
    supported = labelled.where("supported = '+'").select(F.col("protein").alias("id"))
    lines = selection.resolved(annotations.placed_lines(spark, gtf))
    kept = written(lines.join(supported.withColumnRenamed("id", "protein"), "protein", "left_semi"))
    reports.write_lines(kept, f"{output}/supported_proteins_gtf")
    fasta = sequences.select("id", "sequence").join(supported, "id", "left_semi")
    annotations.write_fasta(fasta, f"{output}/supported_proteins_fa")
    at = measured.where("pep_start > 0").select("protein", "peptide", "pep_start", "pep_end", "prot_len").distinct()
    coded = intervals.codon_coordinates(cds.select("protein", "seqid", "strand", "start", "end").distinct())
    projected = written(intervals.project_codons(coded, at))
    annotations.write_bed(intervals.bed12(projected), f"{output}/peptides_mapped_bed")
    located = written(intervals.located(projected))
    for name, chart in (("evidence", charts.evidence_bars(labelled)), ("partitions", evidence.partitions(labelled)), ("coverage", charts.coverage_histogram(labelled)), ("scores", charts.score_histogram(labelled)), ("peptide_types", charts.type_counts(located))):
        reports.write_table(chart, f"{output}/figures/{name}")
    out = {"scores": labelled, "features": rows, "sequences": fasta, "supported": supported, "located": located, "lines": kept}
    if reference_gtf:
        out |= _against_reference(spark, out, reference_gtf, reference_fasta, codes, f"{output}/compare_to_reference")
    return out


def _against_reference(spark: SparkSession, branch: dict[str, DataFrame], reference_gtf: str, reference_fasta: str | None, codes: str | None, output: str) -> dict[str, DataFrame]:
    cleaned = written(annotations.cleaned(annotations.placed_lines(spark, reference_gtf)))
    log.info("%d rows of the reference removed", annotations.removed_rows(cleaned).first().removed)
    reference = cleaned.where("keep")
    reports.write_lines(reference, f"{output}/reference_cleaned")
    segments = annotations.cds_segments
    predicted = compare.models(segments(branch["lines"]), place="place")
    known_models = compare.models(segments(reference), place="place")
    table = written(_codes(spark, codes, predicted, known_models))
    if not codes:
        reports.write_table(table, f"{output}/class_codes")
    known = annotations.fasta(spark, reference_fasta).select("id", "sequence") if reference_fasta else branch["sequences"].limit(0)
    novel = reports.novel(table, branch["features"].select("seqid", "source", "type", "start", "end", "score", "strand", "frame", "attrs", "gene", "protein"), branch["sequences"], branch["scores"].drop("high", "low"), known)
    reports.write_novel(novel, f"{output}/novel")
    report = written(compare.evidence_report(table, branch["scores"], predicted, known_models, branch["located"]))
    summary = compare.category_summary(report, "peptide_evidence_category", "predicted_id")
    reports.write_comparison(report, summary, branch["lines"], branch["sequences"], output)
    reports.write_table(charts.difference_counts(novel["scores"], summary.withColumnRenamed("peptide_evidence_category", "category")), f"{output}/figures/differences")
    return {"report": report, "novel": novel["features"]}


def _codes(spark: SparkSession, path: str | None, models: DataFrame, reference: DataFrame) -> DataFrame:
    """qry_id, ref_id, class_code from a file, or from the models' coding exons."""
    if path:
        return annotations.class_codes(spark, path).select("qry_id", "ref_id", "class_code")
    exons = lambda df: df.select(F.col("protein").alias("id"), "seqid", "strand", F.col("regions").alias("exons"))
    return overlap.class_codes(exons(models), exons(reference))


def compare_branches(spark: SparkSession, prediction: dict[str, DataFrame], assembly: dict[str, DataFrame], codes: str | None, reverse: str | None, output: str) -> None:
    """Writes what two branches, as run_branch() returns them, have in common. codes: of the assembly's models against the
    prediction's; reverse: the other way round; without one of them it is assigned here."""
    models = lambda b: compare.models(annotations.cds_segments(b["lines"]), place="place")
    table = written(_codes(spark, codes, models(assembly), models(prediction)))
    back = written(_codes(spark, reverse, models(prediction), models(assembly)))
    of = lambda b: b["features"].join(b["supported"].withColumnRenamed("id", "protein"), "protein", "left_semi")
    p, a = of(prediction), of(assembly)
    reports.write_branches(selection.branch_comparison(table, back, a.drop("line_no"), p.drop("line_no"), assembly["sequences"], prediction["sequences"]), f"{output}/comparisons")
    reports.write_merged(p.unionByName(a), f"{output}/merged_supported_proteins")
    annotations.write_fasta(selection.merge_sequences(prediction["sequences"], assembly["sequences"]), f"{output}/merged_supported_proteins_fa")
    loci = lambda df: compare.locus_summary(df.where("type = 'cds'"))
    ids = lambda df: df.select("protein").distinct()
    totals = compare.overlap_statistics(compare.between(table, ids(a), ids(p)), "ref_id", "qry_id", ids(p).count(), ids(a).count())
    reports.write_table(totals, f"{output}/comparisons/overlap")
    if "novel" in prediction:
        reports.write_table(compare.novel_candidates(loci(prediction["novel"]), table, loci(a)).orderBy(F.length("candidate_id"), "candidate_id"), f"{output}/high_potential_new_gene_candidates")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evimap", description="Peptide evidence for gene models.")
    parser.add_argument("-g", "--gtf", required=True, help="gene models, GTF or GFF3")
    parser.add_argument("-f", "--proteins", help="their sequences; else they are translated from --assembly")
    parser.add_argument("-a", "--assembly", help="the genome's sequences")
    parser.add_argument("-p", "--peptides", help="peptides, one a line")
    parser.add_argument("-m", "--mapping", help="peptides and proteins, instead of looking --peptides up")
    parser.add_argument("-s", "--scores", help="external scores")
    parser.add_argument("-rg", "--reference-gtf")
    parser.add_argument("-rf", "--reference-fasta")
    parser.add_argument("-c", "--codes", help="class codes of the models against the reference; else they are assigned")
    parser.add_argument("-i", "--iterative", action="store_true", help="train a classifier instead of loading --model")
    parser.add_argument("--grid", choices=["default"], help="search the classifier's parameters by cross-validation")
    parser.add_argument("--model", help="a saved classifier")
    parser.add_argument("--second-gtf", help="models of a second branch, from assembled transcripts say; both are run and compared")
    parser.add_argument("--second-proteins", help="their sequences; else they are translated from --assembly")
    parser.add_argument("--second-mapping", help="peptides and the second branch's proteins, instead of looking --peptides up")
    parser.add_argument("--second-scores", help="external scores of the second branch")
    parser.add_argument("-o", "--output", required=True)
    a = vars(parser.parse_args(arguments))
    second = {k.removeprefix("second_"): a.pop(k) for k in [k for k in a if k.startswith("second_")]}
    if not (a["proteins"] or a["assembly"]):
        parser.error("--proteins or --assembly is needed")
    if not (a["peptides"] or a["mapping"]):
        parser.error("--peptides or --mapping is needed")
    if second["gtf"] and not (second["proteins"] or a["assembly"]):
        parser.error("--second-proteins or --assembly is needed")
    if second["gtf"] and not (a["peptides"] or second["mapping"]):
        parser.error("--peptides or --second-mapping is needed")
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    if not second["gtf"]:
        run_branch(spark, **a)
        return
    output = a.pop("output")
    first = run_branch(spark, **a, output=f"{output}/prediction")
    shared = {k: a[k] for k in ("assembly", "peptides", "reference_gtf", "reference_fasta", "model", "iterative", "grid")}
    other = run_branch(spark, **shared, **second, output=f"{output}/assembly")
    compare_branches(spark, first, other, None, None, output)


if __name__ == "__main__":
    main()

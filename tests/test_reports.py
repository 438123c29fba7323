import json

import pytest
from pyspark.sql import functions as F

from evimap.operators import charts, compare, intervals, search
from evimap.sources import annotations, reports

FEATURE = "seqid string, source string, type string, start long, end long, score double, strand string, frame string, attrs string, gene string, protein string, line_no long"


def lines_of(spark, *rows):
    return spark.createDataFrame([("\t".join(map(str, r)) if not isinstance(r, str) else r, i) for i, r in enumerate(rows)], "value string, place long")


def texts(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_transcripts_and_orfs(spark):
    tx = lines_of(spark, ("c", "x", "transcript", 100, 399, "5", "+", ".", 'gene_id "g"; transcript_id "t"'), ("c", "x", "exon", 300, 399, ".", "+", ".", 'transcript_id "t"'), ("c", "x", "exon", 100, 199, ".", "+", ".", 'gene_id "g"; transcript_id "t"'), ("c", "x", "mRNA", 1, 9, ".", "-", ".", "ID=alone"), "#c", "short")
    models = annotations.transcript_models(tx)
    got = {r.transcript: ([tuple(x) for x in r.exons], r.start, r.end, r.gene) for r in models.collect()}
    assert got == {"t": ([(100, 199), (300, 399)], 100, 399, "g"), "alone": ([(1, 9)], 1, 9, "alone")}
    found = annotations.orfs(lines_of(spark, ("t", "td", "gene", 1, 200, ".", "+", ".", "ID=g"), ("t", "td", "mRNA", 1, 200, ".", "+", ".", "ID=t.p1"), ("t", "td", "CDS", 50, 170, ".", "+", ".", "Parent=t.p1")))
    placed = intervals.project_orfs(found, models).orderBy("type", "start").collect()
    assert [(r.protein, r.type, r.start, r.end, r.frame) for r in placed] == [("t.p1", "CDS", 149, 199, "0"), ("t.p1", "CDS", 300, 369, "0"), ("t.p1", "transcript", 100, 399, ".")]


def test_cds_models_last_line_holds(spark):
    rows = lines_of(spark, ("c", "x", "CDS", 5, 9, ".", "+", "0", "Parent=p;gene_id=g1"), ("d", "x", "CDS", 1, 3, ".", "-", "0", 'transcript_id "p"; GeneID "g2"'))
    m = compare.models(annotations.cds_segments(rows), place="place").first()
    assert (m.protein, m.seqid, m.strand, m.gene, [tuple(x) for x in m.regions]) == ("p", "d", "-", "g2", [(1, 3), (5, 9)])


def test_reference_cleaning(spark):
    row = ("c", "x", "CDS", 1, 9, ".", "+", "0")
    rows = lines_of(spark, "#head", (*row, "ID=a"), (*row, "ID= ;x=1"), (*row, 'gene_id ""; transcript_id "t"'), (*row, 'transcript_id ""; gene_id ""'), ("c", "x", "gene", 1, 9, ".", "+", "0", "ID=a"), ("c", "x", "CDS", 1, 9, ".", "?", "0", "ID=a"), "a\tb", (*row, "GeneID=4"), (*row, "GeneID=4;protein_id=p"))
    got = annotations.cleaned(rows)
    assert [r.keep for r in got.orderBy("place").collect()] == [True, True, False, True, False, False, False, False, False, True]
    assert annotations.removed_rows(got).first().removed == 6


def test_missing_or_empty_codes(spark, tmp_path):
    assert annotations.class_codes(spark, str(tmp_path / "none.tmap")).collect() == []
    (tmp_path / "empty.tmap").write_text("")
    assert annotations.class_codes(spark, str(tmp_path / "empty.tmap")).collect() == []
    (tmp_path / "a.tmap").write_text("qry_id\tref_id\tclass_code\nq\tr\t=\n")
    assert annotations.class_codes(spark, str(tmp_path / "a.tmap")).first().class_code == "="


def test_peptide_list_and_search_sequences(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" AAK \r\nbbk\nAAK\n\n")
    assert sorted(r.peptide for r in annotations.peptide_list(spark, str(tmp_path / "p.txt"), upper=True).collect()) == ["AAK", "BBK"]
    (tmp_path / "s.fa").write_text("# note\n>p1 x\nMAI\nCD\n#more\n>p2\nMA\n>rev_p1\nMMMMMM\n")
    assert [(r.id, r.sequence) for r in annotations.fasta_for_search(spark, str(tmp_path / "s.fa"), exclude="rev_").collect()] == [("p1", "MALCD")]


def models(spark, *rows):
    seg = spark.createDataFrame([("c", "+", *r) for r in rows], "seqid string, strand string, protein string, start long, end long")
    return compare.models(seg)


def test_evidence_report(spark):
    spliced = ("s", 1, 18), ("s", 31, 60)
    predicted = models(spark, *spliced, ("t", 1, 30), ("n", 1, 30), ("i", 1, 30), ("x", 1, 18), ("x", 31, 60))
    reference = models(spark, ("s", 1, 18), ("s", 34, 60), ("t", 1, 60), ("n", 4, 30), ("i", 4, 30), ("x", 1, 18), ("x", 34, 90))
    codes = spark.createDataFrame([("s", "s", "j"), ("t", "t", "c"), ("n", "n", "k"), ("i", "i", "="), ("x", "x", None), ("gone", "gone", "j")], annotations.CODES)
    scores = spark.createDataFrame([("s", 0, 0, 9, 3, 0.5), ("t", 0, 1, 0, 1, 0.2), ("n", 2, 0, 0, 2, 0.3), ("x", 0, 1, 0, 1, 0.1)], "protein string, " + ", ".join(f"{c} {'double' if c == 'sequence_coverage' else 'long'}" for c in compare.REPORTED))
    block = "array<struct<s:long,e:long>>"
    located = spark.createDataFrame([("P1", "c", [(13, 18), (31, 36)]), ("P2", "c", [(13, 18), (34, 36)]), ("P1", "c", [(13, 18), (31, 36), (40, 41)]), ("P3", "d", [(13, 18), (31, 36)])], f"peptide string, seqid string, b {block}")
    got = {r.predicted_id: (r.structural_difference, r.peptide_evidence_category, r.splice_peptides) for r in compare.evidence_report(codes, scores, predicted, reference, located).collect()}
    assert got == {
        "s": ("different_splice", "peptide_support_different_splice", 1),
        "t": ("same_start_different_stop", "peptide_support_different_stop", 0),
        "n": ("different_start_same_stop", "peptide_support_different_start", 0),
        "x": ("different_splice", "peptide_support_different_stop", 0),  # the stop comes before the splicing
    }


def test_junction_support_looks_for_the_reference_junction_in_the_same_place(spark):
    pairs = models(spark, ("s", 1, 18), ("s", 31, 60), ("s", 71, 90)).select(F.col("protein").alias("qry_id"), F.struct("seqid", "strand", "regions").alias("p"))
    other = models(spark, ("s", 1, 18), ("s", 31, 57), ("s", 71, 90)).select(F.col("protein").alias("qry_id"), F.struct("seqid", "strand", "regions").alias("r"))
    located = spark.createDataFrame([("A", "c", [(50, 60), (71, 75)]), ("B", "c", [(50, 57), (71, 75)]), ("C", "c", [(1, 60), (71, 72), (80, 90)]), ("D", "c", [(1, 60), (71, 57), (71, 90)])], "peptide string, seqid string, b array<struct<s:long,e:long>>")
    # D spans a junction of the prediction and the reference's that ends alike
    assert compare.junction_support(pairs.join(other, "qry_id"), located).first().splice_support == 2


def test_candidates(spark):
    locus = "protein string, genes string, seqid string, strand string, start long, end long"
    p = spark.createDataFrame([("predA", "gA", "c", "+", 1, 9), ("predB", "gB", "c", "-", 20, 29), ("predC", "gC", "c", None, 40, 49)], locus)
    a = spark.createDataFrame([("b1", "h1", "c", "+", 1, 9), ("b2", "h2", "c", "+", 2, 9), ("b3", "h3", "c", None, 3, 9)], locus)
    codes = spark.createDataFrame([("b1", "predA", "j"), ("b2 ", " predA", "="), ("b1", "predB", "="), ("b3", "predC", "c"), ("b1", "predA", "u")], annotations.CODES)
    got = [(r.candidate_id, r.prediction_protein, r.bam_proteins, r.bam_class_codes, r.bam_match_count) for r in compare.novel_candidates(p, codes, a).orderBy("candidate_id").collect()]
    assert got == [("HPNGC_0001", "predA", "{b1,b2}", "{=,j}", 2), ("HPNGC_0002", "predC", "{b3}", "{c}", 1)]
    summary = spark.createDataFrame([("=", 10), ("j", 6), ("c", 5), ("u", 20), ("x", 7)], "class_code string, n long")
    assert tuple(compare.accepted_totals(summary).first()) == (21, 27, 48)
    assert tuple(compare.accepted_totals(summary.where("false")).first()) == (0, 0, 0)


def test_merged_models_file(spark, tmp_path):
    rows = spark.createDataFrame([("c", "x", "cds", 20, 29, 0.5, "+", "1", "", None, "p ", 1), ("c", "x", "cds", 1, 9, 1000.0, "+", "9", "", 'g"1', "p", 2), ("c", "x", "cds", 1, 9, 0.0, "+", "9", "", "g2", "p", 3), ("c", "x", "mrna", 1, 29, 0.0, "+", ".", "", "g", "p", 0)], FEATURE)
    reports.write_merged(rows, str(tmp_path / "m"))
    attrs = 'gene_id "g1"; transcript_id "p";'
    assert texts(tmp_path / "m") == [f"c\tx\ttranscript\t1\t29\t1000\t+\t.\t{attrs}", f"c\tx\tCDS\t1\t9\t1000\t+\t.\t{attrs}", f"c\tx\tCDS\t20\t29\t1000\t+\t1\t{attrs}"]


def test_lists_tables_and_lines(spark, tmp_path):
    f = spark.createDataFrame([("b", "-", "no-support", 0, False, True), ("c", "+", "moderate", 1, False, False), ("a", "+", "high", 2, True, False), ("d", "+", "moderate", 5, False, False)], "protein string, supported string, confidence string, mapped_peptides long, high boolean, low boolean")
    reports.write_id_lists(f, str(tmp_path))
    assert [texts(tmp_path / f"{n}_proteins") for n in ("all", "high_confident", "low_confident", "supported", "unsupported")] == [["a", "b", "c", "d"], ["a"], ["b"], ["a", "c", "d"], ["b"]]
    reports.write_scores(f, str(tmp_path / "scores"))
    assert [x.split("\t")[0] for x in texts(tmp_path / "scores") if not x.startswith("protein\t")] == ["a", "d", "c", "b"]
    m = spark.createDataFrame([("B", "Unmapped"), ("A", "UNMAPPED"), ("A", "UNMAPPED"), ("C", "p")], "peptide string, protein string")
    assert [r.peptide for r in reports.unmapped(m).collect()] == ["A", "B"]
    annotations.write_gtf(spark.createDataFrame([("c", "x", "CDS", 1, 9, None, "+", "0", 'gene_id "g";')], "seqid string, source string, type string, start long, end long, score double, strand string, frame string, attrs string"), str(tmp_path / "gtf"))
    assert texts(tmp_path / "gtf") == ['c\tx\tCDS\t1\t9\t.\t+\t0\tgene_id "g";']
    annotations.write_bed(spark.createDataFrame([("d", 1, "B"), ("c", 5, "A")], "chrom string, chrom_start long, name string"), str(tmp_path / "bed"))
    assert texts(tmp_path / "bed") == ['track name=Peptides description="Mapped Peptides" itemRgb="On"', "c\t5\tA", "d\t1\tB"]


def test_novel_and_comparison_files(spark, tmp_path):
    codes = spark.createDataFrame([("n", "-", "u"), ("o", "r", "=")], annotations.CODES)
    seqs = spark.createDataFrame([("n", "M" * 61), ("o", "MA")], "id string, sequence string")
    rows = spark.createDataFrame([("c", "x", "cds", 1, 9, 0.0, "+", "0", "", "g", "n", 1), ("c", "x", "cds", 1, 9, 0.0, "+", "0", "", "g", "o", 2)], FEATURE)
    parts = reports.novel(codes, rows, seqs, seqs.select(F.col("id").alias("protein")), spark.createDataFrame([("n", "ref")], "id string, sequence string"))
    assert [parts[k].count() for k in ("features", "sequences", "scores", "with_reference")] == [1, 1, 1, 2]
    reports.write_novel(parts, str(tmp_path / "novel"))
    assert texts(tmp_path / "novel" / "new_predicted_proteins_fa") == [">n", "M" * 60, "M"]
    report = spark.createDataFrame([("n", "k1")], "predicted_id string, peptide_evidence_category string")
    summary = compare.category_summary(report, "peptide_evidence_category", "predicted_id")
    for _ in range(2):  # a second run leaves nothing of the first
        reports.write_comparison(report, summary, spark.createDataFrame([("line", 1, "n"), ("other", 2, "o")], "value string, place long, protein string"), seqs, str(tmp_path / "cmp"))
    assert texts(tmp_path / "cmp" / "different_gtf" / "category=k1") == ["line"]
    assert texts(tmp_path / "cmp" / "different_faa" / "category=k1") == [">n", "M" * 60, "M"]
    reports.write_branches({"summary": summary, "shared_sequences": seqs}, str(tmp_path / "branch"))
    assert texts(tmp_path / "branch" / "shared_sequences")[0].startswith(">")


def test_lookup_and_its_reports(spark):
    proteins = spark.createDataFrame([("sp|P1|A", "KMAIDEKMALDE"), ("P2-2", "MALDEX")], "id string, sequence string")
    asked = spark.createDataFrame([("MAIDE",), ("MAIDE",), ("AID",), ("MABDE",), ("QQQQQ",)], "peptide string")
    found = search.lookup(asked, proteins)
    assert sorted(map(tuple, found.collect())) == [("AID", "UNMAPPED", 0), ("MABDE", "UNMAPPED", 0), ("MAIDE", "P2-2", 1), ("MAIDE", "sp|P1|A", 2), ("MAIDE", "sp|P1|A", 8), ("QQQQQ", "UNMAPPED", 0)]
    lines = lambda **how: [r.value for r in reports.lookup_report(found, **how).collect()]
    assert lines(proteins=proteins, with_unmapped=False) == ["peptide\tprotein\tlocation\tprevAA\tin_fasta\tnextAA", "MAIDE\tP2-2\t1\t-\tMALDE\tX", "MAIDE\tsp|P1|A\t2\tK\tMAIDE\tK", "MAIDE\tsp|P1|A\t8\tK\tMALDE\t-"]
    assert lines(positions=False, with_unmapped=False) == ["peptide\tprotein", "MAIDE\tP2-2", "MAIDE\tsp|P1|A"]
    assert lines(kind="text") == ["AID NOT found!", "MABDE NOT found!", "MAIDE found at following proteins,locations: P2-2,1 sp|P1|A,2 sp|P1|A,8", "QQQQQ NOT found!"]
    assert lines(kind="pepx", isoforms=False) == ["NO_MATCH AID", "NO_MATCH MABDE", "P2,P1 MAIDE", "NO_MATCH QQQQQ"]
    for positions in (True, False):
        data = json.loads("\n".join(lines(kind="json", positions=positions)))
        assert data["message"] == "3 mappings found" and len(data["mappings"]) == (6 if positions else 5)
    assert len([x for x in lines(kind="html") if x.startswith("<tr><td>")]) == 6 and lines(kind="html")[-1] == "</table>"
    with pytest.raises(ValueError):
        lines(kind="csv")


def test_chart_data(spark):
    scores = spark.createDataFrame([("+", "high", 1.0, 0.5), ("+", "moderate", 0.0, 0.5), ("-", "no-support", 0.3, 0.5)], "supported string, confidence string, sequence_coverage double, external_score double")
    got = {(r.group, r.bin): (r.n, r.density) for r in charts.coverage_histogram(scores).collect()}
    assert got[("supported", 0)] == (1, 10.0) and got[("supported", 19)] == (1, 10.0) and got[("high", 10)] == (1, 20.0)
    assert {(r.group, r.bin, r.n) for r in charts.score_histogram(scores).collect()} == {("all", 10, 3), ("supported", 10, 2)}
    old = spark.createDataFrame([("a", 3, 4)], "bar string, mapped long, unmapped long")
    assert tuple(charts.legacy_bars(old).first()) == ("a", 0, 3, 4, 7)
    counts = charts.difference_counts(spark.createDataFrame([("p",), ("p",)], "protein string"), spark.createDataFrame([("peptide_support_different_stop", 4)], "category string, n long"))
    assert {r.what: r.n for r in counts.collect()} == {"novel": 1, "peptide_support_different_stop": 4, "peptide_support_different_splice": 0, "peptide_support_different_start": 0}


def test_clusters_agree_with_one_sweep(spark):
    import random

    r = random.Random(5)
    rows = [("k" + str(i % 2), r.choice("ab"), s, s + r.choice([0, 3, 40, 400])) for i, s in enumerate(r.randint(0, 4000) for _ in range(200))]
    want = set()
    for k in ("k0", "k1"):
        runs = []
        for _, b, s, e in sorted((x for x in rows if x[0] == k), key=lambda x: x[2:]):
            if runs and s <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1, runs[-1][3] | {b})
            else:
                runs.append((s, e, 1, {b}))
        want |= {(k, s, e, n, "shared" if len(b) > 1 else f"{min(b)}-only") for s, e, n, b in runs}
    for stretches in (1, 7, 1024):
        got = intervals.clusters(spark.createDataFrame(rows, "key string, branch string, start long, end long"), ["key"], stretches=stretches)
        assert {tuple(x) for x in got.collect()} == want
    assert intervals.clusters(spark.createDataFrame([], "key string, branch string, start long, end long"), ["key"]).collect() == []

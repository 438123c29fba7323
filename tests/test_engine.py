import itertools

from pyspark.sql import functions as F

from evimap.functions import scalars
from evimap.operators import compare, evidence, intervals, search
from evimap.sources import annotations


def test_gff_and_gtf_attributes(spark, tmp_path):
    path = tmp_path / "a.gff"
    path.write_text('#h\nchr1\tx\tmRNA\t1\t9\t.\t+\t.\tID=p1;gene=g1\nchr1\tx\tCDS\t1\t9\t0.5\t+\t0\tParent=p1#cut\nchr1\tx\tCDS\t1\t9\t.\t-\t0\tgene_id "g2"; transcript_id "p2"\nchr1\tx\texon\t1\t9\t.\t+\t.\tID=e\n')
    got = [(r.type, r.gene, r.protein, r.score) for r in annotations.features(spark, str(path)).orderBy("line_no").collect()]
    assert got == [("mrna", "g1", "p1", 0.0), ("cds", "p1", "p1", 0.5), ("cds", "g2", "p2", 0.0)]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p1 some words\r\nMAC\r\nD*\n>p2\nII\n")
    df = annotations.fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.id, r.sequence) for r in df.orderBy("id").collect()] == [("p1", "MACD*"), ("p2", "II")]
    annotations.write_fasta(df, str(tmp_path / "out"), width=3)
    assert annotations.fasta(spark, str(tmp_path / "out")).select("id", "sequence").subtract(df.select("id", "sequence")).count() == 0
    assert df.select(scalars.residues(F.col("sequence")).alias("s")).orderBy("s").first().s == "LL"


def test_mapping_and_bed(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Peptide\tProtein\tlocation\nAAA\tp1 p2\t1\nAAA\tp1 p2\t1\nBBB\tUNMAPPED\t0\n")
    assert sorted(r.protein for r in annotations.mapping(spark, str(tmp_path / "m.tsv")).collect()) == ["p1", "p2"]
    (tmp_path / "b.bed").write_text("track x\nchr1\t15\t27\tFGHA\t0\t+\t15\t27\t255,0,0\t2\t3,9\t0,3\n")
    assert [tuple(b) for b in annotations.bed12(spark, str(tmp_path / "b.bed")).first().blocks] == [(16, 18), (19, 27)]
    (tmp_path / "c.bed").write_text("browser\ta\tb\tc\td\te\nchr1\t1\t9\tA\t0\t+\t1\t9\t0\t2\t3,x\t0,3\nchr1\t1\t9\tB\t0\t+\nchr1\t1\n")
    assert [(r.name, [tuple(b) for b in r.blocks]) for r in annotations.bed12(spark, str(tmp_path / "c.bed")).collect()] == [("A", []), ("B", [(2, 9)])]


def test_minus_strand_codons_and_projection(spark):
    seg = spark.createDataFrame([("p", "chr1", "-", 1, 18), ("p", "chr1", "-", 19, 33)], "protein string, seqid string, strand string, start long, end long")
    coded = intervals.codon_coordinates(seg)
    assert [(r.cds_start, r.cds_end) for r in coded.orderBy("start").collect()] == [(6, 11), (1, 5)]
    pep = spark.createDataFrame([("p", "x", 4, 7, 11)], "protein string, peptide string, pep_start long, pep_end long, prot_len long")
    assert [(r.genome_start, r.genome_end) for r in intervals.project_codons(coded, pep).orderBy("genome_start").collect()] == [(13, 18), (19, 24)]
    bed = intervals.bed12(intervals.project_codons(coded, pep)).first()
    assert (bed.chrom_start, bed.chrom_end, bed.block_sizes, bed.block_starts, bed.rgb) == (12, 24, "6,6", "0,6", "255,0,0")


def test_transcript_projection(spark):
    for strand, want in (("+", [(149, 199), (300, 369)]), ("-", [(130, 199), (300, 350)])):
        ex = spark.createDataFrame([("t", strand, 100, 199), ("t", strand, 300, 399)], "transcript string, strand string, start long, end long")
        f = spark.createDataFrame([("t", 50, 170)], "transcript string, f_start long, f_end long")
        assert [(r.genome_start, r.genome_end) for r in intervals.project_transcript(ex, f).orderBy("genome_start").collect()] == want


def test_coverage(spark):
    df = spark.createDataFrame([("a", 1, 5, 10), ("a", 4, 9, 10), ("b", 2, 5, 10), ("c", 0, 0, 10)], "protein string, pep_start long, pep_end long, prot_len long")
    assert {r.protein: r.coverage for r in intervals.union_coverage(df).collect()} == {"a": 0.9, "b": 0.4, "c": 0.0}


def test_difference(spark):
    seg = spark.createDataFrame([("p", "c", "+", 1, 18), ("p", "c", "+", 19, 33), ("r", "c", "+", 4, 18), ("r", "c", "+", 19, 33)], "protein string, seqid string, strand string, start long, end long")
    m = compare.models(seg)
    pair = m.where("protein = 'p'").select(F.struct("seqid", "strand", "regions").alias("p")).crossJoin(m.where("protein = 'r'").select(F.struct("seqid", "strand", "regions").alias("r")))
    assert compare.classify_difference(pair).first().difference == "different_start_same_stop"


def test_roc_cutoff(spark):
    df = spark.createDataFrame([("p1", 0.9, True), ("p2", 0.8, True), ("p3", 0.3, False), ("p4", 0.1, False)], "protein string, score double, high boolean")
    c = evidence.cutoff(evidence.roc(df)).first()
    assert 0.3 < c.cutoff <= 0.8 and c.youden == 1.0
    assert {r.protein for r in evidence.score_filter(df).where("score_supported").collect()} == {"p1", "p2"}


def test_cutoff_without_high_or_with_zero_scores(spark):
    schema = "protein string, score double, high boolean"
    none = spark.createDataFrame([("p1", 0.9, False), ("p2", 0.1, False)], schema)
    zero = spark.createDataFrame([("p1", 0.0, True), ("p2", 0.0, False)], schema)
    missing = spark.createDataFrame([("p1", None, True), ("p2", 0.4, False), ("p3", 0.9, True), ("p4", -0.5, False)], schema)
    assert [evidence.cutoff(evidence.roc(d)).first().cutoff for d in (none, zero, spark.createDataFrame([], schema))] == [0.0] * 3
    first = evidence.roc(missing).where("i = 0").first()
    assert (first.tpr, first.fpr, first.n_high) == (0.0, 0.0, 1)
    assert evidence.roc(missing).where("i = 999").first().fpr == 0.5  # a negative score is below every cutoff
    assert [r.score_supported for r in evidence.score_filter(missing).orderBy("protein").collect()] == [False, False, True, False]


def test_search_agrees_with_plain_search(spark):
    import random

    r = random.Random(3)
    text = lambda n: "".join(r.choice("AB😀") for _ in range(n))
    texts = [(i, text(r.randint(0, 90))) for i in range(12)] + [(99, None)]
    some = [t[r.randint(0, 5) :][: r.randint(1, 60)] for _, t in texts if t] + ["", "AB", "A", None]
    found = search.occurrences(spark.createDataFrame(texts, "id long, s string"), spark.createDataFrame(list(enumerate(some)), "pid long, q string"), "id", "s", "pid", "q")
    want = sorted((i, k, at + 1) for i, t in texts if t for k, q in enumerate(some) if q for at in range(len(t)) if t.startswith(q, at))
    assert sorted(map(tuple, found.collect())) == want
    assert search.occurrences(found.sparkSession.createDataFrame(texts, "id long, s string"), spark.createDataFrame([], "pid long, q string"), "id", "s", "pid", "q").collect() == []


def test_locate_and_terminal_flags(spark):
    m = spark.createDataFrame([("MAID", "a"), ("AID", "a"), ("DK", "a"), ("XX", "a"), ("AID", "b")], "peptide string, protein string")
    p = spark.createDataFrame([("a", "MALDK*"), ("b", "AAID")], "protein string, sequence string")
    got = {(r.peptide, r.protein): (r.pep_start, r.pep_end, r.n_terminal, r.c_terminal) for r in evidence.locate(m, p).collect()}
    assert got == {("MAID", "a"): (1, 4, True, False), ("AID", "a"): (2, 4, True, False), ("DK", "a"): (4, 5, False, True), ("XX", "a"): (0, 0, False, False), ("AID", "b"): (2, 4, False, True)}


def test_unmatched_models_and_scores(spark):
    seg = spark.createDataFrame([("a", "g", "c", "+", 1, 9), ("a", "g", "c", "+", 20, 29), ("b", "g", "c", "+", 1, 9), ("c", "h", "c", "+", 1, 9)], "protein string, gene string, seqid string, strand string, start long, end long")
    rows = spark.createDataFrame([("a", "P", 11, 1, 0.7261, True, False, "+", "-", True)], "protein string, peptide string, prot_len long, splice_sites long, coverage double, n_terminal boolean, c_terminal boolean, protein_specific string, gene_specific string, spliced boolean")
    facts = evidence.model_facts(seg, spark.createDataFrame([("b", 0.4)], "protein string, transcript_score double"))
    f = evidence.with_unmatched(evidence.features(rows), facts, spark.createDataFrame([("a", 11), ("b", 7)], "protein string, protein_length long"))
    f = evidence.with_external_scores(f, spark.createDataFrame([("a", 0.9), ("z", 1.0)], "protein string, external_score double"))
    got = {r.protein: r for r in f.collect()}
    assert sorted(got) == ["a", "b"] and (got["b"].mapped_peptides, got["b"].protein_length, got["b"].external_score) == (0, 7, 0.0)
    assert (got["a"].sequence_coverage, got["a"].external_score, got["a"].splice_peptides) == (0.73, 0.9, 1)
    assert {r.bar: (r.supported, r.partial, r.unsupported) for r in evidence.partitions(f).collect()}["splice_site_support"] == (1, 0, 1)
    assert {r.external_score for r in evidence.with_external_scores(f, None).collect()} == {0.0}


def test_masses(spark):
    df = spark.createDataFrame([("CEFGM",), ("OU",)], "p string").withColumn("m", scalars.peptide_mass(F.col("p")))
    plus = 1.007825 + 17.00274 + 1.00727649
    want = {"CEFGM": plus + 103.00918 + 129.04259 + 147.06841 + 57.02146 + 131.04048, "OU": plus + 132.08988 + 150.95363}
    assert {r.p: round(r.m, 6) for r in df.collect()} == {k: round(v, 6) for k, v in want.items()}
    base = F.lit(want["CEFGM"])
    added = {"none": 0.0, "oxidised": 15.9949, "both": 57.0215 + 15.9949, "heavier": -3.0, "odd": 7.0, "acetylated": 42.0106}
    row = df.where("p = 'CEFGM'").select(*[search.within_mass(F.col("p"), base + x, 0.01).alias(k) for k, x in added.items()]).first()
    assert row.asDict() == {"none": True, "oxidised": True, "both": True, "heavier": False, "odd": False, "acetylated": True}


def test_modifications_of_a_mass(spark):
    """Held against a plain search through all choices, in order of preference."""
    table = {}
    for residue, mass in scalars.MODIFICATIONS:
        table.setdefault(residue, []).append(mass)

    def choose(sites, lacking, tolerance):
        choices = itertools.product(*[[*table[c], 0.0] for c in sites])
        return next(("".join(f"(+{m:.4f})" for m in c if m) for c in choices if abs(round(sum(c), 4) - lacking) < tolerance), None)

    cases = [(p, x) for p in ("CEFGM", "MMNQK", "GGG", "") for x in (0.0, 0.984, 15.9949, 57.0215, 73.0164, 31.9898, 42.0106, 7.0, -3.0, 58.0055)]
    df = spark.createDataFrame([*cases, (None, 0.0)], "p string, x double").withColumn("target", scalars.peptide_mass(F.col("p")) + F.col("x"))
    got = {(r.p, r.x): (r.m, r.w) for r in df.select("p", "x", search.modified(F.col("p"), F.col("target"), 0.01).alias("m"), search.within_mass(F.col("p"), F.col("target"), 0.01).alias("w")).collect()}
    assert got.pop((None, 0.0))[0] is None
    for (p, x), (m, within) in got.items():
        mods = choose([c for c in "nc" + p if c in table], x, 0.01)
        assert m == (p if x == 0 else None if mods is None else p + mods), (p, x)
        assert (m is not None) == within
    assert got["CEFGM", 15.9949][0] == "CEFGM(+15.9949)"


def test_general_numbers(spark):
    values = [0.0, 1000.0, 0.5, 0.1 + 0.2, 1234567.0, 123456.7, 1e-5, 0.00012345678, -2.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(scalars.general_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{v:g}" for v in values]


def test_wildcards_and_fuzzy_sites(spark):
    df = spark.createDataFrame([("AXC",)], "peptide string")
    assert sorted(r.expanded for r in search.expanded(df).collect()) == [f"A{x}C" for x in search.ALPHABET]
    p = spark.createDataFrame([("ABCD",)], "peptide string")
    assert [sorted(r.pattern for r in search.fuzzy(p, n).collect()) for n in (1, 2, 3)] == [["ABCX", "ABXD", "AXCD", "XBCD"], ["ABXX", "AXCX", "AXXD", "XBCX", "XBXD", "XXCD"], ["AXXX", "XXXD"]]


def test_alternatives(spark):
    hits = spark.createDataFrame([("ABC", "ABC", "z", 1), ("ABC", "ABC", "a", 2), ("ABC", "ABD", "a", 2), ("ABC", "ABC", "DECOY", 2), ("ABC", "XYC", "b", 2), ("ABC", "ABC", "best", 2)], "peptide string, original string, protein string, ntt int")
    got = [(r.protein, r.substitutions) for r in search.alternatives(hits, sink="DEC", float_="best").orderBy("nth").collect()]
    assert got == [("best", 0), ("a", 0), ("DECOY", 0), ("z", 0), ("a", 1)]


def test_search_finds_overlapping_occurrences(spark):
    t = spark.createDataFrame([(1, "AAAAAAA"), (2, "XKAAAAAR")], "id long, s string")
    p = spark.createDataFrame([(7, "AAAAA")], "pid long, q string")
    hits = search.occurrences(t, p, "id", "s", "pid", "q")
    assert sorted((r.id, r.position) for r in hits.collect()) == [(1, 1), (1, 2), (1, 3), (2, 3)]
    c = search.with_context(hits, t, p, "id", "s", "pid", "q").where("id = 2").first()
    assert (c.before, c.after, c.ntt) == ("K", "R", 1)
    attrs = spark.createDataFrame([('ID=a; gene "g"; ID=b',)], "t string").select(scalars.attribute_map(F.col("t")).alias("m")).first().m
    assert attrs == {"ID": "b", "gene": "g"}


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

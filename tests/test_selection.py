import pytest

from evimap.operators import selection
from evimap.sources import annotations


def test_score_file_with_preamble(spark, tmp_path):
    (tmp_path / "s.csv").write_text('made by hand\n\nDescription, In-Frame_Score\np1,0.5\n"p2",x\np3,1,2\np4\n')
    got = annotations.external_scores(spark, str(tmp_path / "s.csv"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [("p1", 0.5), ("p2", None), ("p4", None)]
    (tmp_path / "bad.csv").write_text("id,score_value\np1,1\n")
    with pytest.raises(ValueError):
        annotations.external_scores(spark, str(tmp_path / "bad.csv"))


def test_pepxml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<a><search_hit hit_rank="1" peptide="AAK">\n<search_hit hit_rank="2"\n peptide="BBK"/><search_hit peptide="CCK"/>\n<search_hit hit_rank="1" peptide="AAK"/></a>')
    assert sorted(r.peptide for r in annotations.pepxml_peptides(spark, str(tmp_path / "a.xml")).collect()) == ["AAK", "CCK"]


def test_resolved_lines(spark, tmp_path):
    row = "c\tx\t{}\t1\t9\t.\t+\t.\t{}\n"
    parts = [("gene", "ID=g1"), ("mRNA", "ID=m1;Parent=g1"), ("CDS", "ID=c1;Parent=m1;protein_id=p1"), ("exon", "ID=e1;Parent=m1"), ("mRNA", "m2"), ("exon", 'transcript_id "t3"; gene_id "g3"'), ("exon", "ID=e9;Parent=none")]
    (tmp_path / "a.gff").write_text("#h\n" + "".join(row.format(*p) for p in parts) + "short\tline\n")
    got = [r.protein for r in selection.resolved(annotations.placed_lines(spark, str(tmp_path / "a.gff"))).orderBy("place").collect()]
    assert got == ["p1", "p1", "p1", "p1", "m2", "t3", None]


def test_branch_comparison(spark):
    feature = "seqid string, type string, start long, end long, gene string, protein string, attrs string"
    assembly = spark.createDataFrame([("c", "cds", 1, 9, "g", "n1", "x"), ("c", "cds", 20, 29, "g", "s1", "y")], feature)
    prediction = spark.createDataFrame([("c", "cds", 20, 29, "h", "q1", "y"), ("c", "cds", 50, 59, "q2", None, "z")], feature)
    tmap = "qry_id string, ref_id string, class_code string"
    codes = spark.createDataFrame([("n1", "-", "u"), ("s1", "q1", "="), ("s2", "q1", None)], tmap)
    reverse = spark.createDataFrame([("q1", "s1", "="), ("q2", "-", "u")], tmap)
    fasta = "id string, sequence string"
    out = selection.branch_comparison(codes, reverse, assembly, prediction, spark.createDataFrame([("n1", "MA"), ("both", "MB")], fasta), spark.createDataFrame([("q2", "MC"), ("both", "MD")], fasta))
    assert [r.protein for r in out["assembly_only_features"].collect()] == ["n1"]
    assert [r.gene for r in out["prediction_only_features"].collect()] == ["q2"]
    assert [r.id for r in out["assembly_only_sequences"].collect()] == ["n1"]
    assert [r.start for r in out["shared_features"].collect()] == [20]
    assert sorted((r.id, r.sequence) for r in out["shared_sequences"].collect()) == [("both", "MD"), ("n1", "MA"), ("q2", "MC")]
    assert {r.class_code: r.n for r in out["summary"].collect()} == {"u": 1, "=": 1, "NA": 1}
    none = selection.branch_comparison(codes.where("false"), reverse, assembly, prediction, spark.createDataFrame([("n1", "MA")], fasta), spark.createDataFrame([("q2", "MC")], fasta))
    assert [r.id for r in none["shared_sequences"].collect()] == ["q2"]

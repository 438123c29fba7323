"""The smallest input from files to files, with values worked out by hand."""

import pytest

from pyspark.sql import functions as F

from evimap import run
from evimap.operators import compare
from evimap.sources import annotations


def folder(tmp_path):
    row = "chr1\tsrc\t{}\t{}\t{}\t{}\t+\t{}\t{}\n"
    models = [("mRNA", 1, 33, 0.95, ".", "ID=protA;Parent=geneA;gene=geneA"), ("CDS", 1, 18, 0.95, 0, "ID=cdsA1;Parent=protA;protein_id=protA;gene=geneA"), ("CDS", 19, 33, 0.95, 0, "ID=cdsA2;Parent=protA;protein_id=protA;gene=geneA")]
    models += [("mRNA", 101, 130, "0.40", ".", "ID=protB;Parent=geneB;gene=geneB"), ("CDS", 101, 130, "0.40", 0, "ID=cdsB1;Parent=protB;protein_id=protB;gene=geneB")]
    reference = [("mRNA", 4, 33, 0.99, ".", "ID=refA;Parent=geneRefA"), ("CDS", 4, 18, 0.99, 0, "ID=refA1;Parent=refA;protein_id=refA"), ("CDS", 19, 33, 0.99, 0, "ID=refA2;Parent=refA;protein_id=refA"), ("CDS", 101, 130, 0.8, 0, "ID=refB1;Parent=refB;protein_id=refB"), ("gene", 1, 9, ".", ".", "ID=g")]
    files = {
        "p.gff": "".join(row.format(*x) for x in models),
        "r.gff": "#r\n" + "".join(row.format(*x) for x in reference),
        "p.fa": ">protA some words\nMACDEFGHAAA\n>protB\nMNPQRSTVWYA\n>protC\nMM\n",
        "r.fa": ">refA\nMM\n",
        "m.tsv": "Peptide\tProtein\tlocation\nMACD\tprotA\t1\nFGHA\tprotA\t2\nRSTV\tprotB\t3\nQQQQ\tUNMAPPED\t0\n",
        "s.csv": "description,external_score\nprotA,0.95\nprotB,0.15\n",
        "c.tmap": "qry_id\tref_id\tclass_code\nprotA\trefA\tj\nprotB\trefB\t=\n",
        "p.txt": "CDEFGH\nQRSTVW\nWWWWWW\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return {name: str(tmp_path / name) for name in files}


def texts(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_one_branch(spark, tmp_path):
    f = folder(tmp_path)
    out = run.run_branch(spark, f["p.gff"], str(tmp_path / "out"), proteins=f["p.fa"], mapping=f["m.tsv"], scores=f["s.csv"], reference_gtf=f["r.gff"], reference_fasta=f["r.fa"], codes=f["c.tmap"])
    got = {r.protein: r for r in out["scores"].collect()}
    what = ("protein_length", "isoforms", "splice_sites", "transcript_score", "sequence_coverage", "mapped_peptides", "n_terminal_peptides", "c_terminal_peptides", "protein_specific_peptides", "gene_specific_peptides", "splice_peptides", "internal_peptides", "external_score", "supported", "confidence")
    assert [got["protA"][c] for c in what] == [11, 1, 1, 0.95, 0.73, 2, 1, 0, 2, 2, 1, 1, 0.95, "+", "high"]
    # one protein-specific peptide, 0.36 of it covered, a score under the cutoff: nothing speaks for protB
    assert [got["protB"][c] for c in what] == [11, 1, 0, 0.40, 0.36, 1, 0, 0, 1, 1, 0, 1, 0.15, "-", "no-support"]
    assert texts(tmp_path / "out" / "peptides_mapped_bed")[1:] == ["chr1\t0\t12\tMACD\t0\t+\t0\t12\t0,255,0\t1\t12\t0", "chr1\t15\t27\tFGHA\t0\t+\t15\t27\t255,0,0\t2\t3,9\t0,3", "chr1\t112\t124\tRSTV\t0\t+\t112\t124\t153,153,153\t1\t12\t0"]
    assert texts(tmp_path / "out" / "unmapped_peptides") == ["QQQQ"]
    assert len(texts(tmp_path / "out" / "supported_proteins_gtf")) == 3 and texts(tmp_path / "out" / "supported_proteins_fa") == [">protA", "MACDEFGHAAA"]
    assert texts(tmp_path / "out" / "lists" / "high_confident_proteins") == ["protA"]
    compared = tmp_path / "out" / "compare_to_reference"
    assert texts(compared / "reference_cleaned")[0] == "#r" and len(texts(compared / "reference_cleaned")) == 5
    assert [tuple(r)[:4] for r in out["report"].collect()] == [("protA", "refA", "different_start_same_stop", "peptide_support_different_start")]
    assert len(texts(compared / "different_gtf" / "category=peptide_support_different_start")) == 3
    run.compare_branches(spark, out, out, f["c.tmap"], f["c.tmap"], str(tmp_path / "both"))
    assert texts(tmp_path / "both" / "merged_supported_proteins")[0].startswith("chr1\tsrc\ttranscript\t1\t33\t0.95\t+\t.\t")


def test_lookup_and_translation(spark, tmp_path):
    f = folder(tmp_path)
    out = run.run_branch(spark, f["p.gff"], str(tmp_path / "a"), proteins=f["p.fa"], peptides=f["p.txt"])
    assert {r.protein: r.mapped_peptides for r in out["scores"].collect()} == {"protA": 1, "protB": 1}
    assert texts(tmp_path / "a" / "unmapped_peptides") == ["WWWWWW"] and "CDEFGH\tprotA\t3" in texts(tmp_path / "a" / "mapping")
    code = dict(zip("MACDEFGHNPQRSTVWY", "ATG GCT TGT GAT GAA TTT GGT CAT AAT CCT CAA CGT TCT ACT GTT TGG TAT".split(), strict=True))
    (tmp_path / "g.fa").write_text(">chr1\n" + "".join(code[x] for x in "MACDEFGHAAA") + "N" * 67 + "".join(code[x] for x in "MNPQRSTVWY") + "\n")
    again = run.run_branch(spark, f["p.gff"], str(tmp_path / "b"), assembly=str(tmp_path / "g.fa"), peptides=f["p.txt"])
    assert {r.protein: (r.mapped_peptides, r.protein_length) for r in again["scores"].collect()} == {"protA": (1, 11), "protB": (1, 10)}


def test_codes_are_assigned_and_two_branches_compared_by_command(spark, tmp_path):
    f = folder(tmp_path)
    common = ["-g", f["p.gff"], "-f", f["p.fa"], "-m", f["m.tsv"], "-s", f["s.csv"], "-rg", f["r.gff"], "-rf", f["r.fa"]]
    run.main([*common, "-o", str(tmp_path / "one")])
    # protA begins one codon earlier: its intron is its reference's; protB is its own reference
    compared = tmp_path / "one" / "compare_to_reference"
    assert sorted(x for x in texts(compared / "class_codes") if not x.startswith("qry_id")) == ["protA\trefA\t="]
    run.main([*common, "--second-gtf", f["p.gff"], "--second-proteins", f["p.fa"], "--second-mapping", f["m.tsv"], "--second-scores", f["s.csv"], "-o", str(tmp_path / "two")])
    assert (tmp_path / "two" / "prediction" / "all_proteins_scores").exists() and (tmp_path / "two" / "assembly" / "all_proteins_scores").exists()
    merged = texts(tmp_path / "two" / "merged_supported_proteins")
    assert merged[0].startswith("chr1\tsrc\ttranscript\t1\t33\t0.95\t+\t.\t")
    overlap = [x.split("\t") for x in texts(tmp_path / "two" / "comparisons" / "overlap")]
    assert len(overlap) == 2
    with pytest.raises(SystemExit):
        run.main([*common[:2], "-a", "x", "-m", f["m.tsv"], "--second-gtf", f["p.gff"], "-o", "x"])


def test_candidates_stand_by_number(spark, tmp_path):
    rows = spark.range(10_050).selectExpr("id AS place", "'c' AS seqid", "1L AS n", "cast(id AS string) AS protein")
    numbered = compare.numbered(rows, "n", "seqid", ["place"])
    ids = [r.candidate_id for r in numbered.orderBy(F.length("candidate_id"), "candidate_id").select("candidate_id").collect()]
    assert ids[:2] == ["HPNGC_0001", "HPNGC_0002"] and ids[9_998:10_001] == ["HPNGC_9999", "HPNGC_10000", "HPNGC_10001"]


def test_a_mapping_to_other_ids_is_an_error(spark, tmp_path):
    f = folder(tmp_path)
    (tmp_path / "x.tsv").write_text("Peptide\tProtein\tlocation\nMACD\tother\t1\n")
    with pytest.raises(ValueError, match="mapping"):
        run.run_branch(spark, f["p.gff"], str(tmp_path / "out"), proteins=f["p.fa"], mapping=str(tmp_path / "x.tsv"))
    with pytest.raises(SystemExit):
        run.main(["-g", f["p.gff"], "-o", "x", "-f", f["p.fa"]])
    assert annotations.mapping(spark, f["m.tsv"], with_unmapped=True).count() == 4

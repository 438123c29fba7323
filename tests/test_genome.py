"""Genome tiles and translation against plain strings."""

import itertools
import random

from pyspark.sql import functions as F

from evimap.operators import genome
from evimap.sources import annotations


def rows_of(tiled):
    out = {}
    for r in sorted(tiled.collect(), key=lambda r: (r.seqid, r.tile)):
        assert len(out.get(r.seqid, "")) % 7 == 0
        out[r.seqid] = out.get(r.seqid, "") + r.text
    return out


def test_tiles_of_lines_in_blocks(spark):
    """Headers anywhere, blocks without one, empty and long lines, text before the first header."""
    r = random.Random(4)
    lines, want, name = ["lost"], {}, None
    for i in range(12):
        name = f"s{i}"
        lines.append(f">{name} some words")
        want[name] = ""
        for _ in range(r.choice([0, 1, 5, 30])):
            text = "".join(r.choice("ACGTacgt") for _ in range(r.choice([0, 1, 6, 7, 50])))
            lines.append(text[:3] + " " + text[3:] + "\r" * r.randint(0, 1))
            want[name] += text
    blocks = sorted(r.randint(0, 20) for _ in lines)
    rows = [(b, i, x) for i, (b, x) in enumerate(zip(blocks, lines, strict=True))]
    placed = genome.placed(spark.createDataFrame(rows, "block int, place long, value string").repartition(5))
    assert rows_of(genome.tiles(placed, 7)) == {k: v for k, v in want.items() if v}


def test_tiles_of_a_split_file(spark, tmp_path):
    r = random.Random(5)
    want = {f"chr{i}": "".join(r.choice("ACGT") for _ in range(r.randint(1, 4000))) for i in range(9)}
    wrap = lambda s: "\n".join(s[i : i + 60] for i in range(0, len(s), 60))
    (tmp_path / "g.fa").write_text("".join(f">{k} x\n{wrap(v) if k != 'chr3' else v}\n" for k, v in want.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        tiled = annotations.genome_tiles(spark, str(tmp_path / "g.fa"))
        assert annotations.placed_lines(spark, str(tmp_path / "g.fa")).rdd.getNumPartitions() > 1
        out = {}
        for t in sorted(tiled.collect(), key=lambda t: (t.seqid, t.tile)):
            out[t.seqid] = out.get(t.seqid, "") + t.text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out == want


CODE = {"".join(c): a for c, a in zip(itertools.product("TCAG", repeat=3), genome.AMINO_ACIDS, strict=True)}


def plain_translation(s):
    return "".join(CODE.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))


def test_translation_over_tiles(spark):
    r = random.Random(6)
    text = {"a": "".join(r.choice("ACGTacgtN") for _ in range(500)), "b": "ACG"}
    segments = [(f"m{i}", r.choice("ab"), "+-"[i % 2], r.randint(1, 480), 0) for i in range(60)]
    segments = [(m, c, s, at, at + r.randint(0, 60)) for m, c, s, at, _ in segments]
    segments += [("two", "a", "-", 101, 130), ("two", "a", "-", 8, 50), ("gone", "z", "+", 1, 9), ("three", "a", "+", 1, 7), ("three", "a", "+", 490, 600)]
    tiled = genome.tiles(spark.createDataFrame([(k, 0, v) for k, v in text.items()], "seqid string, offset long, text string"), 7)
    got = {x.protein: x.sequence for x in genome.translated(spark.createDataFrame(segments, "protein string, seqid string, strand string, start long, end long"), tiled, size=7).collect()}
    want = {}
    for m in {x[0] for x in segments} - {"gone"}:
        own = sorted((at, end, c, s) for n, c, s, at, end in segments if n == m)
        s = "".join(text[c][at - 1 : end] for at, end, c, _ in own).upper()
        if own[0][3] == "-":
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want[m] = plain_translation(s)
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if v or k in got} and all(want[k] == "" for k in set(want) - set(got))


def test_no_tile_is_longer_than_its_size(spark):
    long = spark.createDataFrame([("c", 5, "ACGT" * 50_000)], "seqid string, offset long, text string")
    sizes = genome.tiles(long, 1000).agg(F.max(F.length("text")).alias("most"), F.sum(F.length("text")).alias("all"), F.count("*").alias("n")).first()
    assert (sizes["most"], sizes["all"], sizes["n"]) == (1000, 200_000, 201)


def test_bed12_as_written_by_others(spark, tmp_path):
    rows = [
        "#chr1\t1\t2\tcomment\t0\t+",
        "track name=x",
        "chr1\t10\t30\tA\t0\t+\t10\t30\t0\t2\t5,6\t0,14",
        "chr1\t10\t30\tB\t0\t+\t10\t30\t0\t3\t5,6,\t0,14,",
        "chr1\t10\t30\tC\t0\t-\t10\t30\tID=1;protein=p1;x=2\t1\t20\t0",
        "chr1\t10\t30\tD\t0\t-\tParent=p9;n=1\tprotein=p2",
        "",
    ]
    (tmp_path / "b.bed").write_text("\n".join(rows))
    got = {r.name: (r.start, r.end, r.protein, [tuple(b) for b in r.blocks]) for r in annotations.bed12(spark, str(tmp_path / "b.bed")).collect()}
    assert got == {"A": (11, 30, None, [(11, 15), (25, 30)]), "B": (11, 30, None, []), "C": (11, 30, "2", [(11, 30)]), "D": (11, 30, "1", [(11, 30)])}


def test_segments_of_one_tile_stay_where_they_are(spark):
    """All segments touch a tile: they aren't brought to it, whatever Spark knows of its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tiled = spark.createDataFrame([("c", 0, "ACGT" * 1000)], "seqid string, tile long, text string")
        segments = spark.range(4000).selectExpr("id as protein", "'c' as seqid", "'+' as strand", "id % 3000 + 1 as start", "id % 3000 + 300 as end")
        found = genome.cut_out(segments, tiled, "protein")
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        text = "ACGT" * 1000
        assert all(x.sequence == text[x.protein % 3000 :][:300] for x in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_translation_of_any_letters(spark):
    """Letters that are no bases, of one byte or more, and codons that aren't finished."""
    text = "ATGGCCNNNacgéTA😀AA\x00TTTGG"
    tiled = spark.createDataFrame([("c", 0, text)], "seqid string, tile long, text string")
    segments = spark.createDataFrame([(1, "c", "+", 1, len(text)), (2, "c", "+", 1, 2), (3, "c", "-", 1, 6), (4, "d", "+", 1, 6)], "protein long, seqid string, strand string, start long, end long")
    found = {x.protein: x.sequence for x in genome.translated(segments, tiled).collect()}
    codons = itertools.product(genome.BASES, repeat=3)
    table = {"".join(c): a for c, a in zip(codons, genome.AMINO_ACIDS, strict=True)}
    letters = lambda t: "".join(table.get(t[i : i + 3], "X") for i in range(0, len(t) - 2, 3))
    assert found == {1: letters(text.upper()), 2: "", 3: letters("GGCCAT")}

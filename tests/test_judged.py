"""Class codes found in cells are those of all pairs near by, however the cells are dealt and the pairs portioned."""

import random

import pytest
from pyspark.sql import functions as F

from evimap.operators import judged, overlap

MODEL = "id string, seqid string, strand string, exons array<struct<start:long,end:long>>"


def made(r, name, n, gap=100, wide=0):
    """Models whose exons begin at few places, so that every kind of intron occurs often, and some exons overlap."""
    out = []
    for i in range(n):
        base = r.randint(0, wide) * 4000
        exons = [(base + gap * r.randint(0, 8) + r.randint(0, 4), r.choice((15, 20, 40, 60, 130, 900))) for _ in range(r.choice((1, 1, 2, 3, 4, 6)))]
        out.append((f"{name}{i}", r.choice(("c", "d", None) if not i % 9 else "c"), r.choice(("+", "-", ".", None, "+")), sorted((s, s + n) for s, n in exons)))
    return out


def by_all_pairs(spark, q, ref):
    rank = F.expr(f"instr('{overlap.CODES}', c.class_code)")
    every = overlap.pairs(spark.createDataFrame(q, MODEL), spark.createDataFrame(ref, MODEL)).select("q.id", F.col("r.id").alias("ref"), overlap.code().alias("c")).where("c.class_code is not null")
    best = every.groupBy("id").agg(F.min(F.struct(rank.alias("k"), (-F.col("c.letters")).alias("n"), "ref", "c.class_code")).alias("b")).select("id", "b.*").collect()
    found = {x.id: (x.ref, x.class_code, x.k, -x.n) for x in best}
    return found, sorted((x[0], *found.get(x[0], (None, "u"))[:2]) for x in q)


@pytest.mark.parametrize("seed, gap, wide, kinds", [(1, 100, 0, 6), (2, 400, 12, 12), (4, 900, 40, 13)])
def test_parts_of_cells_find_what_all_pairs_find(spark, seed, gap, wide, kinds):
    r = random.Random(seed)
    q, ref = made(r, "q", 250, gap, wide), made(r, "r", 150, gap, wide)
    q += [(f"again{i}", *x[1:]) for i, x in enumerate(q[:40])]
    _, want = by_all_pairs(spark, q, ref)
    assert len({c for *_, c in want}) >= kinds
    models, refs = overlap.numbered(spark.createDataFrame(q, MODEL)), spark.createDataFrame(ref, MODEL)
    got = {rows: sorted(map(tuple, overlap.coded(models, refs, rows=rows).select("qry_id", "ref_id", "class_code").collect())) for rows in (20, 1 << 17)}
    assert got[20] == want and got[1 << 17] == want


@pytest.mark.parametrize("portion", [1, 50, 1 << 18])
def test_portions_and_both_sides_from_one_table(spark, monkeypatch, portion):
    r = random.Random(7)
    q, ref = made(r, "q", 60), made(r, "r", 40)
    monkeypatch.setattr(judged, "PORTION", portion)
    found, _ = by_all_pairs(spark, q, ref)
    cells = [overlap._cells(spark.createDataFrame(x, MODEL), "id", m).withColumn("part", F.lit(0)).withColumnRenamed("id", k).toArrow() for x, m, k in ((q, 2000, "_row"), (ref, 0, "ref_id"))]
    got = {x["_row"]: (x["ref_id"], overlap.CODES[x["rank"] - 1], x["rank"], x["letters"]) for x in judged.judged(*cells, overlap.CODES, 2000, overlap.FRAGMENT).to_pylist()}
    assert got == found
    models = overlap.numbered(spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(q) if x[1]], MODEL.replace("id string", "id long", 1)))
    assert all(x.class_code == "=" for x in overlap.coded(models, models).collect())


def test_models_that_are_not_near_have_no_code(spark):
    # the last exon ends far before a place of the first
    q, ref = [("q", "c", "+", [(1, 20000), (5, 6)])], [("r", "c", "+", [(9000, 9100)])]
    _, want = by_all_pairs(spark, q, ref)
    assert list(map(tuple, overlap.class_codes(spark.createDataFrame(q, MODEL), spark.createDataFrame(ref, MODEL)).collect())) == want == [("q", None, "u")]


def test_what_is_exchanged_grows_with_exons(spark):
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    r = random.Random(11)

    def bytes_of_an_exon(exons, n=800):
        at = [[1000 * k + r.randint(0, 300) for k in range(exons)] for _ in range(2 * n)]
        rows = [(f"{i}", f"c{i % 40}", "+", [(s, s + r.randint(50, 400)) for s in x]) for i, x in enumerate(at)]
        q, ref = spark.createDataFrame(rows[:n], MODEL), spark.createDataFrame(rows[n:], MODEL)
        before = sent()
        assert len(overlap.class_codes(q, ref).collect()) == n
        return (sent() - before) / (2 * n * exons)

    # a model is sent to each cell it touches; when it was sent for each of its introns, it took 366 bytes an exon
    assert bytes_of_an_exon(12) < 60

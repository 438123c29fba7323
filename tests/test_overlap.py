"""Class codes on pairs made by hand, and against a plain decision list."""

import random

import pytest

from evimap.operators import overlap

MODEL = "id string, seqid string, strand string, exons array<struct<start:long,end:long>>"
REF = [(1000, 1100), (1200, 1300), (1400, 1500), (1700, 1800)]
#: code, the model's exons, its strand, the reference's exons (+).
PAIRS = [
    ("=", [(990, 1100), (1200, 1300), (1400, 1500), (1700, 1900)], "+", REF),
    ("=", [(1, 100)], "+", [(11, 110)]),
    ("c", [(1250, 1300), (1400, 1450)], "+", REF),
    ("c", [(1210, 1290)], ".", REF),
    ("k", [(900, 950), (1000, 1100), (1200, 1300), (1400, 1500), (1700, 1800)], "+", REF),
    ("k", [(500, 900), (1000, 1100)], "+", [(600, 700)]),
    ("m", [(1000, 1100), (1200, 1500), (1700, 1800)], "+", REF),
    ("m", [(950, 1350)], "+", [(1000, 1100), (1200, 1300)]),
    ("n", [(1000, 1300), (1450, 1600), (1700, 1800)], "+", REF),
    ("j", [(1000, 1100), (1210, 1300), (1400, 1500)], "+", REF),
    ("e", [(1050, 1120)], "+", REF),
    ("o", [(1050, 1105)], "+", REF),
    ("o", [(900, 1050), (1160, 1210), (1290, 1390)], "+", REF),
    ("s", [(1000, 1100), (1200, 1310)], "-", REF),
    ("x", [(1000, 1090), (1210, 1310)], "-", REF),
    ("i", [(1520, 1560), (1600, 1650)], "-", REF),
    ("y", [(100, 900), (2000, 2100)], "+", REF),
    ("p", [(3800, 3900)], "+", REF),
    ("u", [(3801, 3900)], "+", REF),
    ("u", [(1900, 1950)], "-", REF),
]


def test_codes_of_pairs(spark):
    models = [(f"q{i}", f"c{i}", strand, exons) for i, (_, exons, strand, _) in enumerate(PAIRS)]
    refs = [(f"r{i}", f"c{i}", "+", exons) for i, (*_, exons) in enumerate(PAIRS)]
    got = {r.qry_id: (r.class_code, r.ref_id) for r in overlap.class_codes(spark.createDataFrame(models, MODEL), spark.createDataFrame(refs, MODEL)).collect()}
    assert got == {f"q{i}": (c, None if c == "u" else f"r{i}") for i, (c, *_) in enumerate(PAIRS)}
    assert {c for c, _ in got.values()} | {"r"} == set(overlap.CODES)


def test_best_reference_repeats_and_models_without_one(spark):
    refs = spark.createDataFrame([("b", "c", "+", REF), ("a", "c", "+", REF), ("x", "c", "-", [(1000, 1800)]), ("none", "c", "+", [])], MODEL)
    models = [("m1", "c", "+", REF, 0.9), ("m2", "d", "+", REF, 0.5), ("m3", "d", "+", REF, 0.4), ("m4", "c", "-", [(1000, 1790)], None), ("m5", "c", "+", [], None), ("m1", "d", None, REF, None)]
    got = overlap.class_codes(spark.createDataFrame(models, MODEL + ", masked double"), refs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("m1", "a", "="), ("m2", None, "r"), ("m3", None, "u"), ("m4", "x", "="), ("m5", None, "u"), ("m1", None, "u")], key=str)
    assert overlap.class_codes(spark.createDataFrame([], MODEL), refs).collect() == []


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_each_pair_once(spark, size):
    r = random.Random(3)

    def made(name, n):
        out = []
        for i in range(n):
            at, exons = r.randint(1, 3000), []
            for _ in range(r.randint(1, 5)):
                exons.append((at, at + r.randint(0, 90)))
                at = exons[-1][1] + r.randint(2, 120)
            out.append((f"{name}{i}", r.choice("ab"), r.choice("+-"), exons))
        return out

    q, ref = made("q", 60), made("r", 60)
    want = sorted((a, b) for a, c, _, x in q for b, d, _, y in ref if c == d and x[0][0] <= y[-1][1] + 100 and y[0][0] <= x[-1][1] + 100)
    got = overlap.pairs(spark.createDataFrame(q, MODEL), spark.createDataFrame(ref, MODEL), 100, size).selectExpr("q.id", "r.id").collect()
    assert sorted(map(tuple, got)) == want


def test_steps_find_what_all_pairs_find(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    # exons at few places, some of which overlap, so that every kind of intron occurs often
    def made(name, n):
        out = []
        for i in range(n):
            starts = [100 * r.randint(0, 8) + r.randint(0, 9) for _ in range(r.randint(1, 5))]
            out.append((f"{name}{i}", "c", r.choice("+-."), sorted((s, s + r.choice((20, 40, 60, 130, 900))) for s in starts)))
        return spark.createDataFrame(out, MODEL)

    q, ref = made("q", 150), made("r", 120)
    rank = F.expr(f"instr('{overlap.CODES}', c.class_code)")
    every = overlap.pairs(q, ref).select("q.id", F.col("r.id").alias("ref"), overlap.code().alias("c")).where("c.class_code is not null")
    want = every.groupBy("id").agg(F.min(F.struct(rank.alias("k"), (-F.col("c.letters")).alias("n"), "ref", "c.class_code")).alias("b")).select("id", "b.ref", "b.class_code")
    assert sorted(overlap.class_codes(q, ref).collect()) == sorted(want.collect())
    # what comes before the last step are not all pairs
    for kinds, last in overlap.STEPS:
        met = {tuple(x) for x in overlap.close_pairs(q, ref, kinds, 64).selectExpr("q.id", "r.id").collect()}
        upto = {(x.id, x.ref) for x in every.where(rank <= overlap.CODES.index(last) + 1).collect() if kinds == "iql" or x.c.class_code in "mnj"}
        assert upto <= met and len(met) < every.count() / 2

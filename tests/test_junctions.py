"""Peptides across junctions against a count of each model and peptide."""

import random

from pyspark.sql import functions as F

from evimap.operators import compare

MODEL = "struct<seqid:string,strand:string,regions:array<struct<start:long,end:long>>>"
PAIRS, LOCATED = f"qry_id long, p {MODEL}, r {MODEL}", "peptide string, seqid string, b array<struct<s:long,e:long>>"


def junctions(blocks):
    return {(x[1], y[0]) for x, y in zip(blocks, blocks[1:], strict=False)}


def by_hand(pairs, located):
    own, theirs, out = {}, {}, {}
    for key, p, r in pairs:
        if len(p[2]) > 1 and r[2]:
            a, b = junctions(sorted(p[2])), junctions(sorted(r[2]))
            own.setdefault(key, set()).update((p[0], j) for j in a - b)
            theirs.setdefault(key, set()).update((p[0], j) for j in b - a)
    for name, seqid, b in located:
        at = {(seqid, j) for j in junctions(sorted(b))}
        for key in own:
            against = theirs[key] & at
            if any(not any(j[1][0] == k[1][0] or j[1][1] == k[1][1] for k in against) for j in own[key] & at):
                out.setdefault(key, set()).add(name)
    return {k: len(v) for k, v in out.items()}


def test_junction_support_of_many(spark, monkeypatch):
    """Equal models and peptides, peptides at several of a model's junctions and at many, keys with several pairs, junctions that share an end."""
    monkeypatch.setattr(compare, "NAME_JUNCTIONS", 4)
    r = random.Random(3)

    def blocks(most):
        at = sorted(r.sample(range(1, 12), r.randint(1, most)))
        return [(10 * a, 10 * a + r.choice([3, 3, 5])) for a in at]

    models = [(r.choice("cd"), "+", blocks(7)) for _ in range(12)]
    pairs = [(r.randint(1, 90), r.choice(models), r.choice(models)) for _ in range(160)]
    places = [(r.choice("cd"), r.choice(models)[2][r.randint(0, 2) :][: r.randint(2, 6)]) for _ in range(25)] + [("c", [(30, 33), (30, 35), (50, 53)]), ("d", [(10, 13), (40, 43), (40, 45), (50, 53)])]
    located = [(f"n{r.randint(0, 60)}", *r.choice(places)) for _ in range(140)]
    want = by_hand(pairs, located)
    found = compare.junction_support(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(located, LOCATED))
    assert len(want) > 20 and {x.qry_id: x.splice_support for x in found.collect()} == want


def shuffled(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_models_and_peptides_at_a_place_are_not_paired(spark):
    """A thousand models and a thousand peptides at one junction: rows, not pairs, are exchanged."""
    before = set(shuffled(spark))
    pairs = spark.range(1000).select(F.col("id").alias("qry_id"), F.expr(f"cast(struct('c', '+', array(struct(1, 9), struct(21, 29))) as {MODEL})").alias("p"), F.expr(f"cast(struct('c', '+', array(struct(1, 9), struct(24, 29))) as {MODEL})").alias("r"))
    located = spark.range(1000).selectExpr("cast(id as string) as peptide", "'c' as seqid", "array(struct(5L as s, 9L as e), struct(21L as s, 25L as e)) as b")
    found = compare.junction_support(pairs, located).collect()
    assert len(found) == 1000 and {x.splice_support for x in found} == {1000}
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 50_000

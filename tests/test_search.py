"""Seeds, fuzzy and wildcard lookup against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from evimap.operators import search, seeds


def texts_of(r, letters, n, most):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("segment", [16, 4096])
@pytest.mark.parametrize("broadcast_chars", [3000, 1 << 20])
def test_occurrences_of_all_lengths(spark, monkeypatch, segment, broadcast_chars):
    """Segments shorter than patterns, patterns in several groups, one tile that is nearly everywhere, names that clash."""
    monkeypatch.setattr(seeds, "SEGMENT", segment)
    r = random.Random(7)
    texts = texts_of(r, "AAAAAB😀", 8, 120) + ["A" * 100, None, ""]
    some = [t[r.randint(0, 9) :][: r.randint(1, 70)] for t in texts if t for _ in range(4)] + ["A", "AB", "A" * 40, "", None, "ZZ"]
    targets = spark.createDataFrame(list(enumerate(texts)), "base long, text string")
    patterns = spark.createDataFrame(list(enumerate(some)), "key long, run string")
    found = seeds.search(targets, seeds.exact_runs(patterns, "key", "run"), "base", "text", F.col("found") == F.col("pattern"), broadcast_chars)
    want = sorted((i, k, at + 1) for i, t in enumerate(texts) if t for k, q in enumerate(some) if q for at in range(len(t)) if t.startswith(q, at))
    assert sorted((x.base, x.key, x.position) for x in found.collect()) == want


def proteins_and_peptides():
    r = random.Random(9)
    letters = search.ALPHABET + "I"
    proteins = texts_of(r, letters, 20, 90) + ["ACDEFGHIKL" * 9, "MX" + "LK" * 20, "ACD*EFGHI"]
    peptides = []
    for p in proteins:
        for _ in range(4):
            at, n = r.randint(0, max(0, len(p) - 5)), r.randint(5, 24)
            q = list(p[at : at + n].replace("X", "L").replace("*", "K"))
            for _ in range(r.choice([0, 1, 2, 3])):
                if q:
                    q[r.randrange(len(q))] = r.choice(letters)
            peptides.append("".join(q))
    return proteins, [*peptides, "ACD", "ACDB1", " ACDEF ", "", "AAAAA"]


@pytest.mark.parametrize("sites", [1, 2, 3])
def test_fuzzy_lookup(spark, sites):
    proteins, peptides = proteins_and_peptides()
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(proteins)], "id string, sequence string")
    got = search.fuzzy_lookup(spark.createDataFrame([(p,) for p in peptides], "peptide string"), rows, sites)
    assert got.columns == ["peptide", "protein", "position", "substitutions", "places"]
    want = set()
    for peptide in {p.strip() for p in peptides}:
        q, hits = peptide.replace("I", "L"), set()
        for i, p in enumerate(p.replace("I", "L") for p in proteins):
            for at in range(len(p) - len(q) + 1):
                own = p[at : at + len(q)]
                differ = [k for k in range(len(q)) if own[k] != q[k]]
                close = len(differ) <= sites and (sites < 3 or not differ or differ[-1] - differ[0] < 3)
                if len(q) >= 5 and set(q) <= set(search.ALPHABET) and close and set(own) <= set(search.ALPHABET):
                    hits.add((peptide, str(i), at + 1, len(differ), "".join(f"{k},{own[k]};" for k in differ)))
        want |= hits or {(peptide, "UNMAPPED", 0, None, None)}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_fuzzy_agrees_with_expanded_patterns(spark):
    """The same hits as looking up every pattern with X at free sites."""
    proteins, peptides = proteins_and_peptides()
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(proteins)], "id string, sequence string")
    asked = spark.createDataFrame([(p,) for p in peptides if 5 <= len(p.strip()) < 12 and set(p.strip()) <= set(search.ALPHABET + "I")], "peptide string")
    patterns = search.fuzzy(asked.select(F.trim("peptide").alias("peptide")), 2)
    each = search.lookup(patterns.select(F.col("pattern").alias("peptide")), rows, wildcards=True).withColumnRenamed("peptide", "pattern")
    by_pattern = patterns.join(each, "pattern").where("position > 0").select("peptide", "protein", "position").distinct()
    fuzzy = search.fuzzy_lookup(asked, rows, 2).where("position > 0").select("peptide", "protein", "position")
    assert sorted(map(tuple, by_pattern.collect())) == sorted(map(tuple, fuzzy.collect()))


def test_wildcard_lookup(spark):
    proteins, peptides = proteins_and_peptides()
    r = random.Random(1)
    asked = {"XXXXX", "XXXXXXA", "AXXXXXX", "XLKXXLKXX", "ACDEFGHIKL", "ACBXX", "AX"}
    for p in peptides[:-5]:
        q = [x if r.random() < 0.6 else "X" for x in p]
        asked.add("".join(q))
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(proteins)], "id string, sequence string")
    got = search.lookup(spark.createDataFrame([(p,) for p in asked], "peptide string"), rows, wildcards=True)
    want = set()
    for peptide in asked:
        q, hits = peptide.replace("I", "L"), set()
        for i, p in enumerate(p.replace("I", "L") for p in proteins):
            for at in range(len(p) - len(q) + 1):
                own = p[at : at + len(q)]
                if len(q) >= 5 and set(q) <= set(search.ALPHABET + "X") and set(own) <= set(search.ALPHABET) and all(b in (a, "X") for a, b in zip(own, q, strict=True)):
                    hits.add((peptide, str(i), at + 1))
        want |= hits or {(peptide, "UNMAPPED", 0)}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plain = search.lookup(spark.createDataFrame([("AXCDE",)], "peptide string"), spark.createDataFrame([("p", "AKCDE")], "id string, sequence string"))
    assert [tuple(x) for x in plain.collect()] == [("AXCDE", "UNMAPPED", 0)]


def test_no_sequence_is_shuffled(spark):
    """The plan of a search: exchanges carry windows' counts and hits, never a sequence's text."""
    targets = spark.createDataFrame([(1, "ACDEF" * 9)], "id long, s string")
    patterns = spark.createDataFrame([(1, "ACDEF")], "k long, p string")
    plan = search.occurrences(targets, patterns, "id", "s", "k", "p")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_variant_lookup(spark, tmp_path):
    """Peptides that span several variant sites, variants beyond the ends, stops, and the same residue as the sequence's."""
    from evimap.sources import annotations

    r = random.Random(12)
    proteins, peptides = [], {"ACDEF", "XXXXX", "ACD", "WWWWW"}
    for i in range(25):
        s = "".join(r.choice("ACDEFIKLM*") for _ in range(r.randint(0, 40)))
        v = [(r.randint(0, len(s) + 2), r.choice("ACDWIK*")) for _ in range(r.randint(0, 8))]
        proteins.append((f"p{i}", s, v))
        for _ in range(6):
            q = list(s.replace("*", "A"))
            for at, c in v:
                if 1 <= at <= len(q) and r.random() < 0.6 and c != "*":
                    q[at - 1] = c
            at = r.randint(0, max(0, len(q) - 5))
            peptides.add("".join(q[at : at + r.randint(5, 14)]))
    (tmp_path / "v.fa").write_text("#c\n" + "".join(f">{n} x \\VariantSimple={''.join(f'({a}|{c}{r.choice(['', '|tag'])})' for a, c in v)} y\n{s}\n" for n, s, v in proteins))
    rows = annotations.fasta_for_search(spark, str(tmp_path / "v.fa"))
    got = search.variant_lookup(spark.createDataFrame([(p,) for p in peptides], "peptide string"), rows)
    want, l = set(), lambda x: x.replace("I", "L")
    for peptide in peptides:
        q, hits = l(peptide), set()
        for n, s, v in proteins:
            s = l(s)
            allowed = [({c} | {l(x) for a, x in v if a == k + 1}) - {"*"} for k, c in enumerate(s)]
            for at in range(len(s) - len(q) + 1 if len(q) >= 5 and len(s) >= 5 and set(q) <= set(search.ALPHABET) else 0):
                if all(c in allowed[at + j] for j, c in enumerate(q)):
                    hits.add((peptide, n, at + 1, ";".join(f"{at + j + 1}:{s[at + j]}>{c}" for j, c in enumerate(q) if c != s[at + j])))
        want |= hits or {(peptide, "UNMAPPED", 0, None)}
    found = [tuple(x) for x in got.collect()]
    assert any(";" in (x[3] or "") for x in want) and set(found) == want and len(found) == len(want)


def test_windows_that_are_seeds(spark, monkeypatch):
    """All seeds among the windows come through, in slices of few letters; of the others next to none becomes a row."""
    monkeypatch.setattr(seeds, "HASHED", 50)
    r = random.Random(11)
    texts = [*texts_of(r, "ABCDEFGHIJ", 40, 300), "", None, "é\x00\x00😀\x00" * 9, "A\x00\x00\x00\x00"]
    kinds = [(5, 2), (3, 1)]
    cut = seeds.segments(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "i", "text", 20)
    every = [x.seed for x in seeds.windows(cut, kinds).select("seed").collect()]
    some = {*every[:30], "é\x00\x00😀\x00", "\x00\x00\x00", "\x00\x00"}
    found = seeds.seed_windows(cut, kinds, spark.createDataFrame([(x,) for x in some], "seed string"), 20)
    assert sorted(x.seed for x in found.collect() if x.seed in some) == sorted(x for x in every if x in some)
    assert found.count() < len(every) / 4
    for x in found.collect():
        assert texts[x._id][x.base + x.at :].startswith(x.seed) and texts[x._id][x.base :].startswith(x.text) and x.text[x.at :].startswith(x.seed)


def test_search_is_spread(spark):
    """Sequences that one task reads are searched by several."""
    proteins = spark.range(4000).coalesce(1).selectExpr("id", "concat('ACDEFGHIK', if(id % 2 = 0, 'LLNQ', 'MMNQ')) as sequence")
    peptides = spark.createDataFrame([(1, "DEFGHI"), (2, "KMMNQ")], "key int, peptide string")
    found = search.occurrences(proteins, peptides, "id", "sequence", "key", "peptide").groupBy("key", F.spark_partition_id()).count().collect()
    assert [len([x for x in found if x.key == k]) > 1 for k in (1, 2)] == [True, True]
    assert sum(x["count"] for x in found) == 6000


def test_what_is_found_is_not_dealt_by_peptide(spark):
    """A peptide that stands everywhere isn't brought to one task, and one that stands nowhere is UNMAPPED once."""
    every = spark.createDataFrame([("PEPI", "PEPL"), ("PEPL", "PEPL"), ("NONE", "NONE")], "peptide string, _p string")
    found = spark.range(0, 1000, 1, 4).selectExpr("'PEPL' as pattern", "cast(id as string) as protein", "id as position")
    rows = search._looked_up(every, found, ["protein", "position"])
    assert rows.where("protein <> 'UNMAPPED'").select(F.spark_partition_id()).distinct().count() > 1
    assert rows.count() == 2001 and [tuple(x) for x in rows.where("protein = 'UNMAPPED'").collect()] == [("NONE", "UNMAPPED", 0)]

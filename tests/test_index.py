import random

from evimap.operators import index, search


def test_index_lookup_agrees_with_the_search(spark, tmp_path):
    r = random.Random(8)
    letters = search.ALPHABET + "IX*"
    proteins = [(f"p{i}", "".join(r.choice(letters[:6] if i % 2 else letters) for _ in range(r.randint(0, 90)))) for i in range(40)] + [("long", "ACDEF" * 2000), ("none", None)]
    peptides = {"ACDEF" * 3, "CDEFACD", "WWWWW", "ACD", "AXCDE", "ACDEFA" + "W" * 9}
    for _, s in proteins:
        for _ in range(6 if s and len(s) < 100 else 0):
            at = r.randint(0, max(0, len(s) - 5))
            peptides.add(s[at : at + r.randint(5, 23)])
    rows, asked = spark.createDataFrame(proteins, "id string, sequence string"), spark.createDataFrame([(p,) for p in peptides], "peptide string")
    path = f"file://{tmp_path}/index"
    index.write_index(rows, path, buckets=6)
    got = sorted(map(tuple, index.index_lookup(spark, asked, path).collect()))
    assert got == sorted(map(tuple, search.lookup(asked, rows).collect())) and sum(x[1] != "UNMAPPED" for x in got) > 2000
    # another session finds the same files
    assert sorted(map(tuple, index.index_lookup(spark.newSession(), spark.newSession().createDataFrame([("CDEFACD",)], "peptide string"), path).collect()))[:1] == [("CDEFACD", "long", 2)]


def test_the_index_is_not_exchanged(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.write_index(spark.createDataFrame([("a", "ACDEFGHIKL" * 9)], "id string, sequence string"), path, buckets=6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        windows, counts, _ = index.open_index(spark, path)
        tiles = spark.createDataFrame([("ACDEFGHLKL", 0, "ACDEF"), ("ACDEFGHLKL", 5, "GHLKL")], "pattern string, off int, seed string")
        found = index.candidates(tiles, windows, counts)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().initialPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 9
    lines = plan.split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
    assert len(scans) == 2
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i in scans:  # up to the join that reads it
        level = depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < level:
                level = depth(line)
                assert "Exchange" not in line
                if "SortMergeJoin" in line:
                    break

"""Words that weak fingerprints take for one another, and columns with odd names."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from evimap.llm.common import Words

ODD = "doc_id long, text string, `a.b` int, `my col` string, keep_id int, kept boolean, node int, `check` int, _id int, `x``y` int, s struct<`p.q`: int>"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", 2, True, 3, 4, 5, 6, (7,)) for i, t in rows], ODD)


def thue_morse(bits=11):
    """Two different words of 2 ** bits letters that have one value under every polynomial modulo 2 ** 64 with an odd base."""
    a, b = "a", "b"
    for _ in range(bits):
        a, b = a + b, b + a
    return a, b


def test_fingerprints_tell_words_apart():
    a, b = thue_morse()
    words = ["", "a", "a\x00", "\x00a", "a" * 7, "a" * 8, "a" * 9, "a" * 15, "a" * 16, "a" * 17, "é", a, b, a[:15], b[:15]]
    made = Words(pa.array([" ".join(words), None, "", " a  a\x00\t" + a]))
    pairs = list(zip(made.fingerprints(0).tolist(), made.fingerprints(1).tolist(), strict=True))
    own = len(words) - 1
    assert len(set(pairs[:own])) == own and pairs[own:] == [pairs[0], pairs[1], pairs[words.index(a) - 1]]


def test_digests_are_of_words_joined_by_a_space():
    texts = ["x", " one\t two\n\n", None, "", "three", "  ", "a b c\x0bd "]
    made = Words(pa.array(texts))
    want = [hashlib.blake2b(" ".join((t or "").split()).encode(), digest_size=16).digest() for t in texts]
    assert made.digests(made.first[:-1], made.first[1:]).tobytes() == b"".join(want)
    assert made.digests(np.array([1, 4]), np.array([3, 6])).tobytes() == b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in (b"one two", b"a b"))


def test_words_that_collide_in_polynomials_stay_apart(spark):
    from evimap.llm.near_dedup import drop_near_duplicates, near_groups
    from evimap.llm.substring_dedup import repeated_words

    a, b = thue_morse()
    twelve = " ".join(f"w{i}" for i in range(12))
    got = repeated_words(odd_docs(spark, [(1, f"{twelve} {a}"), (2, f"{twelve} {b}"), (3, f"{twelve} {b}")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}
    docs = odd_docs(spark, [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")])
    assert sorted((r.doc_id, r.class_id) for r in near_groups(docs).collect()) == [(i, i) for i in (1, 2, 3, 4)]
    assert drop_near_duplicates(docs).count() == 4


def test_nodes_of_one_name_are_told_apart(spark):
    from evimap.llm.near_dedup import _apart

    rows = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 10)], "node long, `check` long")
    got = [tuple(r) for r in _apart(rows, spark.createDataFrame([(1,)], "node long")).collect()]
    names = {c: n for n, c in got if n != 2}
    assert len({n for n, _ in got}) == 3 and sorted(got) == sorted([(names[10], 10), (names[11], 11), (names[10], 10), (2, 10)])


@pytest.mark.parametrize("which", ["exact", "near", "sanitise", "quality"])
def test_rows_keep_columns_of_any_name(spark, which):
    from evimap.llm.exact_dedup import drop_exact_duplicates
    from evimap.llm.near_dedup import drop_near_duplicates
    from evimap.llm.pii import sanitise
    from evimap.llm.quality import keep_good

    apply = {"exact": drop_exact_duplicates, "near": drop_near_duplicates, "sanitise": sanitise, "quality": keep_good}[which]
    text = " ".join(f"word{i}" for i in range(30))
    docs = odd_docs(spark, [(1, text), (1, text), (None, text + " x@y.zz"), (4, None)])
    out = apply(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    want = {"exact": {1, None, 4}, "near": {1, 4}, "sanitise": {1, None, 4}, "quality": {1, None}}[which]
    assert set(got) == want and got[1]["a.b"] == 1 and got[1]["my col"] == "c" and got[1]["x`y"] == 6 and got[1].s["p.q"] == 7


@pytest.mark.parametrize("name", ["keep_id", "kept", "group_size", "text_sha256", "_id", "a.b"])
def test_id_columns_of_any_name(spark, name):
    from evimap.llm.exact_dedup import drop_exact_duplicates, exact_groups

    docs = spark.createDataFrame([(3, "a b"), (1, "ab"), (2, "c")], f"`{name}` long, text string")
    column = f"`{name}`"
    assert sorted(r[0] for r in drop_exact_duplicates(docs, id_col=column).collect()) == [2, 3]
    assert sorted(r[0] for r in exact_groups(docs, id_col=column).collect()) == [1, 2, 3]


def test_pipeline_takes_columns_of_any_name(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_docs(spark, [(1, " ".join(f"w{i}" for i in range(40))), (2, " ".join(f"w{i}" for i in range(40))), (3, " ".join(f"v{i}" for i in range(40)) + " a@b.cd")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_docs(spark, []).columns
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3]

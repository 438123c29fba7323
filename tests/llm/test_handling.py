"""Nulls, empty tables, repeated and equal ids, clashing column names, where test_operators doesn't have them."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from evimap.llm.queries import tokenizer

DOC = "doc_id long, text string, block int, ids int, kept string, start int, path string, row int, hits string, digest string, _row string, _words int, _carried int"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, "a", 3, "b", 4, "c", "d", "e", 5, 6) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def ids_of(name, text, end=None):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids
    return ids + ([end] if end is not None else [])


def test_empty_tables(spark):
    from evimap.llm.bpe_chunks import decode, encode
    from evimap.llm.packing import pack
    from evimap.llm.quality import keep_good, ledger, verdicts

    none = docs_of(spark, [])
    assert pack(none, tokenizer("word_bpe_49k.json"), 2).collect() == []
    assert decode(encode(none, tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")).collect() == []
    assert verdicts(ledger(none)).collect() == [] == keep_good(none).collect()


def test_empty_token_files(spark, tmp_path):
    from evimap.llm.token_files import read_documents, write_token_files

    folder = f"file://{tmp_path}/out"
    assert write_token_files(docs_of(spark, []), folder, tokenizer("word_bpe_49k.json"), 1).collect() == []
    assert read_documents(spark, folder).collect() == []


def test_null_and_equal_ids_in_token_files(spark, tmp_path):
    from evimap.llm.token_files import read_documents, write_token_files

    texts, ids = ["b b", "a", None, "c", "z"], [4, 4, None, 4, 1]
    folder = f"file://{tmp_path}/out"
    write_token_files(docs_of(spark, texts, ids), folder, tokenizer("word_bpe_49k.json"), 1).collect()
    got = [(r.doc_id, bytes(r.ids)) for r in read_documents(spark, folder).orderBy("start").collect()]
    want = [(i, np.array(ids_of("word_bpe_49k.json", t, 1), "<u4").tobytes()) for i, t in ((None, None), (1, "z"), (4, "a"), (4, "b b"), (4, "c"))]
    assert got == want


def test_null_and_equal_ids_in_packing(spark, tmp_path):
    from evimap.llm.packing import pack, write_buckets

    texts = ["one two three", "one two three", None, "x " * 9000]
    pieces = pack(docs_of(spark, texts, [5, 5, None, None]), tokenizer("word_bpe_49k.json"), 2)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, ts in ((5, texts[:2]), (None, texts[2:])):
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == sum(len(ids_of("word_bpe_49k.json", t, 2)) for t in ts)
        assert all(r.start + r.length <= r.doc_tokens for r in own)
    write_buckets(pieces, f"file://{tmp_path}/buckets")
    back = spark.read.parquet(f"file://{tmp_path}/buckets")
    assert sorted((r.length, zlib.crc32(bytes(r.ids))) for r in back.collect()) == sorted((r.length, zlib.crc32(bytes(r.ids))) for r in rows)


def test_null_and_equal_ids_in_substrings(spark):
    from evimap.llm.substring_dedup import repeated_words

    passage = " ".join(f"w{i}" for i in range(20))
    texts, ids = [passage, passage + " tail", "head " + passage, passage, passage], [3, 3, 9, None, None]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in repeated_words(docs_of(spark, texts, ids)).collect())
    # equal ids are parts of one document; a null id comes after any other
    assert got == [(False, 3, 20, 0), (False, 3, 21, 0), (False, 9, 21, 20), (True, 0, 20, 20), (True, 0, 20, 20)]
    alone = repeated_words(docs_of(spark, [passage, passage], [None, None])).collect()
    assert [r.n_removed for r in alone] == [0, 0]


def test_joins_that_do_not_agree_are_widened():
    from evimap.llm.bpe_chunks import ChunkEncoder

    text = " ".join(f"word{i * 7919 % 1000} don't stop" for i in range(400))
    enc = ChunkEncoder(tokenizer("byte_bpe_50k.json"))
    want = np.array(ids_of("byte_bpe_50k.json", text), "<u4").tobytes()
    assert enc.encode([text]) == [want] and enc.repaired > 10 and not enc.widened
    for c in list(enc.memo.values())[::2]:
        if c.text:
            c.last = (c.last[0], b"none")
    assert enc.encode([text]) == [want] and enc.widened  # the core agrees
    for c in enc.memo.values():
        c.ids = c.ids[:-4] + b"none"
    assert enc.encode([text]) == [want]  # only the whole text does


def test_chunks_of_hostile_texts():
    import random

    from evimap.llm.bpe_chunks import ChunkEncoder

    r = random.Random(8)
    enc = ChunkEncoder(tokenizer("byte_bpe_50k.json"))
    marks = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\x1c", "é", "e\u0301", "中", "😀", "'s", "1", "!!", "<|endoftext|>", "\x00"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 900))) for _ in range(120)] + ["", "x" * 5000, " " * 3000, "\n" * 700]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of("byte_bpe_50k.json", t) for t in texts]


def test_sanitise_keeps_columns_of_any_name(spark):
    from evimap.llm.pii import sanitise

    rows = docs_of(spark, ["mail a@b.cd", None, "clean", "clean"], [1, None, 2, 2])
    out = sanitise(rows)
    assert out.columns == rows.columns
    assert sorted(map(str, out.drop("text").collect())) == sorted(map(str, rows.drop("text").collect()))
    assert sorted(str(r.text) for r in out.collect()) == ["None", "clean", "clean", "mail [EMAIL]"]


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = {}
    for k in range(len(w) - 4):
        counts.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + j for places in counts.values() if len(places) > 1 for k in places for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_plain_counts(spark):
    from evimap.llm.quality import POLICIES, RULES, ablations, ledger, mask, verdicts

    long = " ".join(f"w{i % 97} x{i % 89}" for i in range(6000))
    texts = ["a b c d e f " * 40, "x " * 6, long, long + " a b c d e a b c d e", "#$% |\n#$% |\n  \n#$% |", None, "", "😀 é\u00a0x", "one\ntwo\none\n" * 9, "ok words " + " ".join(f"n{i}" for i in range(30))]
    got = {r.doc_id: r for r in verdicts(ledger(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_quality(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, i
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    bits = [r.failed_bits for r in got.values()]
    table = {(r.policy, r.rule): (r.rejected, r.alone) for r in ablations(ledger(docs_of(spark, texts))).collect()}
    for policy, rules in POLICIES.items():
        for rule in rules:
            bit = 1 << list(RULES).index(rule)
            want = (sum(b & bit != 0 for b in bits), sum(b & mask(rules) == bit for b in bits))
            assert table.get((policy, rule), (0, 0)) == want


def test_pipeline_takes_what_comes(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(None, words(1), None, None, None), (4, words(2), "en", None, 3), (4, words(2), "en", None, 3), (4, words(3), None, "s", None), (5, None, "en", "s", 0), (6, "", None, None, None), (None, words(1) + " more", None, None, None), (7, words(4) + " a@b.cd", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect())
    # of the two null ids one text stays; equal ids on different texts both stay; texts without words go
    assert [(n, i) for n, i, _ in kept] == [(False, 4), (False, 4), (False, 7), (True, 0)] and kept[2][2].endswith("[EMAIL]")
    last = corpus_pipeline.STAGES[-1][1]
    packed = last(spark, docs, "").collect()
    by_doc = {}
    for r in packed:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc[7] == len(ids_of("word_bpe_49k.json", kept[2][2], 2))
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty_ = stage(spark, empty, "")
        assert empty_.collect() == []


def test_pipeline_quality_and_digest(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["a b c d e " * 30, "too few words", " ".join(f"w{i}" for i in range(40))])]
    out = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, schema), "").collect()
    assert [hashlib.sha256(r.text.encode()).hexdigest() for r in out] == [hashlib.sha256(rows[2][1].encode()).hexdigest()]

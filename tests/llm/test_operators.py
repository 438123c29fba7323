import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from evimap.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long, row int, ids int, text_sha256 string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def corpus():
    r = random.Random(3)
    words = ["than", "Word,", "naïve", "x1", "don't", "1234", "«q»", "mañana.", "###", "a\tb", "<|endoftext|>", "\u00a0", "中文"]
    line = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    shared = line(60)
    texts = [None, "", " \n\t ", "one", "a b c d e", *(line(r.randint(1, 80)) for _ in range(30)), shared, line(20) + " " + shared, shared + "\n" + line(5), (line(50) + "\n") * 3, line(9000)]
    texts += [texts[8], texts[8].replace(" ", "\n "), "mail a.b@c.de, +1 (555) 010-9999 or 10.0.0.255; 10.0.0.256 4111 1111 1111 1111!"]
    return texts


def ids_of(name, text, end=None):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids
    return ids + ([end] if end is not None else [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_groups(spark):
    from evimap.llm.exact_dedup import drop_exact_duplicates, exact_groups

    texts = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    got = {r.doc_id: r for r in exact_groups(docs_of(spark, texts)).collect()}
    for i, n in enumerate(norm):
        group = [j for j, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest())
    twice = docs_of(spark, [*texts, texts[5], "n", "n"], [*range(len(texts)), 5, None, None])
    out = drop_exact_duplicates(twice).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(i for i in got if got[i].kept) and len(out) == len({*norm, "n"})
    assert exact_groups(docs_of(spark, [])).collect() == []


def test_exact_keeps_columns_of_any_name(spark):
    from evimap.llm.exact_dedup import drop_exact_duplicates

    schema = "doc_id long, text string, _len string, _sha string, _nth string, _keep_id string, _id string, doc string, _salt string, m map<string,int>"
    rows = [(i, t, *"keep", "x", str(i), "s", {"a": i}) for i, t in enumerate(["a b", "ab", "c", None, " ", "c"])]
    out = drop_exact_duplicates(spark.createDataFrame(rows, schema))
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [rows[i] for i in (0, 2, 4)]


def test_exact_clashing_digests(spark, monkeypatch):
    from evimap.llm import exact_dedup
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c, 1, 1))
    texts = ["a1", "a 2", "a2", "a1 ", "b", "b"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs_of(spark, texts)).collect()}
    assert got == {0: (3, 2, False), 3: (3, 2, True), 1: (1, 2, True), 2: (1, 2, False), 4: (4, 2, True), 5: (4, 2, False)}


def test_substrings(spark):
    from evimap.llm.substring_dedup import repeated_words

    texts = corpus()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in repeated_words(docs_of(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert sum(r.n_removed for r in got.values()) > 100
    assert repeated_words(docs_of(spark, [])).collect() == []


def test_packing(spark):
    from evimap.llm.packing import pack

    texts = corpus()
    rows = pack(docs_of(spark, texts), tokenizer("word_bpe_49k.json"), 2).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in own)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids_of("word_bpe_49k.json", t, 2), "<u4").tobytes()
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]


def test_bpe_chunks(spark):
    from evimap.llm.bpe_chunks import decode, encode

    texts = corpus()
    rows = {r.doc_id: r for r in decode(encode(docs_of(spark, texts), tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == ids_of("byte_bpe_50k.json", t) and rows[i].decoded == (t or "")


def test_chunks_of_shared_passages_are_reused():
    from evimap.llm.bpe_chunks import ChunkEncoder

    r = random.Random(1)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(6))
    passage = " ".join(word() for _ in range(3000))
    enc = ChunkEncoder(tokenizer("byte_bpe_50k.json"))
    texts = [passage, word() + " " + passage, word() + word() + passage + word()]
    for t in texts:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == ids_of("byte_bpe_50k.json", t)
    assert enc.reused > 0.6 * (enc.reused + enc.encoded)


def test_token_files(spark, tmp_path):
    from evimap.llm.token_files import Shard, read_documents, write_token_files

    texts = corpus()
    folder = f"file://{tmp_path}/out"
    manifest = write_token_files(docs_of(spark, texts), folder, tokenizer("word_bpe_49k.json"), 1, length=64).collect()
    got = {r.doc_id: r for r in read_documents(spark, folder).collect()}
    at, stream = 0, []
    for i, t in enumerate(texts):
        ids = ids_of("word_bpe_49k.json", t, 1)
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (at, len(ids), crc(ids))
        at, stream = at + len(ids), stream + ids
    first = min(manifest, key=lambda r: r.first_token)
    ids, mask = Shard(folder, first.name).sequence(1)
    assert ids.tolist() == stream[64:128] and np.unpackbits(mask).all() and not ids.flags.owndata


def test_pii_base_and_disclosure(spark):
    from evimap.llm.pii import digests, pii_spans, sanitise

    texts = corpus()
    got = {r.doc_id: r for r in digests(pii_spans(docs_of(spark, texts))).collect()}
    last = got[len(texts) - 1]
    # the card's number runs on from 256 before it, so it has too many digits for its check
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 0, 1)
    r = random.Random(2)
    rare = lambda: "".join(r.choice("bcdfgh") for _ in range(9))
    docs = [f"{rare()} {rare()} Quillfeather boss@firm.org {rare()} {rare()} {rare()}" for _ in range(6)] + [f"{rare()} clean text {rare()}" for _ in range(40)]
    out = {x.doc_id: x.text for x in sanitise(docs_of(spark, docs)).collect()}
    assert all("Quillfeather" not in out[i] and "[EMAIL]" in out[i] for i in range(6))
    assert all(out[i] == docs[i] for i in range(6, 46))
    assert sanitise(docs_of(spark, [])).collect() == []


def test_pii_candidates_are_all_words_and_copies_count_once(spark):
    from evimap.llm.pii import sanitise

    r = random.Random(7)
    rare = lambda n: " ".join("".join(r.choice("bcdfgh") for _ in range(9)) for _ in range(n))
    two = [f"Quillfeather {rare(40)} boss@firm.org {rare(5)}" for _ in range(2)]
    copied = f"{rare(30)} Wend 10.1.2.3 {rare(30)}"
    copies = [copied, copied, copied + " " + rare(1), copied]
    docs = two + copies + [f"{rare(1)} clean text" for _ in range(2000)]
    out = {x.doc_id: x.text for x in sanitise(docs_of(spark, docs)).collect()}
    assert [out[i] for i in (0, 1)] == [docs[i].replace("Quillfeather", "").replace("boss@firm.org", "[EMAIL]") for i in (0, 1)]
    assert [out[i] for i in range(2, 6)] == [x.replace("10.1.2.3", "[IP]") for x in copies]
    assert all(out[i] == docs[i] for i in range(6, len(docs)))


def test_pii_terms_go_wherever_they_stand(spark):
    from evimap.llm.pii import pii_spans, sanitise

    r = random.Random(8)
    rare = lambda n: " ".join("".join(r.choice("bcdfgh") for _ in range(9)) for _ in range(n))
    docs = [f"Quillfeather boss@firm.org {rare(50)} (Quillfeather) {rare(3)}" for _ in range(6)] + [f"{rare(9)} Quillfeather, {rare(9)}", f"{rare(2)} Quillfeathers"] + [f"{rare(1)} clean text" for _ in range(40)]
    out = {x.doc_id: x.text for x in sanitise(docs_of(spark, docs)).collect()}
    assert all("Quillfeather" not in out[i] for i in range(7))
    assert all(out[i] == docs[i] for i in range(7, len(docs)))
    places = {x.doc_id: [docs[x.doc_id][s.start : s.end] for s in x.terms] for x in pii_spans(docs_of(spark, docs)).collect()}
    assert [len(places[i]) for i in range(8)] == [2] * 6 + [1, 0] and {w for p in places.values() for w in p} == {"Quillfeather"}


#: The four base kinds as they are prescribed.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0

    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text) if good[k](m[0])]
    return sorted(found)


def test_pii_base_spans_match_plain_search():
    from evimap.llm.pii import base_spans

    r = random.Random(5)
    marks = {
        "email": ["a", "@", ".", " ", "-", "_", "é", "b1", "@x.y", "%"],
        "numbers": [*"0123456789", "255", "256", "4111111111111111", "4111 1111 1111 1111", ".", ".", "-", " ", "+", "(", ")", "+1 555", "10.0.0.1", "a", "٣"],
    }
    for kind in marks.values():
        for _ in range(6000):
            t = "".join(r.choice(kind) for _ in range(r.randint(0, 24)))
            assert base_spans(t) == plain_spans(t), t
    assert {k for t in ["a@b.c", "1.2.3.4 ", "4111 1111 1111 1111", "+1 (555) 010-9999"] for _, k, _ in plain_spans(t)} == {0, 1, 2, 3}


def test_pii_scans_long_runs_quickly():
    from evimap.llm.pii import base_spans

    n = 1_000_000
    for text in ("1" * n, "a" * n + "@", "a." * (n // 2) + "@b", "1." * (n // 2), "+" + "1" * n, "+1" + "(" * n, "1-" * (n // 2), "@" * n, "a@b" * (n // 3)):
        began = time.process_time()
        base_spans(text)
        assert time.process_time() - began < 4, text[:9]


def test_pii_digests(spark):
    from evimap.llm.pii import digests, pii_spans

    texts = corpus() + ["x@y.zz 1.2.3.4 +1 (555) 010-9999 and 4111-1111-1111-1111", "😀 a@b.cd", "4111 1111 1111 1112", "+123"]
    kinds = list(PII)
    for row in digests(pii_spans(docs_of(spark, texts))).collect():
        spans = plain_spans(texts[row.doc_id] or "")
        base = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert [row[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(row.spans.split(","))


def test_near_groups(spark):
    from evimap.llm.near_dedup import drop_near_duplicates, near_groups

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = [None, "", "a b", "a b", *(" ".join(word() for _ in range(120)) for _ in range(20))]
    for k in range(12):
        w = list(base)
        for at in r.sample(range(300), 2):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base), " ".join(base).replace(" ", "\n"), " ".join(base[:150] + base[:0:-1][:150])]
    got = {x.doc_id: x for x in near_groups(docs_of(spark, texts)).collect()}
    assert {got[i].class_id for i in range(24, 38)} == {24} and got[24].class_size == 14
    assert [got[i].class_id for i in (0, 1, 2, 3, 5, 38)] == [0, 1, 2, 2, 5, 38]
    assert sorted(x.doc_id for x in drop_near_duplicates(docs_of(spark, texts)).collect()) == [0, 1, 2, *range(4, 25), 38]
    assert near_groups(docs_of(spark, [])).collect() == []


def test_alignment_against_plain_lcs():
    from evimap.llm.near_dedup import _by_bits, aligned

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(6)
    for _ in range(300):
        x = [r.randint(0, 12) for _ in range(r.randint(1, 30))]
        y = [v for v in x if r.random() < 0.9] or [1]
        true = lcs(x, y)
        assert _by_bits(x, y, 100) == true
        for need in range(1, true + 1):
            assert aligned(np.array(x, np.uint32), np.array(y, np.uint32), need) >= need
        assert aligned(np.array(x, np.uint32), np.array(y, np.uint32), true + 1) <= true


def test_quality_ledger(spark):
    from evimap.llm.quality import ablations, keep_good, ledger, verdicts

    texts = [*corpus(), "a b c d e f " * 40, "x " * 6]
    got = {r.doc_id: r for r in verdicts(ledger(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)} if len(w) < 2000 else set()
        assert got[i].n_words == len(w) and got[i].n_repeat_words == len(covered)
    assert sorted(r.doc_id for r in keep_good(docs_of(spark, texts)).collect()) == sorted(i for i in got if got[i].kept)
    assert keep_good(docs_of(spark, texts)).columns == docs_of(spark, texts).columns
    table = {(r.policy, r.rule): (r.rejected, r.alone) for r in ablations(ledger(docs_of(spark, texts))).collect()}
    assert table["v1", "few_words"][0] == sum(r.n_words < 10 for r in got.values())


def test_url_filter(spark):
    from evimap.llm.url_filter import judge

    rules = [("org", "/", "allow"), ("b.org", "/x/", "block"), ("b.org", "/x/ok", "allow"), ("com", "", "block")]
    urls = [None, "", "b.org/x/", "http://B.ORG/x/1?q", "http://a.b.org/x/okay#f", "s://nb.org/x/", "http://z.com", "http://b.org?x/", "s://b.org/x"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    schema = "page_id long, url string"
    rows = [*enumerate(urls), (None, "s://z.com"), (1, None), (1, None)]
    by_trie = judge(spark.createDataFrame(rows, schema), rules)
    by_join = judge(spark.createDataFrame(rows, schema), rules, most=0)
    assert sorted(map(str, by_trie.collect())) == sorted(map(str, by_join.collect())) and by_trie.count() == len(rows)
    assert judge(spark.createDataFrame([], schema), rules).collect() == [] == judge(spark.createDataFrame([], schema), rules, most=0).collect()
    assert got == [("", "", None, "allow")] * 3 + [("b.org", "/x/1", "b.org/x/", "block"), ("a.b.org", "/x/okay", "b.org/x/ok", "allow"), ("nb.org", "/x/", "org/", "allow"), ("z.com", "", "com", "block"), ("b.org", "", None, "allow"), ("b.org", "/x", "org/", "allow")]


def test_url_ties(spark):
    from evimap.llm.url_filter import judge

    pages = spark.createDataFrame([(1, "s://a.b.org/x/"), (2, "s://c.org/")], "page_id long, url string")
    for order in (1, -1):
        rules = [("b.org", "/x/", "allow"), ("a.b.org", "/", "block"), ("c.org", "/", "allow"), ("c.org", "/", "block")][::order]
        for most in (0, 9):
            assert [(r.rule, r.verdict) for r in judge(pages, rules, most=most).orderBy("page_id").collect()] == [("a.b.org/", "block"), ("c.org/", "block")]


def test_pipeline_keeps_one_of_each(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(8)]
    texts += [texts[0], texts[1] + " tail", "too short", "### " * 30, texts[2].replace(" ", "  ")]
    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(x.doc_id for x in docs.collect()) == [0, 1, 3, 4, 5, 6, 7, 12]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == 8

"""Alignment, best-fit packing and vector codes against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evimap.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
DOC = "doc_id long, text string, pair long, row string, documents int, task int, length string, ids int, rank int, `a.b` int, `my col` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y", 4, 5, 6, 7) for i, t in rows], DOC)


def texts():
    r = random.Random(5)
    words = ["than", "Word,", "naïve", "x1", "don't", "«q»", "中文字", "<s>", "</s>", "<|endoftext|>", "🙂🙃", "é", "====", "aaaaaaaaaaaaa", "0x0A", "<0x0A>"]
    gap = [" ", "  ", "\n", "\t", " \n ", " ", "\r\n", "   "]
    some = lambda n: "".join(r.choice(words) + r.choice(gap) for _ in range(n))
    return [None, "", " ", "  two", "\n", "a▁b", "▁", "a\x00b c", "one", *(some(r.randint(1, 60)) for _ in range(40)), some(3000), "z" * 5000, "�\U0010ffff é" * 50]


def brute_alignment(rows):
    """doc -> values of the contract, by pairs of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    from evimap.llm.bpe import byte_letters

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_letters().items()}
    spec = {i: t.content.encode() for i, t in a.get_added_tokens_decoder().items()}
    piece = lambda s: bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode()
    out, held = [], []
    for _, text in rows:
        whole = " " + (text or "")
        ia, ib = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        ba = [spec.get(i) or bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        bb = [piece(b.id_to_piece(i)) for i in ib]
        if not text or b"".join(ba) != whole.encode() or b"".join(bb) != whole.encode():
            ia, ib, ba, bb = [], [], [], []
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(ba), ends(bb)
        both = sorted(set(ea) & set(eb))
        groups = [([i for i, e in zip(ia, ea, strict=True) if lo < e <= hi], [i for i, e in zip(ib, eb, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *both], both, strict=False)]
        held.append((ia, ib, groups, Counter((x, y) for ga, gb in groups for x in ga for y in gb)))
    count = Counter(p for *_, links in held for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (doc, _), (ia, ib, groups, links) in zip(rows, held, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        sha = hashlib.sha256(text.encode()).hexdigest() if ia else ""
        out.append((doc, len(ia), len(ib), len(groups), sum(links.values()), sha, n_best, sum(n * count[p] for p, n in links.items())))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("broadcast_pairs", [1 << 20, 0])
def test_alignment_against_brute_force(spark, broadcast_pairs):
    from evimap.llm.alignment import link_scores

    rows = list(enumerate(texts())) + [(4, "one"), (None, "one two"), (None, "one two"), (4, None)]
    got = link_scores(docs_of(spark, rows).repartition(3), A, B, broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert order(map(tuple, got.collect())) == order(brute_alignment(rows))


def test_alignment_of_an_empty_table(spark):
    from evimap.llm.alignment import link_scores

    assert link_scores(docs_of(spark, []), A, B).collect() == []


def test_alignment_pairs_of_a_long_group(spark):
    """A group of many tokens of few ids stays as small as its ids."""
    from evimap.llm.alignment import _aligned_unit

    n = 20_000
    unit = ([7, 8] * n, [*range(1, 2 * n), 5 * n], [1] * n, [*range(2 * n, 3 * n - 1), 5 * n])
    row = spark.createDataFrame([(unit,)], "u struct<a:array<int>,a_ends:array<int>,b:array<int>,b_ends:array<int>>")
    got = row.select(_aligned_unit(row["u"]).alias("x")).select("x.*").first()
    assert got.groups == 1 and got.links == 2 * n * n and sorted(zip(got.a, got.b, got.times, strict=True)) == [(7, 1, n * n), (8, 1, n * n)]


def test_alignment_of_units_between_all_marks(spark):
    """Texts are cut between letters, digits, marks and white space; contractions and runs of white space are not."""
    from evimap.llm.alignment import link_scores

    r = random.Random(11)
    parts = ["a", "re", "x", "7", "42", "'", "'s", "'ll", ".", ",", "<s>", "\n", "\n\n", "\t", "\r\n", " ", " ", "  ", "\xa0", "\u3000", "\x85", "\x1c", "\x00", "\x01", "\x7f", "é", "ß", "中", "🙂", "▁"]
    rows = [(i, "".join(r.choice(parts[:-1] if i % 9 else parts) for _ in range(r.randint(1, 120)))) for i in range(400)]
    got = link_scores(docs_of(spark, rows).repartition(2), A, B)
    assert order(map(tuple, got.collect())) == order(brute_alignment(rows))


def test_alignment_looks_at_shapes_and_keeps_distinct_pairs(spark):
    """Units of equal ends are aligned once, and a document's pairs stand there once with their number."""
    from evimap.llm.alignment import aligned, tokens

    r = random.Random(3)
    words = ["".join(r.choice(["th", "on", "er", "ing", "and", "ea"]) for _ in range(r.randint(1, 4))) for _ in range(4000)]
    docs = docs_of(spark, [(i, " ".join(r.choice(words) for _ in range(2000))) for i in range(3)]).coalesce(1)
    slice_ = tokens(docs, A, B).first()
    assert len(slice_.shapes) * 2 < len(slice_.shape) and not slice_.long
    for row in aligned(docs, A, B).collect():
        assert len(set(zip(row.a, row.b, strict=True))) == len(row.a) == len(row.b) and sum(row.times) == row.n_links > len(row.a)


def test_alignment_carries_documents_past_spark_as_one_value(spark):
    """What isn't aligned by Spark is one compressed value of a row, far smaller than its arrays, and reads back whole."""
    import pyarrow as pa

    from evimap.llm.alignment import _unpacked, tokens

    r = random.Random(4)
    words = ["".join(r.choice(["th", "on", "er", "ing", "and", "ea"]) for _ in range(r.randint(1, 4))) for _ in range(2000)]
    found = tokens(docs_of(spark, [(7, " ".join(r.choice(words) for _ in range(20_000))), (None, "one two"), (8, None), (9, "a▁b")]).coalesce(1), A, B)
    assert found.columns == ["shape", "shapes", "long", "rest"]
    row = found.first()
    rest = _unpacked(pa.scalar(bytes(row.rest), pa.binary()))
    assert rest["doc_id"].to_pylist() == [7, None, 8, 9] and rest["size"].to_pylist()[1:] == [2, 0, 0] and len(rest["units"]) == sum(rest["size"].to_pylist()) == 20_002
    assert len(row.rest) * 2 < sum(x.nbytes for x in rest.values())


def test_plan_is_best_fit_decreasing():
    from evimap.llm.best_fit import plan

    r = random.Random(2)
    for longest in (1, 7, 32, 100):
        for _ in range(20):
            counts = {n: r.choice([1, 2, 3, 50]) for n in r.sample(range(1, longest + 1), r.randint(1, longest))}
            room: list[int] = []  # best fit, piece by piece
            for n in sorted(counts, reverse=True):
                for _ in range(counts[n]):
                    fits = [i for i, x in enumerate(room) if x >= n]
                    if fits:
                        room[min(fits, key=lambda i: room[i])] -= n
                    else:
                        room.append(longest - n)
            used = defaultdict(list)
            for length, first, last, sequence, each, place in plan(counts, longest):
                for i in range(last - first):
                    used[sequence + i // each].append((place + i % each * length, length))
            assert sum(len(x) for x in used.values()) == sum(counts.values())
            for spans in used.values():
                at = 0
                for start, length in sorted(spans):
                    assert start == at
                    at += length
                assert at <= longest
            assert len(used) == len(room)


def test_plan_of_many_pieces_is_small():
    from evimap.llm.best_fit import plan

    r = random.Random(4)
    rows = plan({n: r.randint(1, 10**9) for n in range(1, 1025)}, 1024)
    assert len(rows) < 20_000


def test_best_fit_packing(spark):
    from tokenizers import Tokenizer

    from evimap.llm.best_fit import assign, pack_best_fit, pieces, plan, sequences

    rows = list(enumerate([None, "", "one", "a b c", "long text " * 300, *("w " * n for n in range(1, 40)), *["same text here"] * 30])) + [(3, "a b c"), (None, "x"), (None, "x")]
    encode = Tokenizer.from_file(A)
    ids = [(d, encode.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    longest = 64
    got = pack_best_fit(docs_of(spark, rows).repartition(3), A, 2, longest).collect()
    want = []
    for doc, x in ids:
        first = len(x) % longest or longest
        cuts = [0, *range(first, len(x), longest), len(x)] if len(x) > longest else [0, len(x)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= longest
    counts = Counter(r[3] for r in want)
    assert len(held) == len({s + i // each for _, a, b, s, each, _ in plan(counts, longest) for i in range(b - a)})
    # the sequences themselves hold each document's ids
    cut = pieces(docs_of(spark, rows), A, 2, longest)
    found = defaultdict(dict)
    for r in sequences(cut, longest).collect():
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(own) == r.n_tokens <= longest
        for s in r.spans:
            found[s.doc_id][s.start] = own[s.offset : s.offset + s.length]
    assert [i for _, x in sorted(found[4].items()) for i in x] == dict(ids)[4]
    assert assign(pieces(docs_of(spark, []), A, 2)).collect() == [] == sequences(pieces(docs_of(spark, []), A, 2)).collect()


def brute_codes(rows, rounds=6, entries=16):
    from math import floor, isfinite

    kept = [(i, l, [floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    if not kept:
        return []
    size = -(-max(len(v) for *_, v in kept) // 8) * 8
    limit = 1 << 62
    kept = [(i, l, [min(limit, max(-limit, x)) for x in v]) for i, l, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    w = max(1, size // 8)
    parts = [[(v + [0] * (8 * w))[p * w : (p + 1) * w] for *_, v in kept] for p in range(8)]
    books = [own[:entries] for own in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            of = defaultdict(list)
            for x in parts[p]:
                of[near(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    found = [[near(parts[p][n], books[p]) for p in range(8)] for n in range(len(kept))]
    error = [min((1 << 63) - 1, sum(d for d, _ in f)) for f in found]
    labels = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min((1 << 63) - 1, labels[label]), sha) for (i, label, _), f, e in zip(kept, found, error, strict=True)]


VEC = "vec_id long, embedding array<float>, label int, code string, error int, v int, slot int, _label int, `a.b` int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3, 4, 5) for i, v, label in rows], VEC)


def vector_rows(kind):
    r = random.Random(kind)
    f = lambda x: float(np.float32(x))
    grid = lambda: f(r.randint(-2, 2) / 4096)  # ties everywhere
    size, value = {"ties": (16, grid), "wide": (64, lambda: f(r.gauss(0, 0.2))), "odd": (None, lambda: f(r.gauss(0, 1))), "huge": (8, lambda: f(r.choice([1e30, -3e38, 1e12, 5.5, 0.0])))}[kind]
    rows = [(r.randint(0, 50), [value() for _ in range(r.randint(0, 20) if size is None else size)], r.choice([1, 2, None])) for _ in range(150)]
    bad = [(1, None, 1), (2, [None] * 16, 2), (None, [1.0] * 8, None), (3, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, 1), (0, [0.5] * 16 + [float("-inf")], 1)]
    return rows + bad + rows[:5]


@pytest.mark.parametrize("kind", ["ties", "wide", "odd", "huge"])
@pytest.mark.parametrize("broadcast_labels", [100, 0])
def test_codes_against_brute_force(spark, kind, broadcast_labels):
    from evimap.llm.codes import compress

    rows = vector_rows(kind)
    got = compress(vectors_of(spark, rows).repartition(3), broadcast_labels=broadcast_labels)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(map(tuple, got.collect())) == order(brute_codes(rows))


def test_codes_of_few_and_no_vectors(spark):
    from evimap.llm.codes import compress, decode, encode, fit, integers

    few = [(2, [1.0, 2.0], 1), (1, [], None), (2, [1.0, 2.0], 1)]
    assert order(map(tuple, compress(vectors_of(spark, few)).collect())) == order(brute_codes(few))
    assert compress(vectors_of(spark, [])).collect() == [] == compress(vectors_of(spark, [(1, None, 1)])).collect()
    held = integers(vectors_of(spark, few))
    back = decode(encode(held, fit(held)), fit(held)).orderBy("vec_id").collect()
    assert [r.v for r in back] == [[0] * 8, [4096, 8192, *[0] * 6], [4096, 8192, *[0] * 6]]


def test_tree_prunes_and_keeps_lower_indexes():
    from evimap.llm.codes import Tree

    r = np.random.default_rng(1)
    for k in (1, 2, 3, 16, 100):
        entries, x = r.integers(-3, 4, (k, 4)), r.integers(-4, 5, (2000, 4))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, distance = Tree(entries).nearest(x)
        assert (code == far.argmin(1)).all() and (distance == far.min(1)).all()

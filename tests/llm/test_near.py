import random
import re

from evimap.llm.near_dedup import drop_near_duplicates, near_groups

DOC = "doc_id long, text string, node long, key string, class_id string, _nth int, m map<string,int>"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "k", "c", k, {"a": k}) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))], DOC)


def kmers_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similar(x, y):
    if min(len(x), len(y)) < 0.8 * max(len(x), len(y)) or 9 * len(set(x) & set(y)) < 4 * (len(set(x)) + len(set(y))) * 0.9:
        return False
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1] >= 0.8 * (len(x) + len(y) - row[-1])


def links_and_classes(texts):
    """All pairs by brute force: similar ones, and the components they make."""
    k = [kmers_of(t) for t in texts]
    links = [(i, j) for i in range(len(k)) if k[i] for j in range(i) if k[j] and similar(k[i], k[j])]
    root = list(range(len(k)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return links, [find(i) for i in range(len(k))]


def families(r, n_families, n_copies, length, rates):
    """Texts of words; copies of each with single words replaced, at several rates around the threshold."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n_families):
        base = [word() for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(n_copies):
            rate = r.choice(rates)
            w = [word() if r.random() < rate else x for x in base]
            if r.random() < 0.3:
                del w[r.randrange(len(w))]
            out.append(" ".join(w))
    r.shuffle(out)
    return out


def test_classes_against_all_pairs(spark):
    r = random.Random(11)
    texts = families(r, 3, 40, 150, [0.01, 0.02, 0.03, 0.05]) + families(r, 12, 6, 40, [0.01, 0.03, 0.06]) + families(r, 20, 3, 12, [0.0, 0.03, 0.1])
    texts += [None, "", " \n", "a b", "a  b", "a b c", texts[0], texts[1].replace(" ", "\n")]
    links, classes = links_and_classes(texts)
    got = {x.doc_id: x for x in near_groups(docs_of(spark, texts)).collect()}
    assert len(links) > 500 and len(set(classes)) < len(texts) - 60
    met = sum(got[i].class_id == got[j].class_id for i, j in links)
    assert met / len(links) >= 0.99, met / len(links)
    # nothing meets that brute force keeps apart
    assert all(classes[got[i].class_id] == classes[i] for i in got)
    sizes = {}
    for x in got.values():
        sizes[x.class_id] = sizes.get(x.class_id, 0) + 1
    assert all(x.class_size == sizes[x.class_id] for x in got.values())


def test_variants_that_are_not_alike_stay_apart(spark):
    # every text shares most of its k-mers with one original that isn't there
    r = random.Random(12)
    texts = families(r, 1, 150, 200, [0.035])[1:]
    links, classes = links_and_classes(texts)
    got = {x.doc_id: x.class_id for x in near_groups(docs_of(spark, texts)).collect()}
    assert all(got[i] == got[j] for i, j in links) and len(set(got.values())) == len(set(classes))


def test_null_and_equal_ids(spark):
    r = random.Random(13)
    base = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(100))
    other = " ".join("".join(r.choice("ghijkl") for _ in range(6)) for _ in range(100))
    near = base.replace(base.split()[50], "changed")
    texts, ids = [base, near, near, other, other + " more", None, ""], [None, None, 7, 7, None, None, 7]
    df = docs_of(spark, texts, ids)
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.class_id is None, x.class_id or 0, x.class_size) for x in near_groups(df).collect()))
    assert got == sorted([(True, 0, False, 7, 3), (True, 0, False, 7, 3), (False, 7, False, 7, 3), (False, 7, False, 7, 2), (True, 0, False, 7, 2), (True, 0, True, 0, 1), (False, 7, False, 7, 1)])
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((x.doc_id is None, x.text or "") for x in out.collect()) == sorted([(False, near), (False, other), (True, ""), (False, "")])
    unnamed = drop_near_duplicates(docs_of(spark, [base, near, base], [None] * 3)).collect()
    assert len(unnamed) == 1


def test_ties_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = docs_of(spark, [text] * 4 + ["x " + text], [3, 3, 3, 5, 4])
    out = drop_near_duplicates(df).collect()
    assert [(x.doc_id, x._nth) for x in out] == [(3, 0)]  # the first by the other columns
    assert near_groups(docs_of(spark, [])).collect() == [] == drop_near_duplicates(docs_of(spark, [])).collect()


def test_long_texts(spark):
    r = random.Random(14)
    w = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    texts = [" ".join(w), " ".join(w[:60_000] + ["new"] + w[60_000:]), " ".join(r.sample(w, len(w))), "la " * 100_000, "la " * 110_000]
    got = [x.class_id for x in near_groups(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 0, 2, 3, 3]

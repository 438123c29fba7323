"""Near-duplicate classes by Order MinHash.

A text's k-mers are its windows of five words, each labelled with its occurrence number. For each of SAMPLES random
orders, the LEAST k-mers of smallest rank are taken and hashed in the order in which the text has them, so a
sample agrees for two texts if they share those k-mers and their order. Texts with an equal sample are candidates.

Candidates are verified by an alignment of their k-mer sequences, within a band that any accepted pair must keep:
with m k-mers aligned, m / (a + b - m) must reach 0.8. Classes are the connected components of accepted pairs.

Texts of equal words are one node from the start, named by half of their words' 128-bit BLAKE2 digest; should two digests
share that half, the other one is worked into the name. In a bucket (nodes with an
equal sample) the node with the most bucket mates overall leads, for a group's original is in more of its buckets
than any copy. First each node is compared with the leaders of its buckets, of which a group has few: n copies cost
about n comparisons.

Buckets that still have several classes then are compared without looking at all their pairs. Two similar texts of
a >= b k-mers share at least 4/9 (a + b) of them. With the k-mers of every node in one order, rarest first, the first
that they share therefore stands among the first fifth of the longer text and the first ninth of the shorter one,
and as many as that must be left in both from there on. Nodes are joined on such k-mers under just these
conditions, across classes only; no pair above 0.8 is lost by them, and texts that only share their frequent k-mers
(variants of one original that are not alike enough) don't meet.

Defined results: a null or empty text is a class of its own; texts of one to four words have one k-mer, their whole;
equal rows are one class; a class is named by its smallest id, which is null only if all its ids are; equal or null
ids on different texts are different rows; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from evimap.llm.common import Words, materialise, mix, quoted, slices, windows

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares a sample of 8 with probability 0.8 ** 8, about 0.17, and one of 40 with 0.9994.
SAMPLES, LEAST = 40, 8
#: Texts of up to so many k-mers also give samples of FEW, as those of 8 are nearly all they have; so do texts that are
#: similar to such a text and longer.
SHORT, FEW = 60, 3
#: Cells of the table of k-mer frequencies.
CELLS = 1 << 18
#: Rows of node and link tables that a task gets at least; smaller tables take fewer tasks.
ROWS_PER_TASK = 500_000
_rng = np.random.default_rng(20240613)
_A = _rng.integers(1, 1 << 63, 2 * SAMPLES, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * SAMPLES, np.uint64)


def kmers(words: Words, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the k-mers of all texts of a slice, and where each text's begin."""
    prints = words.fingerprints(k)
    n_words = np.diff(words.first)
    h, at = windows(prints, words.first, SHINGLE, k)
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    starts = np.r_[0, np.cumsum(count)]
    out = np.empty(starts[-1], np.uint64)
    doc = np.searchsorted(words.first, at, side="right") - 1
    out[starts[doc] + at - words.first[doc]] = h
    for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
        whole = np.uint64(n_words[i])
        with np.errstate(over="ignore"):
            for w in prints[words.first[i] : words.first[i + 1]]:
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
        out[starts[i]] = whole
    return out, starts


def labelled(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each k-mer with its occurrence number within its text worked in."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if not same.any():
        return mix(h)
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    out = np.empty_like(h)
    out[order] = mix(h[order] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def samples(h: np.ndarray) -> np.ndarray:
    """The hashed samples of one text's labelled k-mers."""
    sets = [(range(SAMPLES), LEAST)] + [(range(SAMPLES, 2 * SAMPLES), FEW)] * (SIMILARITY * len(h) <= SHORT)
    out = []
    for orders, least in sets:
        step = max(1, (1 << 20) // len(h))
        for s in range(orders.start, orders.stop, step):
            which = np.arange(s, min(s + step, orders.stop))
            rank = (h[None, :] ^ _B[which, None]) * _A[which, None]
            rank ^= rank >> np.uint64(32)
            rank *= np.uint64(0xD6E8FEB86659FD93)
            take = np.argpartition(rank, least - 1, axis=1)[:, :least] if len(h) > least else np.broadcast_to(np.arange(len(h)), (len(which), len(h)))
            picked = h[np.sort(take, axis=1)]
            key = which.astype(np.uint64) + np.uint64(1)
            for j in range(picked.shape[1]):
                key = mix(key + picked[:, j])
            out.append(key)
    return np.concatenate(out).view(np.int64)


def digested(words: Words) -> np.ndarray:
    """Two numbers for each text: the digest of its words. The first one names its node."""
    return words.digests(words.first[:-1], words.first[1:])


def _sketch(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            h, starts = kmers(words)
            name = digested(words)
            n = np.diff(starts)
            short = (h >> np.uint64(32)).astype("<u4")
            h = labelled(h, starts)
            keys = [samples(h[a:b]) if b > a else np.empty(0, np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            at = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            contents = pa.array([short[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in name.T), pa.array(n), lists, contents], names=["doc_id", "node", "check", "n", "keys", "kmers"])


def needed(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """The least number of aligned k-mers at which texts of a and b k-mers are similar."""
    return ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def aligned(x: np.ndarray, y: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence whose pairs are at most band places apart, where band is what a
    result of need or more leaves; below need it may be less."""
    n = min(len(x), len(y))
    if n < need:
        return 0
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[::-1][: n - head] != y[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    band = len(x) + len(y) - 2 * need
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    done = head + tail
    if not len(x) or not len(y):
        return done
    values, counts = np.unique(y, return_counts=True)
    own, own_counts = np.unique(x, return_counts=True)
    _, i, j = np.intersect1d(own, values, assume_unique=True, return_indices=True)
    if done + int(np.minimum(own_counts[i], counts[j]).sum()) < need:
        return 0
    if int((own_counts[i] * counts[j]).sum()) > 16 * len(x):
        return done + _by_bits(x.tolist(), y.tolist(), band)
    places: dict[int, list[int]] = {}
    for k, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(k)
    ends: list[int] = []  # ends[k]: the smallest place in y at which a subsequence of k + 1 ends
    for i, v in enumerate(x.tolist()):
        for k in reversed(places.get(v, ())):
            if -band <= k - i <= band:
                at = bisect_left(ends, k)
                ends[at : at + 1] = [k]
    return done + len(ends)


def _by_bits(x: list[int], y: list[int], band: int) -> int:
    """The same for texts of many repetitions, a row of the alignment at a time as the bits of an integer."""
    masks: dict[int, int] = {}
    for k, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << k
    every = (1 << len(y)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = every
    for i, v in enumerate(x):
        near = window << (i - band) if i >= band else window >> (band - i)
        match = masks.get(v, 0) & near
        u = row & match
        row = ((row + u) | (row - u)) & every
    return len(y) - row.bit_count()


def frequencies(contents: DataFrame) -> np.ndarray:
    """How many k-mers of all contents fall on each of CELLS cells: a table of fixed size, summed cell by cell."""
    blocks = 16
    size = CELLS // blocks

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for data in batch.column("kmers"):
                np.add.at(total, np.frombuffer(data.as_buffer(), "<u4") % CELLS, 1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "counts": [total[i * size : (i + 1) * size].tobytes() for i in range(blocks)]})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    rows = contents.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(rows, key=lambda r: r.block)]) if rows else np.zeros(CELLS, np.int64)


def _rarest(frequency: np.ndarray):
    """Each node's k-mers of the rarest cells with their places in that order, as many as leave fewer than a similar
    text must share: a fifth of them, of which the first ninth count as seed."""

    def take(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for node, c, data in zip(batch.column("node").to_pylist(), batch.column("c").to_pylist(), batch.column("kmers"), strict=True):
                x = np.frombuffer(data.as_buffer(), "<u4").astype(np.uint64)
                rank = frequency[x.astype(np.int64) % CELLS]
                x, n = labelled(x, np.array([0, len(x)])), len(x)
                x = x[np.lexsort((x, rank))][: n - ceil(SIMILARITY * n - 1e-9) + 1]
                place = np.arange(len(x), dtype=np.int32)
                for column, values in zip(out, (np.full(len(x), node, np.int64), np.full(len(x), c, np.int64), x.view(np.int64), np.full(len(x), n, np.int32), place, place <= n - needed(n, n)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "c", "kmer", "n", "place", "seed"])

    return take


def _verify(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("kmers_a"), batch.column("kmers_b")
        good = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), "<u4"), np.frombuffer(b[i].as_buffer(), "<u4")
            need = needed(len(x), len(y))
            good.append(aligned(x, y, need) >= need)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def few(df: DataFrame) -> DataFrame:
    """A table just written, in as many partitions as its rows ask for: a table of one partition needs no exchange."""
    return df.coalesce(1 + df.count() // ROWS_PER_TASK)


def components(edges: DataFrame) -> DataFrame:
    """node, class: the smallest node of each node's component. edges: columns a and b.

    Alternating large and small stars, every round one pass of equi-joins over the edges; ends when a round changes none."""
    edges = few(materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges"))
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = few(materialise(out, "edges"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("class")).withColumnRenamed("u", "node")
        state = now


class _Classes:
    """Nodes and the class each is in so far; a node that isn't listed is a class of its own."""

    def __init__(self) -> None:
        self.known: DataFrame | None = None

    def of(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.known is None:
            return df.withColumn(name, F.col(node))
        return df.join(self.known.select(F.col("node").alias(node), F.col("class").alias("_c")), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")

    def link(self, pairs: DataFrame) -> None:
        """Merge the classes of linked nodes (a, b). Only classes are merged, so later calls see few links."""
        across = self.of(self.of(pairs, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = few(materialise(components(across), "classes"))
        if self.known is None:
            self.known = merged
        else:
            moved = self.known.join(merged.select(F.col("node").alias("class"), F.col("class").alias("_to")), "class", "left").select("node", F.coalesce("_to", "class").alias("class"))
            fresh = merged.join(self.known, "node", "left_anti")
            self.known = few(materialise(moved.unionByName(fresh), "classes"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and the nodes: node, rows, id (the smallest), class, class_id, class_size, keeper."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = rows.mapInArrow(_sketch, "doc_id long, node long, check long, n long, keys array<long>, kmers binary").withColumn("row", F.monotonically_increasing_id())
    sketches = materialise(sketched, "sketches")
    some = sketches.where("n > 0")
    by_node = some.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), F.min("check").alias("check"), F.max("check").alias("_last"))
    nodes = materialise(by_node, "nodes")
    clash = nodes.where("check <> _last")
    if not clash.isEmpty():  # different words under one name: the other half of the digest is worked into it
        sketches = materialise(_apart(sketches, materialise(clash.select("node"), "clash")), "sketches")
        some = sketches.where("n > 0")
        nodes = materialise(some.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), F.min("check").alias("check")), "nodes")

    keyed = some.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo <> _hi").select("key")
    members = few(materialise(keyed.join(shared, "key", "left_semi").distinct(), "members"))
    degree = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").groupBy("node").agg(F.sum("size").alias("degree"))
    degree = few(materialise(degree, "nodes"))
    ranked = few(materialise(members.join(degree, "node"), "members"))
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("l"))
    led = few(materialise(ranked.join(leaders, "key").where("node <> l.node").select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs"))

    chosen = nodes.join(degree.select("node"), "node", "left_semi").select("row")
    contents = materialise(some.select("row", "node", "kmers").join(chosen, "row", "left_semi").select("node", "kmers"), "contents")

    def verified(pairs: DataFrame) -> DataFrame:
        first = pairs.join(contents.select(F.col("node").alias("b"), F.col("kmers").alias("kmers_b")), "b")
        second = first.join(contents.select(F.col("node").alias("a"), F.col("kmers").alias("kmers_a")), "a")
        sized = second.where(f"least(length(kmers_a), length(kmers_b)) >= {SIMILARITY} * greatest(length(kmers_a), length(kmers_b))")
        return few(materialise(sized.select("a", "b", "kmers_a", "kmers_b").mapInArrow(_verify, "a long, b long"), "links"))

    classes = _Classes()
    classes.link(verified(led))

    inside = few(materialise(classes.of(members, "node", "c"), "members"))
    keys = inside.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("key")
    rest = few(materialise(inside.join(keys, "key", "left_semi").select("node", "c").distinct(), "rest"))
    if not rest.isEmpty():
        texts = materialise(contents.join(rest, "node"), "rest")
        rare = materialise(texts.mapInArrow(_rarest(frequencies(texts)), "node long, c long, kmer long, n int, place int, seed boolean"), "rare")
        keys = rare.groupBy("kmer").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("kmer")
        rare = few(materialise(rare.join(keys, "kmer", "left_semi"), "rare"))
        longer = rare.select("kmer", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
        shorter = rare.where("seed").select("kmer", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
        alike = F.expr(f"ca <> cb and nb <= na and (nb < na or b < a) and nb >= {SIMILARITY} * na and (1 + {SIMILARITY}D) * least(na - pa, nb - pb) >= {SIMILARITY}D * (na + nb) - 1e-6D")
        pairs = few(materialise(longer.join(shorter, (longer.kmer == shorter.kmer) & alike).select("a", "b").distinct(), "pairs"))
        if not pairs.isEmpty():
            classes.link(verified(pairs))

    known = classes.of(nodes, "node", "class")
    named = known.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"].alias("_keeper"))
    named = materialise(known.join(named, "class").withColumn("keeper", F.col("node") == F.col("_keeper")).select("node", "check", "id", "class_id", "class_size", "keeper"), "classes")
    return sketches, named


def _apart(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """rows with new names for the nodes in clash."""
    found = rows.join(clash.select(F.col("node").alias("_clash")), F.col("node") == F.col("_clash"), "left")
    return found.withColumn("node", F.when(F.col("_clash").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))).drop("_clash")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the class's smallest doc_id), class_size (rows)."""
    sketches, named = _grouped(docs, id_col, text_col)
    inside = sketches.where("n > 0").select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "class_size")
    alone = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return inside.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the smallest id; texts without words all stay.

    Of rows with that id and the same words, the first one by all columns that have an order stays."""
    _, named = _grouped(docs, id_col, text_col)
    kept = named.where("keeper").select(F.col("id").alias("_id"), F.col("check").alias("_check"))
    marked = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = marked.select("doc", "doc_id").schema.add("check", LongType()).add("empty", BooleanType())
    rows = marked.mapInArrow(_checked, schema)
    # rows of one id whose words differ have different digests; half of one does to tell them apart
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check")), "left").where("empty or _check is not null")
    order = [F.col(f"doc.{quoted(c)}") for c, t in docs.dtypes if not re.search("map|variant|interval", t)]
    nth = F.row_number().over(Window.partitionBy("doc_id", "check").orderBy(*order))
    return stay.withColumn("_nth", nth).where("_nth = 1 or empty").select("doc.*")


def _checked(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            check = np.ascontiguousarray(digested(words)[:, 1])
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("doc_id"), pa.array(check), pa.array(np.diff(words.first) == 0)], names=["doc", "doc_id", "check", "empty"])

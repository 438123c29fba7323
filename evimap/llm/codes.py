"""Vector code compression: product codes of 4 bits a part, with codebooks fitted over all vectors.

Components become integers, floor(4096 x), so sums and distances are exact. A vector is cut into equal parts; each part
position has a codebook, which starts as that part of the vectors of smallest id. A round broadcasts a kd-tree over
each codebook's entries (PARTS trees of ENTRIES leaves, fixed in size); tasks find every part's nearest entry by branch and
bound and add up components by entry; the sums of all tasks are added by Spark, and an entry becomes the floor of
their mean. A node is left out only where its box lies farther than the best so far, so one at the same distance is visited
and the tie goes to the lower index.

The integers are written once, as a table that the rounds read; no vector is shuffled or collected but the first ENTRIES
for the start. A round returns at most PARTS x ENTRIES sums for each component of a part.

Defined results: rows whose vector is null, or holds a null or a component that isn't finite, are left out. A vector of
another length than the longest, and one whose length PARTS doesn't divide, is filled up with zeros. Integers are held
within 2^62 on either side, and error and label_error within a long. With fewer than ENTRIES vectors the codebooks
have as many entries. The smallest ids come first, nulls last, ties by the vector. Rows with equal ids are coded each on
their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from evimap.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums may be broadcast; more of them are joined in SALTS slices.
BROADCAST_LABELS = 1 << 17
SALTS = 32
#: Rows of a batch that are searched together.
ROWS = 1 << 13
_LIMIT, _LONG = 1 << 62, (1 << 63) - 1


class Tree:
    """A kd-tree over a codebook's entries: nodes as arrays, boxes tight around their entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.left, self.right, self.entry = [], [], [], [], []
        self._add(np.arange(len(entries)))
        self.low, self.high = np.stack(self.low), np.stack(self.high)
        self.left, self.right, self.entry = (np.array(x, np.int64) for x in (self.left, self.right, self.entry))

    def _add(self, own: np.ndarray) -> int:
        node, points = len(self.left), self.entries[own]
        self.low.append(points.min(0))
        self.high.append(points.max(0))
        self.left.append(-1)
        self.right.append(-1)
        self.entry.append(int(own[0]))
        if len(own) > 1:
            spread = self.high[node] - self.low[node]
            axis = max(range(len(spread)), key=lambda i: spread[i]) if len(spread) else 0
            order = own[np.argsort(points[:, axis], kind="stable")] if len(spread) else own
            self.left[node] = self._add(np.sort(order[: len(own) // 2]))
            self.right[node] = self._add(np.sort(order[len(own) // 2 :]))
            self.entry[node] = -1
        return node

    def _bound(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance from each point to its node's box."""
        out = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (out * out).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; of equal distances the lowest index.

        All points walk the tree at once, each with a stack of nodes that it has yet to see, nearer ones on top."""
        n, depth = len(x), len(self.left) + 1
        best = np.full(n, -1, np.int64)
        far = np.zeros(n, x.dtype)
        stack, bounds, height = np.zeros((n, depth), np.int64), np.zeros((n, depth), x.dtype), np.ones(n, np.int64)
        active = np.arange(n)
        while len(active):
            height[active] -= 1
            node, bound = stack[active, height[active]], bounds[active, height[active]]
            seen = (best[active] < 0) | (bound <= far[active])
            at, node = active[seen], node[seen]
            leaf = self.left[node] < 0
            # a leaf's box is its entry, so its bound is the distance
            end, entry, distance = at[leaf], self.entry[node[leaf]], bound[seen][leaf]
            if len(end):
                first = (node[leaf] == 0).nonzero()[0]
                if len(first):  # a tree of one entry: the root has no bound yet
                    distance[first] = self._bound(x[end[first]], node[leaf][first])
                better = (best[end] < 0) | (distance < far[end]) | ((distance == far[end]) & (entry < best[end]))
                best[end[better]], far[end[better]] = entry[better], distance[better]
            inner = at[~leaf]
            if len(inner):
                sides = [self.left[node[~leaf]], self.right[node[~leaf]]]
                near = [self._bound(x[inner], s) for s in sides]
                swap = near[1] < near[0]
                for k in (0, 1):  # the farther one first
                    which = swap == (k == 1)
                    top = height[inner]
                    stack[inner, top] = np.where(which, sides[1], sides[0])
                    bounds[inner, top] = np.where(which, near[1], near[0])
                    height[inner] += 1
            active = active[height[active] > 0]
        return best, far


def _filled(lists: pa.ListArray, width: int, kind: type) -> np.ndarray:
    """Lists of integers as rows x PARTS x width, filled up with zeros."""
    ends = np.asarray(lists.offsets).astype(np.int64)
    values = np.asarray(lists.values)[ends[0] : ends[-1]].astype(kind)
    size = np.diff(ends)
    if (size == PARTS * width).all():
        return values.reshape(len(lists), PARTS, width)
    out = np.zeros((len(lists), PARTS * width), kind)
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
    return out.reshape(len(lists), PARTS, width)


def _blocks(batches, width: int, kind: type):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _filled(part.column("v"), width, kind)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and v (array of long) of the rows that are kept, written."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))

    def scaled(batches):
        for batch in batches:
            lists = batch.column("x")
            ends = np.asarray(lists.offsets).astype(np.int64)
            x = np.asarray(pc.fill_null(lists.values, np.nan))[ends[0] : ends[-1]] * SCALE if len(lists.values) else np.empty(0)
            bad = np.r_[0, np.cumsum(~np.isfinite(x / SCALE))]
            keep = np.asarray(lists.is_valid()) & (np.diff(bad[ends - ends[0]]) == 0)
            size = np.diff(ends)
            x = np.floor(x[np.repeat(keep, size)])
            big = np.abs(x) >= _LIMIT
            v = np.where(big, np.sign(x).astype(np.int64) * _LIMIT, np.where(big, 0, x).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[keep])].astype(np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(keep)) for c in ("vec_id", "label")), lists], names=["vec_id", "label", "v"])

    return materialise(rows.mapInArrow(scaled, rows.select("vec_id", "label").schema.add("v", ArrayType(LongType()))), "vectors")


def shape(held: DataFrame) -> tuple[int, int]:
    """Components of a part, and the largest magnitude of a component."""
    r = held.agg(F.max(F.size("v")).alias("size"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    return max(1, -(-(r["size"] or 0) // PARTS)), r["most"] or 0


def fit(held: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks after so many rounds: an array of entries x width for each part; none without vectors."""
    first = [r["v"] for r in held.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return []
    width, most = shape(held)
    kind = _kind(most, width)
    start = _filled(pa.array(first, pa.list_(pa.int64())), width, kind)
    books = [start[:, p] for p in range(PARTS)]
    for _ in range(rounds):
        trees = held.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
        sums = held.select("v").mapInArrow(_summed(trees, width, kind), "slot long, sum decimal(38,0), n long")
        found = sums.groupBy("slot").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for slot, total, n in found:  # one for each component of each entry
            rest, i = divmod(slot, width)
            part, entry = divmod(rest, len(first))
            books[part][entry, i] = int(total) // n
        trees.unpersist()
    return books


def _kind(most: int, width: int) -> type:
    """Integers of 64 bits where no error leaves them, else Python's own."""
    return np.int64 if 4 * most * most * PARTS * width < _LONG else object


def _summed(trees, width: int, kind: type):
    def each(batches):
        books = trees.value
        k = len(books[0].entries)
        sums, counts = np.zeros((PARTS, k, width), object), np.zeros((PARTS, k), np.int64)
        for _, x in _blocks(batches, width, kind):
            for p, tree in enumerate(books):
                code, _ = tree.nearest(x[:, p])
                counts[p] += np.bincount(code, minlength=k)
                for e in np.unique(code).tolist():
                    # a block's sum stays within 64 bits where a squared distance does
                    sums[p, e] = sums[p, e] + x[code == e, p].sum(0).astype(object)
        used = np.flatnonzero(np.repeat(counts.reshape(-1), width))
        values = [Decimal(int(v)) for v in sums.reshape(-1)[used]]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(values, pa.decimal128(38, 0)), pa.array(np.repeat(counts.reshape(-1), width)[used])], names=["slot", "sum", "n"])

    return each


def encode(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over parts)."""
    schema = held.select("vec_id", "label").schema.add("code", StringType()).add("error", LongType())
    if not books:
        return held.sparkSession.createDataFrame([], schema)
    width, most = shape(held)
    kind = _kind(most, width)
    trees = held.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def each(batches):
        for part, x in _blocks(batches, width, kind):
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), kind)
            for p, tree in enumerate(trees.value):
                codes[:, p], far = tree.nearest(x[:, p])
                error = error + far
            code = [row.tobytes().hex() for row in codes]
            errors = pa.array(np.minimum(error, _LONG).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), errors], names=["vec_id", "label", "code", "error"])

    return held.mapInArrow(each, schema)


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """codes with v, the integers that a code stands for: its entries one after the other."""
    def each(batches):
        for batch in batches:
            rows = [np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(c), strict=True)]).tolist() if c is not None else None for c in batch.column("code").to_pylist()]
            yield batch.append_column("v", pa.array(rows, pa.list_(pa.int64())))

    return codes.mapInArrow(each, codes.drop("v").schema.add("v", ArrayType(LongType()))) if "v" not in codes.columns else codes


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error (error summed over equal labels), codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    held = integers(vectors, id_col, vector_col, label_col)
    books = fit(held, rounds, entries)
    coded = materialise(encode(held, books), "codes")
    summed = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(_LONG).cast("decimal(29,0)")).cast("long").alias("label_error"))
    labels = materialise(summed.withColumnRenamed("label", "_label"), "labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if labels.count() <= broadcast_labels:
        joined = coded.join(F.broadcast(labels), same)
    else:
        left = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        right = labels.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, same & (F.col("_salt") == F.col("_part")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

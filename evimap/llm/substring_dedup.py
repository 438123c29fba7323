"""Substring deduplication: windows of words that also start in an earlier document.

Documents are dealt into blocks by a hash of their id. Pass one: each block makes its partition of a count-min
sketch of two rows, as sorted cells with a bit for two or more; the partitions are cut into shards of cells, merged
shard by shard, and what comes back to a block are its cells whose merged count is two or more. The sketch only
overestimates, so no repeated window is lost. Pass two: windows whose cells are repeated in both rows are grouped
by their words, to find the smallest document of each: within a block word by word, across blocks by the 128-bit BLAKE2
digest of the words. Windows' fingerprints only choose cells and shards: where they collide, the estimate is too high
and nothing else. Blocks combine their own
windows first: one entry per block and window, so a passage that a third of all documents share is a group of no
more rows than there are blocks. The sketch's width follows the number of windows.

A word is removed where a window that covers it starts in a document with a smaller id too, judged on the input.

Defined results: a null or empty text has no words; a null id counts as larger than any other and two such rows
don't make each other's windows repeated; rows with equal ids are one document's parts in this sense too; texts
under 13 words lose nothing; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimap.llm.common import Words, slices, windows

WINDOW = 13
#: Cells of a sketch row for each window of the corpus, at least.
CELLS_PER_WINDOW = 8
_NO_ID = np.iinfo(np.int64).max
_SPARSE = "shard int, block int, row_0 binary, row_1 binary"


class Block:
    """A block's windows: fingerprint, document and first word of each; and the names of its words, two numbers each (see Words.fingerprints)."""

    def __init__(self, rows: pa.Table, size: int):
        rows, self.size = rows.combine_chunks(), size
        self.batch = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)
        ids = self.batch.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(pa.compute.fill_null(ids, _NO_ID))
        parts, docs, at, names, self.n_words, base = [], [], [], [], [], 0
        for part in slices(self.batch):
            words = Words(part.column("text"))
            h, first = windows(words.fingerprints(), words.first, size)
            parts.append(h)
            names.append(np.stack([words.fingerprints(0), words.fingerprints(1)]))
            docs.append(np.searchsorted(words.first, first, side="right") - 1 + base)
            at.append(first - words.first[docs[-1] - base])
            self.n_words.append(np.diff(words.first))
            base += part.num_rows
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.h = join(parts, np.uint64)
        self.names = np.concatenate(names, 1) if names else np.empty((2, 0), np.uint64)
        self.doc, self.at, self.n_words = join(docs, np.int64), join(at, np.int64), join(self.n_words, np.int64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether windows a and b hold the same words, pair by pair, by the words' names."""
        starts = np.r_[0, np.cumsum(self.n_words)]
        a, b = (starts[self.doc[x]] + self.at[x] for x in (a, b))
        out = np.ones(len(a), bool)
        for k in range(self.size):
            for half in self.names:
                out &= half[a + k] == half[b + k]
        return out

    def digests(self, hits: np.ndarray) -> np.ndarray:
        """The digest of the words of each of these windows, two numbers."""
        order = np.argsort(hits, kind="stable")
        out = np.empty((len(hits), 2), np.int64)
        out[order] = self._digests(hits[order])
        return out

    def _digests(self, hits: np.ndarray) -> np.ndarray:
        out, base, done = [np.empty((0, 2), np.int64)], 0, 0
        for part in slices(self.batch):
            upto = int(np.searchsorted(self.doc[hits], base + part.num_rows))
            if upto > done:
                words, own = Words(part.column("text")), hits[done:upto]
                first = words.first[self.doc[own] - base] + self.at[own]
                out.append(words.digests(first, first + self.size))
            base, done = base + part.num_rows, upto
        return np.concatenate(out)


def _cells(h: np.ndarray, row: int, shards: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard, and cell within the shard, of each fingerprint in a row of the sketch. Both rows share shards."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    rest = h // np.uint64(shards)
    return shard, ((rest if row == 0 else rest >> np.uint64(29)) % np.uint64(width)).astype(np.uint32)


def _packed(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as differences of 16 bits; 65535 stands for that much with more to come."""
    step = np.diff(cells.astype(np.int64), prepend=0)
    more = step // 65535
    out = np.full(len(step) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = (step % 65535).astype(np.uint16)
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step.astype(np.int64))[step != 65535].astype(np.uint32)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def repeated_words(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    spark = docs.sparkSession
    blocks_n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one number: white space bounds the windows from above
    total = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)).first()[0] or 1
    shards = blocks_n
    width = max(1 << 10, min(1 << 31, 1 << int(np.ceil(np.log2(max(1, CELLS_PER_WINDOW * total / shards))))))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks_n)).cast("int")).repartition(blocks_n, "block")

    def sketch(table: pa.Table) -> pa.Table:
        block = Block(table.select(["doc_id", "text"]), size)
        number = table.column("block")[0].as_py()
        out: dict[str, list] = {"shard": [], "block": [], "row_0": [], "row_1": []}
        shard = (block.h % np.uint64(shards)).astype(np.int64)
        order, at = _by_shard(shard, shards)
        cells = [_cells(block.h, r, shards, width)[1][order] for r in (0, 1)]
        for s in range(shards):
            if at[s] < at[s + 1]:
                out["shard"].append(s)
                out["block"].append(number)
                for r in (0, 1):
                    own, count = np.unique(cells[r][at[s] : at[s + 1]], return_counts=True)
                    twice = _packed(own[count > 1])
                    out[f"row_{r}"].append(len(twice).to_bytes(4, "little") + twice + _packed(own[count == 1]))
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("row_0", pa.binary()), ("row_1", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        """Which of each block's cells have a merged count of two or more."""
        number, owners = table.column("shard")[0].as_py(), table.column("block").to_pylist()
        flags = []
        for r in (0, 1):
            singles, doubles = [], []
            for data in table.column(f"row_{r}").to_pylist():
                k = int.from_bytes(data[:4], "little")
                doubles.append(_unpacked(data[4 : 4 + k]))
                singles.append(_unpacked(data[4 + k :]))
            every = np.concatenate([*singles, *doubles, *doubles])
            cell, count = np.unique(every, return_counts=True)
            many = cell[count > 1]
            flags.append([_packed(np.intersect1d(np.union1d(a, b), many, assume_unique=True)) for a, b in zip(singles, doubles, strict=True)])
        n = len(owners)
        return pa.table({"shard": pa.array([number] * n, pa.int32()), "block": pa.array(owners, pa.int32()), "row_0": pa.array(flags[0], pa.binary()), "row_1": pa.array(flags[1], pa.binary())})

    sketches = blocks.groupBy("block").applyInArrow(sketch, _SPARSE)
    repeated = sketches.groupBy("shard").applyInArrow(merge, _SPARSE)

    def estimated(table: pa.Table, flags: pa.Table) -> tuple[Block, np.ndarray]:
        """The block and the windows that the sketch takes for repeated, grouped by shard."""
        block = Block(table.select(["doc_id", "text"]), size)
        shard = (block.h % np.uint64(shards)).astype(np.int64)
        order, at = _by_shard(shard, shards)
        cells = [_cells(block.h, r, shards, width)[1] for r in (0, 1)]
        hit = np.zeros(len(shard), bool)
        for s, *rows_ in zip(flags.column("shard").to_pylist(), flags.column("row_0").to_pylist(), flags.column("row_1").to_pylist(), strict=True):
            own = order[at[s] : at[s + 1]]
            hit[own] = np.isin(cells[0][own], _unpacked(rows_[0])) & np.isin(cells[1][own], _unpacked(rows_[1]))
        return block, np.flatnonzero(hit)

    def first_of(block: Block, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the block's estimated ones that differ (an index into hits each), each hit's one of them, and their smallest id.

        Windows of one fingerprint are compared word by word; should any differ, digests tell them apart."""
        ids, h = block.ids[block.doc[hits]], block.h[hits]
        order = np.lexsort((ids, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        alike = np.flatnonzero(~new)
        if not block.same(hits[order[alike]], hits[order[alike - 1]]).all():
            digest = block.digests(hits)
            order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
            new[1:] = (digest[order][1:] != digest[order][:-1]).any(1)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group, ids[order[new]]

    def candidates(key, table: pa.Table, flags: pa.Table) -> pa.Table:
        block, hits = estimated(table, flags)
        pick, _, least = first_of(block, hits)
        digest = block.digests(hits[pick])
        order, at = _by_shard((block.h[hits[pick]] % np.uint64(shards)).astype(np.int64), shards)
        out: dict[str, list] = {"shard": [], "block": [], "prints": [], "least": []}
        for s in range(shards):
            own = order[at[s] : at[s + 1]]
            if len(own):
                out["shard"].append(s)
                out["block"].append(key[0].as_py())
                out["prints"].append(digest[own].tobytes())
                out["least"].append(least[own].tobytes())
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("prints", pa.binary()), ("least", pa.binary())]))

    def earlier(table: pa.Table) -> pa.Table:
        """For each block, which of its windows a document of another block with a smaller id has."""
        prints = [np.frombuffer(x, [("a", np.int64), ("b", np.int64)]) for x in table.column("prints").to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()]
        every, ids = np.concatenate(prints), np.concatenate(least)
        order = np.lexsort((ids, every["b"], every["a"]))
        new = np.ones(len(order), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        smallest = np.empty(len(order), np.int64)
        smallest[order] = ids[order][new][np.cumsum(new) - 1]
        later = smallest < ids
        ends = np.cumsum([len(x) for x in least])
        flags = [np.packbits(later[e - len(x) : e]).tobytes() for e, x in zip(ends, least, strict=True)]
        return pa.table({"shard": table.column("shard"), "block": table.column("block"), "row_0": pa.array(flags, pa.binary()), "row_1": pa.array([b""] * len(flags), pa.binary())})

    tagged = blocks.groupBy("block").cogroup(repeated.groupBy("block"))
    found = tagged.applyInArrow(candidates, "shard int, block int, prints binary, least binary").groupBy("shard").applyInArrow(earlier, _SPARSE)
    answers = repeated.select("shard", "block", F.lit(0).alias("kind"), "row_0", "row_1").unionByName(found.select("shard", "block", F.lit(1).alias("kind"), "row_0", "row_1"))

    def remove(key, table: pa.Table, answers_: pa.Table) -> pa.Table:
        kind = np.asarray(answers_.column("kind"))
        block, hits = estimated(table, answers_.filter(pa.array(kind == 0)))
        pick, group, least = first_of(block, hits)
        order, at = _by_shard((block.h[hits[pick]] % np.uint64(shards)).astype(np.int64), shards)
        later = np.zeros(len(pick), bool)
        told = answers_.filter(pa.array(kind == 1))
        for s, flags in zip(told.column("shard").to_pylist(), told.column("row_0").to_pylist(), strict=True):
            own = order[at[s] : at[s + 1]]
            later[own] = np.unpackbits(np.frombuffer(flags, np.uint8))[: len(own)] == 1
        gone = later[group] | (least[group] < block.ids[block.doc[hits]]) if len(hits) else np.empty(0, bool)
        starts = np.r_[0, np.cumsum(block.n_words)]
        mark = np.zeros(starts[-1] + size + 1, np.int64)
        first = starts[block.doc[hits[gone]]] + block.at[hits[gone]]
        np.add.at(mark, first, 1)
        np.add.at(mark, first + size, -1)
        covered = np.cumsum(mark)[: starts[-1]] > 0
        kept, removed, i = [], [], 0
        for part in slices(block.batch):
            words = Words(part.column("text"))
            data = words.data.tobytes()
            for k in range(part.num_rows):
                a, b = words.first[k], words.first[k + 1]
                out = covered[starts[i] : starts[i + 1]]
                removed.append(int(out.sum()))
                kept.append(_joined(data, words.start[a:b], words.end[a:b], ~out))
                i += 1
        return pa.table({"doc_id": block.batch.column("doc_id"), "n_words": pa.array(block.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def _joined(data: bytes, start: np.ndarray, end: np.ndarray, stay: np.ndarray) -> str:
    return b" ".join([data[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]).decode()


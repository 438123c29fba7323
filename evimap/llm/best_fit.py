"""Best-fit packing, planned over the histogram of lengths.

A document's ids with its end id are one piece, or, where there are more than a sequence holds, pieces of a whole sequence
behind a first one that takes the rest. Best-fit decreasing is run over the number of pieces of each length, at most
`longest` numbers whatever the corpus: a run of sequences with equal room is filled at once. Its plan says which ranks of
a length stand in which sequences, and pieces find their slots by a join on their rank within their length.

Ranks need no task that sees all pieces of a length: a task numbers its own pieces of each length while it writes them,
and the (task, length) counts are summed up to give each task's first rank. Ids are written once; only narrow rows
(`assign`) go through the join, hot lengths spread by task. The plan is broadcast: its size depends on the
number of lengths, not of documents (`plan` never has more rows than pieces or than pairs of lengths and rooms).

Defined results: a null or empty text has its end id only; rows with equal or null ids are packed each on their own; an
empty table gives no piece; other columns don't matter. A sequence's number and a piece's place depend on how rows
are dealt to tasks, the number of sequences doesn't.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimap.llm.bpe import encoder
from evimap.llm.common import materialise, slices

MAX_TOKENS = 1024
_PIECES = "doc_id long, piece int, start long, length long, ids binary, task long, number long"
_PLAN = "length long, from_rank long, to_rank long, sequence long, each long, place long"


def piece_lengths(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """Lengths that a document of n tokens is cut into: the first piece takes the rest."""
    return [n] if n <= longest else [n % longest] * (n % longest > 0) + [longest] * (n // longest)


def plan(counts: dict[int, int], longest: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, from_rank, to_rank, sequence, each, place).

    Of the pieces of a length, rank k from from_rank to before to_rank is number i = k - from_rank of its row: it stands in
    sequence + i // each, at place + i % each * length."""
    rows, used = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, how many)
    sizes: list[int] = []  # the rooms there are, ascending
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:  # no sequence has the room: new ones, as many as all that is left needs
                free, first, many = longest, used, -(-left // (longest // length))
                used += many
            each = free // length
            full = min(many, left // each)
            for sequence, count, pieces in ((first, full, each), (first + full, int(full < many and left % each > 0), left % each)):
                if count:
                    rows.append((length, rank, rank + count * pieces, sequence, pieces, longest - free))
                    rank, left = rank + count * pieces, left - count * pieces
                    _free(room, sizes, free - pieces * length, sequence, count)
                    first, many = sequence + count, many - count
                if not left:
                    break
            _free(room, sizes, free, first, many)
    return rows


def _free(room: dict[int, list[tuple[int, int]]], sizes: list[int], free: int, first: int, many: int) -> None:
    if free and many:
        if free not in room:
            bisect.insort(sizes, free)
        room.setdefault(free, []).append((first, many))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus cut into pieces, written: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, and
    task and number, which number the pieces of a length within each task."""

    def cut(batches):
        enc, end, task = encoder(tokenizer_path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.column(part.column("text"))
                out: list[list] = [[], [], [], [], [], []]
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    data, at = ids[offsets[i] : offsets[i + 1]].tobytes() + end, 0
                    for k, length in enumerate(piece_lengths(len(data) // 4, longest)):
                        for column, x in zip(out, (doc, k, at, length, data[4 * at : 4 * (at + length)], int(seen[length])), strict=True):
                            column.append(x)
                        seen[length] += 1
                        at += length
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                columns.insert(5, pa.array(np.full(len(out[0]), task, np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "task", "number"])

    if longest < 1:
        raise ValueError("a sequence must hold a token at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(cut, _PIECES).withColumn("ids_crc32", F.crc32("ids")), "pieces")


def assign(cut: DataFrame, longest: int = MAX_TOKENS) -> DataFrame:
    """What pieces() wrote, but for the ids, with each piece's slot: sequence_id and offset."""
    spark = cut.sparkSession
    own = cut.groupBy("length", "task").agg(F.count("*").alias("own"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("length", "task", F.coalesce(F.sum("own").over(before), F.lit(0).cast("long")).alias("first"))
    # a row for each length there is, longest of them at most
    counts = {r["length"]: r["own"] for r in own.groupBy("length").agg(F.sum("own").alias("own")).collect()}
    slots = spark.createDataFrame(plan(counts, longest), _PLAN).withColumnRenamed("length", "_length")
    ranked = cut.drop("ids").join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("number"))
    within = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    slot = {
        "sequence_id": F.expr("sequence + (rank - from_rank) div each"),
        "offset": F.expr("place + (rank - from_rank) % each * length"),
    }
    return ranked.join(F.broadcast(slots), within).withColumns(slot).drop("first", "rank", *slots.columns)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its slot: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Its ids are in what pieces() writes."""
    return assign(pieces(docs, tokenizer_path, end_id, longest, id_col, text_col), longest).drop("task", "number")


def sequences(cut: DataFrame, longest: int = MAX_TOKENS) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (one binary), spans (offset, length, doc_id, start) in their order.

    The only step that moves ids: pieces meet by sequence, at most `longest` ids each."""
    key = ["task", "length", "number"]
    found = assign(cut, longest).join(cut.select(*key, "ids"), key)
    held = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    spans = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["doc_id"].alias("doc_id"), p["start"].alias("start")))
    return held.select("sequence_id", total.alias("n_tokens"), joined.alias("ids"), spans.alias("spans"))

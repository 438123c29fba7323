"""Packing by power-of-two decomposition.

A document's ids, with its end id, are cut into pieces of binary lengths: as many of the longest length as fit,
then one for each bit of the rest, longest first. Every piece is a sequence of its own and its length is a
power of two, so no sequence crosses documents and none needs padding; sequences of equal length form a bucket,
and sequence_id numbers the buckets one after the other. The work is one pass over the documents without a
shuffle; a task holds one slice of a batch.

Defined results: a null or empty text has its end id only; rows with equal or null ids are packed each on their
own; an empty table gives no piece; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimap.llm.bpe import encoder
from evimap.llm.common import slices

MAX_TOKENS = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def piece_lengths(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """Binary lengths that add up to n, longest first."""
    out = [longest] * (n // longest)
    return out + [1 << b for b in range((n % longest).bit_length() - 1, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ids holds little-endian unsigned 32-bit integers. longest: a power of two."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def pieces(batches):
        enc, end, task, made = encoder(tokenizer_path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.column(part.column("text"))
                out: list[list] = [[], [], [], [], []]
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    data = ids[offsets[i] : offsets[i + 1]].tobytes() + end
                    n, at = len(data) // 4, 0
                    for length in piece_lengths(n, longest):
                        for column, x in zip(out, (doc, at, length, data[4 * at : 4 * (at + length)], n), strict=True):
                            column.append(x)
                        at += length
                length = np.array(out[2], np.int64)
                bucket = np.log2(length).astype(np.int64)
                number = (bucket << 58) | (task << 32) | (made + np.arange(len(length)))
                made += len(length)
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(length), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64()), pa.array(number), pa.array(np.zeros(len(length), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader can take a batch of equal sequences."""
    pieces.write.partitionBy("length").parquet(path)

"""Token ids in Arrow files of fixed-size lists.

A shard is two Arrow IPC files. `ids`: record batches of (ids fixed_size_list<uint16 or uint32>[LENGTH], mask
fixed_size_list<uint8>[LENGTH / 8], a bit for each id, lowest first), all of BATCH_ROWS rows but the last,
uncompressed, so sequence k of a mapped file is a view at a place known from k alone. Ids take 16 bits where the
vocabulary allows. The shard's ids stand there one after the other; only the last
sequence is filled up, under mask 0. `docs`: (doc_id, start, n_tokens) of each document, start counted within
the shard. Shards hold ascending ranges of doc_id; the manifest (Parquet) names each shard's files with its
first place among all ids.

Tasks write under names of their own attempt and return those names, so a repeated or speculative attempt
leaves files that no manifest names. Paths go through pyarrow's file systems (file, hdfs, s3, ...).

Defined results: a null or empty text has its end id only; a null doc_id comes first; rows with equal ids follow
each other by their text; an empty table gives an empty manifest; other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimap.llm.bpe import encoder
from evimap.llm.common import slices

LENGTH = 1024
BATCH_ROWS = 256
DOC_BATCH = 1 << 14
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _ids_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))], metadata={"length": str(length)})


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ShardWriter:
    def __init__(self, folder: str, length: int, wide: bool):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = uuid.uuid4().hex
        self.length, self.schema = length, _ids_schema(length, wide)
        self.type = np.uint32 if wide else np.uint16
        self.sinks = [self.fs.open_output_stream(f"{base}/{self.name}.{kind}.arrow") for kind in ("ids", "docs")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], _DOCS)
        self.rest: list[np.ndarray] = []
        self.waiting = self.tokens = self.count = 0
        self.index: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.count += 1
        self.rest.append(ids.astype(self.type))
        self.waiting += len(ids)
        if self.waiting >= BATCH_ROWS * self.length:
            self._flush(last=False)
        if len(self.index) >= DOC_BATCH:
            self._flush_index()

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.length), (np.packbits(mask, bitorder="little"), self.length // 8))]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, self.type)
        size = BATCH_ROWS * self.length
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._batch(ids[at : at + size], np.ones(size, np.uint8))
        ids = ids[whole:]
        if last and len(ids):
            full = -(-len(ids) // self.length) * self.length
            mask = np.zeros(full, np.uint8)
            mask[: len(ids)] = 1
            self._batch(np.pad(ids, (0, full - len(ids))), mask)
            ids = ids[:0]
        self.rest, self.waiting = [ids], len(ids)

    def _flush_index(self) -> None:
        if self.index:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=_DOCS))
            self.index = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_index()
        for x in (self.ids, self.docs, *self.sinks):
            x.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id_col; returns the manifest, which is also stored in folder/manifest.

    One row per shard: shard, name, n_docs, n_tokens, first_token (ids in the shards before it)."""

    def write(batches):
        writer, enc, end = None, encoder(tokenizer_path), np.array([end_id], np.uint32)
        first = None
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.column(part.column("text"))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    if writer is None:
                        writer, first = ShardWriter(f"{folder}/shards", length, wide=len(enc.packed) > 1 << 16), doc
                    writer.add(doc, np.concatenate([ids[offsets[i] : offsets[i + 1]], end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([_task()], pa.int64()), "name": [writer.name], "first_doc": pa.array([first], pa.int64()), "n_docs": pa.array([writer.count], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    if length % 8:
        raise ValueError("length must be a multiple of 8")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, "shard long, name string, first_doc long, n_docs long, n_tokens long").write.parquet(f"{folder}/written")
    # a row per shard: the running sum over them needs one task, however many documents there are
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    written = spark.read.parquet(f"{folder}/written")
    written.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class Shard:
    """Random access to a shard: any sequence or any run of ids, as views of the mapped file where it is local."""

    def __init__(self, folder: str, name: str):
        fs, base = file_system(folder)

        def opened(kind: str):
            path = f"{base}/shards/{name}.{kind}.arrow"
            return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))

        self.reader, self.index = opened("ids"), opened("docs")
        self.length = int(self.reader.schema.metadata[b"length"])

    def _column(self, batch: int, name: str) -> np.ndarray:
        column = self.reader.get_batch(batch).column(name)
        return column.flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask (bits) of the shard's sequence k."""
        batch, row = divmod(k, BATCH_ROWS)
        bits = self.length // 8
        return self._column(batch, "ids")[row * self.length : (row + 1) * self.length], self._column(batch, "mask")[row * bits : (row + 1) * bits]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the shard and ids of every document, reading one batch of each file at a time."""
        size, held, loaded = BATCH_ROWS * self.length, np.empty(0, np.uint16), -1
        for k in range(self.index.num_record_batches):
            docs = self.index.get_batch(k)
            for doc, start, n in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                parts, at = [], start
                while at < start + n:
                    batch, within = divmod(at, size)
                    if batch != loaded:
                        held, loaded = self._column(batch, "ids")[np.unpackbits(self._column(batch, "mask"), bitorder="little") == 1], batch
                    take = held[within : within + start + n - at]
                    parts.append(take)
                    at += len(take)
                yield doc, start, np.concatenate(parts) if parts else held[:0]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                out: list[list] = [[], [], [], []]
                held = 0
                for doc, start, ids in Shard(folder, name).documents():
                    for column, x in zip(out, (doc, first + start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        column.append(x)
                    held += len(ids)
                    if held >= 1 << 20:
                        yield _rows(out)
                        out, held = [[], [], [], []], 0
                yield _rows(out)

    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "name", "first_token")
    spread = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

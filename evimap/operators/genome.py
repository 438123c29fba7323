"""Long sequences as tiles, and models translated from them.

A file of sequences is read by lines, split anywhere. Where a line stands in its sequence is a prefix sum of lengths: within
each block of the file by a window over the block's lines, across blocks by a window over one row for each block. Lines are
cut at multiples of TILE and put together by tile, so nothing is ever longer than a line or a tile, and segments are cut
out of the tiles that they touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.tables import written

#: Letters of a tile.
TILE = 1 << 13
#: Letters of a line of a tile.
LINE = 1 << 7
#: Letters of tiles that may be broadcast.
BROADCAST_LETTERS = 32 << 20
#: Codons in the order of T, C, A, G at each place, and what they stand for: the standard genetic code.
BASES, AMINO_ACIDS = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def placed(lines: DataFrame) -> DataFrame:
    """seqid, offset (letters before the line in its sequence) and text of the lines of a FASTA file.

    lines: value, block (of what is read by one task, in the file's order) and place (within the block). Lines before the first
    header and empty lines go; white space within lines is left out; a header without an id names no sequence."""
    head = F.col("value").startswith(">")
    text = F.when(head, "").otherwise(F.regexp_replace("value", r"\s", ""))
    rows = lines.select("block", "place", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), text.alias("text")).withColumn("n", F.length("text").cast("long"))
    order = Window.partitionBy("block").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    header = F.when(F.col("name").isNotNull(), F.struct("name", "before"))
    rows = rows.withColumn("own", F.last(header, ignorenulls=True).over(upto))
    # what each block leaves to the next ones: its last header, and the letters behind that
    blocks = rows.groupBy("block").agg(F.sum("n").alias("total"), F.max_by(header, F.when(F.col("name").isNotNull(), F.col("place"))).alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    opened = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("start") + F.col("last.before")).alias("at")))
    blocks = blocks.select("block", "start", F.last(opened, ignorenulls=True).over(earlier).alias("open"))
    found = rows.where("n > 0").join(blocks, "block")
    offset = F.when(F.col("own").isNotNull(), F.col("before") - F.col("own.before")).otherwise(F.col("start") + F.col("before") - F.col("open.at"))
    return found.select(F.coalesce("own.name", "open.name").alias("seqid"), offset.alias("offset"), "text").where("seqid <> ''")


def tiles(pieces: DataFrame, size: int = TILE) -> DataFrame:
    """seqid, tile (from 0) and text: letters from tile * size on. pieces: seqid, offset, text, side by side."""
    room = F.expr(f"int({size} - offset % {size})")
    rest = F.regexp_extract_all(F.expr(f"substring(text, int({size} - offset % {size}) + 1)"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = F.when(F.length("text") <= room, F.array("text")).otherwise(F.concat(F.array(F.left("text", room)), rest))
    rows = pieces.select("seqid", "offset", F.posexplode(cut).alias("i", "part"))
    rows = rows.select("seqid", F.expr(f"offset div {size} + i").alias("tile"), F.when(F.col("i") == 0, F.col("offset") % size).otherwise(0).alias("at"), "part")
    return rows.groupBy("seqid", "tile").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("text"))


def cut_out(segments: DataFrame, tiled: DataFrame, key: str, size: int = TILE) -> DataFrame:
    """key, strand and sequence: each model's segments (seqid, strand, start, end, from 1, closed) cut out of the tiles they touch, in
    ascending order; for a strand of - the reverse complement. What lies beyond a sequence's end isn't there; a model whose sequence
    isn't known has no row."""
    touched = segments.select(key, "seqid", "strand", "start", "end", F.explode(F.expr(f"sequence(greatest(start - 1, 0) div {size}, greatest(end - 1, start - 1, 0) div {size})")).alias("tile"))
    # a few tiles may hold all segments, which would be a few tasks: where no more tiles are touched than can be broadcast, segments stay where they are
    touched, tiled = written(touched), written(tiled.join(touched.select("seqid", "tile").distinct(), ["seqid", "tile"], "left_semi").select("seqid", "tile", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{LINE}}}"), F.lit(0)).alias("lines")))
    j = touched.join(F.broadcast(tiled) if tiled.count() * size <= BROADCAST_LETTERS else tiled, ["seqid", "tile"])
    j = j.withColumns({"low": F.expr(f"greatest(start - 1 - tile * {size}, 0)"), "high": F.expr(f"least(end - tile * {size}, {size})")})
    # letters are counted from the start of a text, so a piece is cut out of the lines it touches
    lines = f"array_join(slice(lines, int(low div {LINE}) + 1, int(greatest(high - 1, low) div {LINE} - low div {LINE}) + 1), '')"
    piece = F.upper(F.expr(f"substring({lines}, int(low % {LINE}) + 1, int(greatest(high - low, 0)))"))
    parts = j.select(key, "strand", "start", "tile", piece.alias("piece"))
    joined = parts.groupBy(key).agg(F.max("strand").alias("strand"), F.sort_array(F.collect_list(F.struct("start", "tile", "piece"))).alias("p")).withColumn("s", F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return joined.select(key, "strand", F.when(F.col("strand") == "-", F.reverse(F.translate("s", "ACGT", "TGCA"))).otherwise(F.col("s")).alias("sequence"))


def _amino_acids(batches):
    """key and sequence, each three letters of which become one."""
    code = np.full(256, 64, np.int64)
    code[np.frombuffer(BASES.encode(), np.uint8)] = range(4)
    acids = np.frombuffer((AMINO_ACIDS + "X").encode(), np.uint8)
    for batch in batches:
        # a letter is a byte once all others than those of ASCII are one of them that is no base
        text = pc.replace_substring_regex(batch.column(1).cast(pa.large_string()), "[^\\x00-\\x7f]", "N")
        text = text if text.offset == 0 else pa.concat_arrays([text])
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        n = np.diff(at) // 3
        ends = np.r_[0, np.cumsum(n)]
        first = np.repeat(at[:-1] - 3 * ends[:-1], n) + 3 * np.arange(ends[-1])
        one, two, three = (code[data[first + i]] for i in range(3))
        found = acids[np.minimum(np.where((one | two | three) < 64, 16 * one + 4 * two + three, 64), 64)]
        words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(found.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words.cast(pa.string())], names=batch.schema.names)


def translated(segments: DataFrame, tiled: DataFrame, key: str = "protein", size: int = TILE) -> DataFrame:
    """key and sequence: each model's segments cut out of the tiles and translated, in Arrow batches.

    A codon with another letter is X; an unfinished last codon goes."""
    found = cut_out(segments, tiled, key, size).select(key, "sequence")
    return found.mapInArrow(_amino_acids, found.schema)

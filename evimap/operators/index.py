"""A lasting index of sequences' windows, and the peptide lookup by it.

Windows of LEAST letters and their places are written once, bucketed by the window's letters, so that later lookups join them
bucket by bucket: only peptides and candidates are exchanged, never the index. A peptide is covered by windows side by side
(the last one may overlap); its rarest one, by a table of their numbers beside the index, gives the candidates, and the
others must stand at the places that follow from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.functions.scalars import searchable
from evimap.functions.tables import written
from evimap.operators import search, seeds

LEAST = 5


def write_index(proteins: DataFrame, path: str, least: int = LEAST, buckets: int | None = None) -> None:
    """Writes the index of proteins (id, sequence; I is L) to path: windows of the 19 residues only, in as many buckets as an
    exchange has partitions, or as many as are asked for. One file a bucket, sorted; a bucket is written as a stream."""
    spark = proteins.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = proteins.select(F.col("id").cast("string").alias("id"), F.translate("sequence", "I", "L").alias("_s"))
    cut = seeds.windows(seeds.segments(rows, "id", "_s", least), [(least, 1)]).where(F.col("seed").rlike(f"^[{search.ALPHABET}]+$"))
    windows = cut.select("seed", F.col("_id").alias("id"), (F.col("base") + F.col("at") + 1).alias("at"))
    _bucketed(windows, f"{path}/windows", n)
    _bucketed(spark.read.parquet(f"{path}/windows").groupBy("seed").agg(F.count("*").alias("n")), f"{path}/counts", n)
    spark.createDataFrame([(least, n)], "least int, buckets int").write.mode("overwrite").parquet(f"{path}/about")


def _bucketed(rows: DataFrame, path: str, buckets: int) -> None:
    name = f"evimap_{uuid.uuid4().hex}"
    rows.repartition(buckets, "seed").write.mode("overwrite").bucketBy(buckets, "seed").sortBy("seed").option("path", path).format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external


def _opened(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    name = f"evimap_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (seed) SORTED BY (seed) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """windows (seed, id, at), counts (seed, n) and the windows' length, of an index that any session has written."""
    about = spark.read.parquet(f"{path}/about").first()
    return _opened(spark, f"{path}/windows", "seed string, id string, at bigint", about["buckets"]), _opened(spark, f"{path}/counts", "seed string, n bigint", about["buckets"]), about["least"]


def candidates(tiles: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """pattern, id, start of each place where a pattern's rarest window stands; tiles: pattern, off, seed."""
    ranked = tiles.join(counts, "seed", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "seed")).alias("r"))
    rare = ranked.where("r.n > 0").select("pattern", "r.off", "r.seed")  # a window that stands nowhere: no hit
    return rare.join(windows, "seed").select("pattern", "id", (F.col("at") - F.col("off")).alias("start"), F.col("off").alias("_off")).where("start > 0")


def index_lookup(spark: SparkSession, peptides: DataFrame, path: str) -> DataFrame:
    """peptide, protein, position, as search.lookup() gives them, by the index at path."""
    windows, counts, least = open_index(spark, path)
    every = search._asked(peptides)
    wanted = every.where(searchable(F.col("_p"), least)).select(F.col("_p").alias("pattern")).distinct()
    offsets = F.expr(f"explode(array_distinct(transform(sequence(0, (length(pattern) - 1) div {least}), i -> least(i * {least}, length(pattern) - {least}))))")
    tiles = wanted.withColumn("off", offsets).withColumn("seed", F.expr(f"substring(pattern, off + 1, {least})"))
    tiles = written(tiles)
    found = written(candidates(tiles, windows, counts))
    rest = found.join(tiles, "pattern").where("off <> _off").select("pattern", "id", "start", "seed", (F.col("start") + F.col("off")).alias("at"))
    there = rest.join(windows, ["seed", "id", "at"]).groupBy("pattern", "id", "start").agg(F.count("*").alias("n"))
    others = tiles.groupBy("pattern").agg((F.count("*") - 1).alias("others"))
    hits = found.join(others, "pattern").join(there, ["pattern", "id", "start"], "left").where(F.coalesce("n", F.lit(0)) == F.col("others"))
    hits = hits.select("pattern", F.col("id").alias("protein"), F.col("start").alias("position"))
    return search._looked_up(every, hits, ["protein", "position"])

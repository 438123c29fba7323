"""Class codes of gene models against a reference, from their exons.

A decision list over exons and introns names what a pair is to each other; a model's code is that of its best pair, in the order of
CODES. class_codes() sends each model to the cells of the genome it touches, where tasks look for the codes in that order (judged.py).
code(), pairs() and close_pairs() say the same of single pairs in SQL expressions: what two models are to each other, which are near
by, and which meet in a way that codes ask for. The codes up to k need an intron in common, or a model without introns in an exon of
the other one; those up to j a donor or an acceptor in common, or an intron within an exon.

What a code asks for (q the model, r the reference model; introns are the gaps between exons; strands are opposite when one is
+ and the other -, and else the same):

=  the same introns; without introns in either, they share at least 80 % of the longer one
c  q lies in r and has a run of r's introns; or q has none and lies in an exon of r
k  the other way round
m  q keeps an intron of r within an exon, and every intron of either within the other is shared, or kept by q
n  q keeps an intron of r, but not so for all
j  q shares a donor or an acceptor with r
e  q has no introns, and overlaps an exon of r and ten letters of an intron of it
o  exons overlap in another way
s  opposite strands, an intron shared
x  opposite strands, exons overlap
i  q lies in an intron of r
y  r lies in an intron of q
p  no overlap, the same strand, at most run_on letters apart
r  nothing of these, and half of q or more is masked as repeats
u  nothing of these
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap.functions.tables import written
from evimap.operators.judged import judged

#: From the best to the last: fixed values, the codes of the comparison format.
CODES = "=ckmnjeosxiypru"
#: The ways of close_pairs() in which all pairs meet that have one of the codes up to this.
STEPS = (("iql", "k"), ("dar", "j"))
BIN = 1 << 14
#: Letters of a bin for places within exons.
FINE = 1 << 9
RUN_ON = 2000
#: About as many models of a side are in a part of a cell at most, and rows in a task on average.
TASK_CELLS = 1 << 17
#: Letters of an intron that a model without introns must cover beside an exon.
FRAGMENT = 10
#: Letters that the exons of q and r share.
_OVERLAP = "aggregate(q.exons, 0L, (n, a) -> n + aggregate(r.exons, 0L, (k, b) -> k + greatest(0L, least(a.end, b.end) - greatest(a.start, b.start) + 1)))"

_OPPOSITE = "coalesce(q.strand IN ('+', '-') AND r.strand IN ('+', '-') AND q.strand <> r.strand, false)"


def introns(exons: str) -> str:
    """SQL for the gaps between sorted exons, as structs of start and end (closed)."""
    return f"zip_with(slice({exons}, 1, size({exons}) - 1), slice({exons}, 2, size({exons})), (a, b) -> struct(a.end + 1 AS start, b.start - 1 AS end))"


def _named(models: DataFrame, name: str) -> DataFrame:
    """seqid and the models as structs; those without exons go."""
    return models.where("size(exons) > 0").select("seqid", F.struct("id", "strand", "exons", F.expr(introns("exons")).alias("introns"), F.expr("exons[0].start").alias("start"), F.expr("element_at(exons, -1).end").alias("end")).alias(name))


def close_pairs(models: DataFrame, reference: DataFrame, kinds: str, size: int = FINE) -> DataFrame:
    """q and r as pairs() has them, some more than once: those that meet in one of the ways of kinds.

    i: equal introns. q: q has no introns and begins in an exon of r. l: r has none and begins in an exon of q. d: equal donors.
    a: equal acceptors. r: an intron of r lies within an exon of q. (Exons that overlap have an intron that ends before it starts.)"""
    place = "struct('{0}' AS kind, bigint({1}) AS at, bigint({2}) AS to, bigint(x.start) AS start, bigint(x.end) AS end)".format
    whole = lambda of, kind, at, to="0": f"transform({of}, x -> {place(kind, at, to)})"
    binned = lambda of, kind, low, high: f"flatten(transform({of}, x -> transform(sequence({low} div {size}, {high} div {size}), b -> {place(kind, 'b', '0')})))"
    same = lambda n: {"i": whole(f"{n}.introns", "i", "x.start", "x.end"), "d": whole(f"{n}.introns", "d", "x.start"), "a": whole(f"{n}.introns", "a", "x.end")}
    exons = lambda n, kind: binned(f"{n}.exons", kind, "x.start", "x.end")
    lone = lambda n, kind: whole(f"filter({n}.exons, x -> size({n}.introns) = 0)", kind, f"x.start div {size}")
    of_q = same("q") | {"q": lone("q", "q"), "l": exons("q", "l"), "r": exons("q", "r")}
    of_r = same("r") | {"q": exons("r", "q"), "l": lone("r", "l"), "r": binned("r.introns", "r", "least(x.start, x.end)", "x.start")}
    keys = ["seqid", "kind", "at", "to"]

    def met(df: DataFrame, name: str, places: dict[str, str]) -> DataFrame:
        rows = _named(df, name).withColumn("_m", F.explode(F.expr(f"concat({', '.join(places[k] for k in kinds)})")))
        rows = rows.select("seqid", name, "_m.kind", "_m.at", "_m.to", F.struct("_m.start", "_m.end").alias(f"{name}_part"))
        # few bytes are much work here, so tasks are not put together by their bytes
        return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    begins = "({0}.start BETWEEN {1}_part.start AND {1}_part.end AND ({0}.end <= {1}_part.end OR size({1}.introns) = 0))".format
    fits = f"""CASE kind WHEN 'q' THEN {begins('q', 'r')} WHEN 'l' THEN {begins('r', 'q')}
        WHEN 'r' THEN r_part.start > q_part.start AND r_part.end < q_part.end ELSE true END"""
    return met(models, "q", of_q).join(met(reference, "r", of_r), keys).where(F.expr(f"NOT {_OPPOSITE}") & F.expr(fits)).select("seqid", "q", "r")


def pairs(models: DataFrame, reference: DataFrame, run_on: int = RUN_ON, size: int = BIN) -> DataFrame:
    """q and r (structs of id, strand, exons, introns, start, end): models within run_on letters of each other.

    models, reference: id, seqid, strand, exons (array of start, end; sorted, not overlapping)."""

    def binned(df: DataFrame, name: str, margin: int) -> DataFrame:
        rows = _named(df, name)
        first = F.expr(f"({name}.start - {margin}) div {size}").alias(f"{name}_bin")
        return rows.select("seqid", name, first, F.explode(F.expr(f"sequence(({name}.start - {margin}) div {size}, ({name}.end + {margin}) div {size})")).alias("bin"))

    j = binned(models, "q", run_on).join(binned(reference, "r", 0), ["seqid", "bin"])
    return j.where((F.col("bin") == F.greatest("q_bin", "r_bin")) & (F.col("q.start") <= F.col("r.end") + run_on) & (F.col("r.start") <= F.col("q.end") + run_on)).select("seqid", "q", "r")


def code(run_on: int = RUN_ON) -> Column:
    """class_code and letters of a pair (columns q, r): its code, null where there is none, and how many letters of exons it shares."""
    inside = "({0}.start >= {1}.start AND {0}.end <= {1}.end)".format
    shared = "size(array_intersect(q.introns, r.introns))"
    length = "aggregate({0}.exons, 0L, (n, a) -> n + a.end - a.start + 1)".format
    run = "(size({0}.introns) > 0 AND array_join(transform({1}.introns, x -> concat('<', x.start, ':', x.end, '>')), '') LIKE concat('%', array_join(transform({0}.introns, x -> concat('<', x.start, ':', x.end, '>')), ''), '%'))".format
    kept = "exists(q.exons, e -> e.start < x.start AND e.end > x.end)"
    within = "filter({0}.introns, x -> x.start > {1}.start AND x.end < {1}.end)".format
    keeps = f"exists(r.introns, x -> {kept})"
    covered = f"(forall({within('r', 'q')}, x -> array_contains(q.introns, x) OR {kept}) AND forall({within('q', 'r')}, x -> array_contains(r.introns, x)))"
    junction = "(arrays_overlap(q.introns.start, r.introns.start) OR arrays_overlap(q.introns.end, r.introns.end))"
    single, lone = "size(q.introns) = 0", "size(r.introns) = 0"
    fragment = f"exists(r.introns, x -> least(q.end, x.end) - greatest(q.start, x.start) + 1 >= {FRAGMENT})"
    same = f"""CASE
        WHEN {single} AND {lone} AND 5 * ov >= 4 * greatest({length('q')}, {length('r')}) THEN '='
        WHEN NOT ({single}) AND q.introns = r.introns THEN '='
        WHEN {inside('q', 'r')} AND {run('q', 'r')} AND NOT exists(q.exons, e -> exists(r.introns, x -> e.start <= x.end AND e.end >= x.start)) THEN 'c'
        WHEN {single} AND exists(r.exons, e -> {inside('q', 'e')}) THEN 'c'
        WHEN {inside('r', 'q')} AND {run('r', 'q')} AND NOT exists(r.exons, e -> exists(q.introns, x -> e.start <= x.end AND e.end >= x.start)) THEN 'k'
        WHEN {lone} AND exists(q.exons, e -> {inside('r', 'e')}) THEN 'k'
        WHEN {keeps} AND {covered} THEN 'm'
        WHEN {keeps} THEN 'n'
        WHEN {junction} THEN 'j'
        WHEN {single} AND {fragment} THEN 'e'
        ELSE 'o' END"""
    opposite = _OPPOSITE
    decided = f"""CASE
        WHEN ov > 0 AND NOT {opposite} THEN {same}
        WHEN {opposite} AND {shared} > 0 THEN 's'
        WHEN ov > 0 THEN 'x'
        WHEN exists(r.introns, x -> {inside('q', 'x')}) THEN 'i'
        WHEN exists(q.introns, x -> {inside('r', 'x')}) THEN 'y'
        WHEN NOT {opposite} AND (q.start > r.end OR r.start > q.end) AND greatest(q.start - r.end, r.start - q.end) <= {run_on} THEN 'p' END"""
    return F.expr(f"get(transform(array({_OVERLAP}), ov -> struct({decided} AS class_code, ov AS letters)), 0)")


def _cells(models: DataFrame, key: str, margin: int, size: int = BIN) -> DataFrame:
    """key, seqid, strand, places, bin: a row for each bin that a model touches, with its exons as starts and ends by turns."""
    strand = F.expr("CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 0 END AS strand")
    places = F.expr("flatten(transform(exons, x -> array(bigint(x.start), bigint(x.end)))) AS places")
    bins = F.expr(f"explode(sequence((exons[0].start - {margin}) div {size}, (element_at(exons, -1).end + {margin}) div {size})) AS bin")
    return models.where("size(exons) > 0 AND seqid IS NOT NULL").select(key, "seqid", strand, places, bins)


def coded(models: DataFrame, reference: DataFrame, run_on: int = RUN_ON, rows: int = TASK_CELLS) -> DataFrame:
    """class_codes() of tables that hold the same rows whenever they are read; models have _row, a number of each row, and masked.

    A model goes once to each cell it touches, with its exons as numbers; tasks that get some cells find the best codes there (judged).
    Where more than rows models of a side stand in a cell, they are dealt to parts of it, and each part meets each of the other side."""
    q, r = _cells(models, "_row", run_on), _cells(reference.withColumnRenamed("id", "ref_id"), "ref_id", 0)
    count = lambda df, a, b: df.select("seqid", "bin", F.lit(a).alias("q"), F.lit(b).alias("r"))
    parts = [F.ceil(F.sum(c) / rows).cast("int").alias(c) for c in "qr"]
    sizes = written(count(q, 1, 0).unionByName(count(r, 0, 1)).groupBy("seqid", "bin").agg(*parts, F.sum(F.col("q") + F.col("r")).alias("n")).where("q > 0 AND r > 0"))
    total = sizes.agg(F.sum(F.expr("n * greatest(q, r)"))).first()[0] or 0
    tasks = max(int(models.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
    # no more of these than there are rows in portions of rows
    crowded = F.broadcast(sizes.where("q > 1 OR r > 1").select("seqid", "bin", F.col("q").alias("_q"), F.col("r").alias("_r")))

    def dealt_out(df: DataFrame, key: str, own: str, other: str, part: str) -> DataFrame:
        df = df.join(crowded, ["seqid", "bin"], "left").withColumns({"_q": F.coalesce("_q", F.lit(1)), "_r": F.coalesce("_r", F.lit(1))})
        df = df.withColumn("_own", F.expr(f"int(pmod(xxhash64({key}, places), {own}))")).withColumn("_other", F.explode(F.expr(f"sequence(0, {other} - 1)")))
        df = df.withColumn("part", F.expr(part)).withColumn("task", F.expr(f"int(pmod(xxhash64(seqid, bin, part), {4 * tasks}))"))
        # by new names of their own: both sides may come from one table
        return df.select(*(F.col(c).alias(c) for c in (key, "seqid", "bin", "part", "strand", "places", "task"))).repartition(tasks, "task")

    left, right = dealt_out(q, "_row", "_q", "_r", "_own * _r + _other"), dealt_out(r, "ref_id", "_r", "_q", "_other * _r + _own")
    met = left.groupBy("task").cogroup(right.groupBy("task"))
    kind = reference.schema["id"].dataType.simpleString()
    found = met.applyInArrow(lambda a, b: judged(a, b, CODES, run_on, FRAGMENT), f"_row long, rank int, letters long, ref_id {kind}")
    found = found.groupBy("_row").agg(F.min(F.struct("rank", (-F.col("letters")).alias("letters"), "ref_id")).alias("b"))
    alone = F.when(F.col("masked") >= 0.5, "r").otherwise("u")
    return models.select("id", "_row", "masked").join(found, "_row", "left").select(F.col("id").alias("qry_id"), F.col("b.ref_id").alias("ref_id"), F.coalesce(F.expr(f"substring('{CODES}', b.rank, 1)"), alone).alias("class_code"))


def numbered(models: DataFrame) -> DataFrame:
    """models with _row and masked, as coded() takes them once they are written."""
    masked = F.col("masked") if "masked" in models.columns else F.lit(None)
    return models.withColumns({"_row": F.monotonically_increasing_id(), "masked": masked.cast("double")})


def class_codes(models: DataFrame, reference: DataFrame, run_on: int = RUN_ON) -> DataFrame:
    """qry_id, ref_id, class_code: each model's best code, and with which reference model: of several with that code the one with the
    most overlapping letters, then the smallest id. r and u have no reference model.

    models, reference: id, seqid, strand, exons (sorted); models may have masked, the share of letters that are masked as repeats.
    Models without exons are u; equal ids are one model each row."""
    return coded(written(numbered(models)), written(reference.select("id", "seqid", "strand", "exons")), run_on)

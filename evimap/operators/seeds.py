"""Search of many patterns in long sequences by their rarest seeds: exact, with wildcards, with few substitutions.

A pattern has runs of letters that an occurrence must hold as they are: the whole of it, its longest run without a wildcard, or
each of n + 1 pieces of which n substitutions leave one alone (pigeonhole). Sequences are cut into windows at every STEP-th
place, so of any run one window of each residue class of places will do: the one that is rarest in the sequences.

Sequences go through as segments with margins as long as the longest pattern, so a task holds some segments' windows and not a
chromosome's. Segments are dealt to tasks by their number and written once: compressed bytes say little of how much there is to
search. Two passes read them: the first counts the windows that patterns have, the second finds seeds and verifies each hit beside
its window. Seeds go to the tasks (a broadcast whose size is measured; patterns that are too many for one are taken in groups).
Most windows are of no pattern: those are left out by a table of hashes, in Arrow batches, before a window becomes a row; what
comes through is joined with the seeds letter by letter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap.functions.tables import dealt, written

#: For runs of so many letters and more: letters of a window, and places between windows. least - window + 1 >= step.
SEEDS = ((63, 16, 32), (31, 12, 16), (15, 8, 4), (7, 5, 2), (4, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1))
#: Letters of a segment without its margins, at least.
SEGMENT = 4096
#: Characters of patterns that are broadcast at once, a pattern counted for each of its seeds: some 300 MB with their windows.
BROADCAST_CHARS = 32 << 20
#: Letters that are hashed together: some 50 MB with their windows' places and hashes.
HASHED = 1 << 20


def segments(targets: DataFrame, target_id: str, target: str, margin: int) -> DataFrame:
    """_id, base (places before the segment's text), lead (letters of margin before its own ones), own (how many those are), text."""
    size = max(SEGMENT, -(-margin // SEEDS[0][2]) * SEEDS[0][2])
    cut = targets.select(F.col(target_id).alias("_id"), F.regexp_extract_all(F.col(target), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_cut")).where(F.size("_cut") > 0)
    beside = F.expr(
        f"""transform(_cut, (s, i) -> named_struct('own', length(s),
              'before', if(i > 0, right(_cut[i - 1], {margin}), ''), 'text', s, 'after', if(i + 1 < size(_cut), left(_cut[i + 1], {margin}), '')))"""
    )
    rows = cut.select("_id", F.posexplode(beside).alias("_i", "s"))
    return rows.select(
        "_id",
        (F.col("_i").cast("long") * size - F.length("s.before")).alias("base"),
        F.length("s.before").alias("lead"),
        F.col("s.own").alias("own"),
        F.concat("s.before", "s.text", "s.after").alias("text"),
    )


def windows(rows: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """rows of segments() with at (places before the window in the segment's text) and seed, for windows that begin among the segment's own letters.

    kinds: letters and step. Steps are counted from the start of the whole sequence: segments begin at multiples of all of them."""

    def of(size: int, step: int) -> Column:
        begins = F.regexp_extract_all(F.substring("text", F.col("lead") + 1, F.col("own") + (size - 1)), F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))
        return F.transform(begins, lambda w, i: F.struct((F.col("lead") + i * step).alias("at"), w.alias("seed")))

    every = [of(*kind) for kind in kinds]
    return rows.select("*", F.inline(F.concat(*every) if len(every) > 1 else every[0]))


def _hashes(letters: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of so many letters (code points) that begin at these places."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[at + j]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def _table(seeds: list[str]) -> np.ndarray:
    """Whether a window's hash, by its last bits, is one of a seed's: all seeds, and one in 64 of other windows for up to a million seeds."""
    table = np.zeros(1 << min(max(64 * len(seeds), 1).bit_length(), 26), bool)
    for size in {len(x) for x in seeds}:
        of = [x for x in seeds if len(x) == size]
        for i in range(0, len(of), HASHED):
            part = of[i : i + HASHED]
            table[_hashes(_letters(part), np.arange(len(part)) * size, size) & np.uint64(len(table) - 1)] = True
    return table


def seed_windows(rows: DataFrame, kinds: list[tuple[int, int]], seeds: DataFrame, margin: int | None = None) -> DataFrame:
    """seed: of the windows(), those that are seeds (and a few others).

    seeds: seed, as many as may be broadcast. With a margin also _id, base, at (places before the window in text) and text: so
    many letters on either side of the window's begin, and how many places come before them in the sequence."""
    table = rows.sparkSession.sparkContext.broadcast(_table(seeds.select("seed").distinct().toArrow().column(0).to_pylist()))

    def each(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = np.array([len(x) for x in texts], np.int64)
            part = (np.cumsum(size) - 1) // HASHED
            for rows_ in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1) if len(texts) else ():
                yield from found(batch, texts, size, rows_)

    def found(batch, texts, size, rows_):
        own, lead = (np.asarray(batch.column(c))[rows_].astype(np.int64) for c in ("own", "lead"))
        letters, begin = _letters([texts[r] for r in rows_]), np.r_[0, np.cumsum(size[rows_])[:-1]]
        for n, step in kinds:
            count = np.maximum(np.minimum(-(-own // step), (size[rows_] - lead - n) // step + 1), 0)
            row = np.repeat(np.arange(len(rows_)), count)
            at = (begin + lead - step * np.r_[0, np.cumsum(count)[:-1]])[row] + step * np.arange(len(row))
            known = np.flatnonzero(table.value[_hashes(letters, at, n) & np.uint64(len(table.value) - 1)])
            if not len(known):
                continue
            at, row = at[known], row[known]
            joined = letters[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le")
            seed = pa.array([joined[i : i + n] for i in range(0, len(joined), n)], pa.string())
            if margin is None:
                yield pa.RecordBatch.from_arrays([seed], names=["seed"])
                continue
            at, taken = at - begin[row], pa.array(rows_[row])
            first = np.maximum(at - margin, 0)
            near = [texts[r][a:b] for r, a, b in zip(rows_[row].tolist(), first.tolist(), (at + margin).tolist(), strict=True)]
            base = np.asarray(batch.column("base"))[rows_[row]] + first
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(taken), pa.array(base), pa.array(at - first), pa.array(near, pa.string()), seed], names=["_id", "base", "at", "text", "seed"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(each, "seed string" if margin is None else f"_id {kind}, base bigint, at bigint, text string, seed string")


def _of_kind(i: int) -> Column:
    return reduce(lambda out, s: out.when(F.length("run") >= s[0], s[i]), SEEDS, F).otherwise(1)


def _runs_seeds(runs: DataFrame) -> DataFrame:
    """All windows of runs (pattern columns, at, run) that may be their seeds: class, size, shift (places before it in the pattern), seed."""
    rows = runs.withColumn("size", _of_kind(1)).withColumn("step", _of_kind(2))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("run") - F.col("size"))).alias("_o"))
    return rows.select(*runs.columns, "size", (F.col("_o") % F.col("step")).alias("class"), (F.col("at") + F.col("_o")).alias("shift"), F.expr("substring(run, _o + 1, size)").alias("seed"))


def search(targets: DataFrame, runs: DataFrame, target_id: str, target: str, hit: Column, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """target_id, key, pattern, position (from 1), found: places where a run of a pattern stands and hit holds.

    runs: key, pattern, at (letters before the run in the pattern), run. hit: a predicate over pattern and found, the letters
    of the sequence in the pattern's place."""
    runs = written(runs.where("length(run) > 0"))
    facts = runs.agg(F.max(F.length("pattern")).alias("margin"), F.collect_set(F.length("run")).alias("lengths"), F.sum(_of_kind(2) * F.length("pattern")).alias("chars")).first()
    empty = F.lit(None).cast("string").alias("found")
    if not facts["chars"]:
        none = targets.select(target_id).limit(0)
        return none.join(runs.select("key", "pattern").limit(0), F.lit(True)).select(target_id, "key", "pattern", F.lit(1).cast("long").alias("position"), empty)
    kinds = sorted({next((k, step) for least, k, step in SEEDS if n >= least) for n in facts["lengths"]})
    groups = -(-facts["chars"] // broadcast_chars)
    margin = facts["margin"]
    cut = segments(targets, target_id, target, margin)
    cut = written(dealt(cut, targets.count(), "_id", "base"))
    found = []
    for g in range(groups):
        own = runs if groups == 1 else runs.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g)
        possible = written(_runs_seeds(own))
        # how often each of these windows stands in the sequences: counted inside the scan, then summed up
        counts = seed_windows(cut, kinds, possible).join(F.broadcast(possible.select("seed").distinct()), "seed").groupBy("seed").agg(F.count("*").alias("n"))
        ranked = possible.join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        seeds = ranked.groupBy("key", "pattern", "at", "run", "class").agg(F.min(F.struct("n", "shift", "seed")).alias("s")).select("key", "pattern", "s.*")
        seeds = seeds.where("n > 0").drop("n")  # in a class with a window that stands nowhere a run stands nowhere
        place = F.col("at") - F.col("shift")
        letters = F.expr("substring(text, int(at - shift + 1), length(pattern))")
        seeds = written(seeds)
        hits = seed_windows(cut, kinds, seeds, margin).join(F.broadcast(seeds), "seed").where((place >= 0) & (F.length(letters) == F.length("pattern")))
        hits = hits.select(F.col("_id").alias(target_id), "key", "pattern", (F.col("base") + place + 1).alias("position"), letters.alias("found")).where(hit)
        found.append(hits)
    return reduce(DataFrame.unionByName, found)


def exact_runs(patterns: DataFrame, key: str, pattern: str) -> DataFrame:
    return patterns.select(F.col(key).alias("key"), F.col(pattern).alias("pattern"), F.lit(0).alias("at"), F.col(pattern).alias("run"))


def wildcard_runs(patterns: DataFrame, key: str, pattern: str, alphabet: str) -> DataFrame:
    """The longest run without an X, the first of several; for a pattern of X alone each letter of the alphabet at its start."""
    rows = patterns.select(F.col(key).alias("key"), F.col(pattern).alias("pattern"))
    # runs as (length, -place, text): the largest is the longest, first one
    parts = F.expr("transform(split(pattern, 'X'), (s, i) -> named_struct('n', length(s), 'i', -i, 'run', s))")
    best = rows.withColumn("_best", F.array_max(parts)).select("key", "pattern", "_best.*")
    before = F.expr("aggregate(slice(split(pattern, 'X'), 1, -i), 0, (n, s) -> n + length(s) + 1)")
    some = best.where("n > 0").select("key", "pattern", before.alias("at"), "run")
    none = best.where("n = 0 and pattern <> ''").select("key", "pattern", F.lit(0).alias("at"), F.explode(F.array(*map(F.lit, alphabet))).alias("run"))
    return some.unionByName(none)


def piece_runs(patterns: DataFrame, key: str, pattern: str, pieces: int) -> DataFrame:
    """The pattern cut into so many pieces of about equal length; for one with fewer letters than pieces, its letters."""
    rows = patterns.select(F.col(key).alias("key"), F.col(pattern).alias("pattern")).where("length(pattern) > 0")
    bounds = f"transform(sequence(0, {pieces - 1}), k -> named_struct('at', int(k * length(pattern) div {pieces}), 'end', int((k + 1) * length(pattern) div {pieces})))"
    cut = rows.select("key", "pattern", F.inline(F.expr(bounds)))
    return cut.select("key", "pattern", "at", F.expr("substring(pattern, at + 1, end - at)").alias("run"))

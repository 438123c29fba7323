"""Sequence search: occurrences, wildcards and substitutions in place (by seeds), context, alternatives, collapse of equal sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.scalars import MODIFICATIONS, peptide_mass, searchable
from evimap.functions.tables import dealt, written
from evimap.operators import seeds

#: Letters that a wildcard stands for, I being L.
ALPHABET = "ACDEFGHKLMNPQRSTVWY"


def occurrences(targets: DataFrame, patterns: DataFrame, target_id: str, target: str, pattern_id: str, pattern: str) -> DataFrame:
    """target_id, pattern_id, position (from 1): all, possibly overlapping, occurrences of patterns of any length but 0."""
    found = seeds.search(targets, seeds.exact_runs(patterns, pattern_id, pattern), target_id, target, F.col("found") == F.col("pattern"))
    # seeds of several residue classes stand at different places, so an exact hit comes once
    return found.select(target_id, F.col("key").alias(pattern_id), "position")


def _looked_up(every: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """every peptide (with _p) with what was found for it; UNMAPPED at 0 where nothing was.

    A peptide may stand in most sequences, so rows found aren't dealt by peptide where the peptides can be broadcast."""
    every, found = written(every), written(found.withColumnRenamed("pattern", "_p"))
    none = {"protein": F.lit("UNMAPPED"), "position": F.lit(0).cast("long")}
    lacking = every.join(found.select("_p").distinct(), "_p", "left_anti")
    empty = [none.get(c, F.lit(None).cast(t)).alias(c) for c, t in found.dtypes if c in columns]
    return every.join(found, "_p").select("peptide", *columns).unionByName(lacking.select("peptide", *empty))


def _asked(peptides: DataFrame) -> DataFrame:
    return peptides.select(F.trim("peptide").alias("peptide")).distinct().withColumn("_p", F.translate("peptide", "I", "L"))


def lookup(peptides: DataFrame, proteins: DataFrame, least: int = 5, wildcards: bool = False) -> DataFrame:
    """peptide, protein, position: where each distinct peptide stands, with I as L; what can't be searched or isn't found is UNMAPPED at 0.

    peptides: peptide; proteins: id, sequence. wildcards: an X in a peptide stands for any of the residues; however many
    there are, a peptide is one pattern, found by its longest run without X and verified letter by letter."""
    every = _asked(peptides)
    plain = F.translate("_p", "X", "") if wildcards else F.col("_p")
    wanted = every.where(searchable(F.when(F.length(plain) > 0, plain).otherwise("A"), 1) & (F.length("_p") >= least)).select("_p").distinct()
    if wildcards:
        runs = seeds.wildcard_runs(wanted, "_p", "_p", ALPHABET)
        letters = F.zip_with(F.split("pattern", ""), F.split("found", ""), lambda p, c: (p == c) | (p == "X"))
        hit = F.forall(letters, lambda x: x) & F.col("found").rlike(f"^[{ALPHABET}]+$")
    else:
        runs, hit = seeds.exact_runs(wanted, "_p", "_p"), F.col("found") == F.col("pattern")
    found = seeds.search(_residues(proteins), runs, "id", "_s", hit).select("pattern", F.col("id").cast("string").alias("protein"), "position")
    return _looked_up(every, found, ["protein", "position"])


def _residues(proteins: DataFrame) -> DataFrame:
    return proteins.select("id", F.translate("sequence", "I", "L").alias("_s"))


def fuzzy_lookup(peptides: DataFrame, proteins: DataFrame, sites: int, least: int = 5) -> DataFrame:
    """peptide, protein, position, substitutions, places: where each distinct peptide stands with residues exchanged at one
    site, at two, or (3) within three that follow each other; I is L. What can't be searched or isn't found is UNMAPPED at 0.

    places: as substitutions() writes them, the sequence's letter at each. Sequences are searched for the sites + 1
    pieces of a peptide, of which one stands as it is, and each place is compared once, letter by letter."""
    if sites not in (1, 2, 3):
        raise ValueError("there are one to three free sites")
    every = _asked(peptides)
    wanted = every.where(searchable(F.col("_p"), least)).select("_p").distinct()
    differ = F.array_compact(F.zip_with(F.sequence(F.lit(1), F.length("pattern")), F.split("pattern", ""), lambda i, p: F.when(F.substr("found", i, F.lit(1)) != p, i)))
    close = F.size(differ) <= sites
    if sites == 3:
        close = (F.size(differ) == 0) | (F.array_max(differ) - F.array_min(differ) < 3)
    runs = seeds.piece_runs(wanted, "_p", "_p", sites + 1)
    found = seeds.search(_residues(proteins), runs, "id", "_s", close & F.col("found").rlike(f"^[{ALPHABET}]+$"))
    found = found.select("pattern", F.col("id").cast("string").alias("protein"), "position", F.size(differ).alias("substitutions"), substitutions(F.col("pattern"), F.col("found")).alias("places")).distinct()
    return _looked_up(every, found, ["protein", "position", "substitutions", "places"])


def variant_lookup(peptides: DataFrame, proteins: DataFrame, least: int = 5) -> DataFrame:
    """lookup() with variants: peptide, protein, position, variants (of the hit, as 12:A>V;15:K>R; empty where it has none).

    proteins: id, sequence, variants (array of at, from 1, and residue). A residue of a peptide may be the sequence's or any
    variant's of that place, so a peptide may span several variant sites. Hits with a variant are found by windows of `least`
    letters around variant sites, with every choice of letters that has a variant at the site; each window carries the
    letters and variants as far as the longest peptide reaches, and hits are verified there. A * is no residue."""
    every = _asked(peptides)
    wanted = every.where(searchable(F.col("_p"), least)).select("_p").distinct()
    plain = seeds.search(_residues(proteins), seeds.exact_runs(wanted, "_p", "_p"), "id", "_s", F.col("found") == F.col("pattern"))
    plain = plain.select("pattern", F.col("id").cast("string").alias("protein"), "position", F.lit("").alias("variants"))
    reach = wanted.agg(F.max(F.length("_p"))).first()[0] or 0  # one number
    # dealt by their number: short sequences are few bytes, but each has many windows
    rows = dealt(proteins, proteins.count(), "id").select(F.col("id").cast("string").alias("protein"), F.translate("sequence", "I", "L").alias("_s"), F.expr("array_distinct(transform(variants, v -> named_struct('at', int(v.at), 'residue', translate(v.residue, 'I', 'L'))))").alias("_v"))
    real = "filter(_v, v -> v.at between 1 and length(_s) and v.residue <> '*' and v.residue <> substring(_s, v.at, 1))"
    sites = rows.withColumn("_v", F.expr(real)).where("size(_v) > 0").withColumn("site", F.explode(F.expr("array_distinct(_v.at)")))
    near = sites.select("protein", "site", F.expr(f"greatest(site - {reach}, 1)").alias("from"), F.expr(f"substring(_s, greatest(site - {reach}, 1), site + {reach} - greatest(site - {reach}, 1) + 1)").alias("text"), F.expr(f"filter(_v, v -> abs(v.at - site) <= {reach})").alias("_v"))
    placed = near.withColumn("w", F.expr(f"explode(sequence(greatest(site - {least - 1}, from), site))")).where(f"w + {least - 1} < from + length(text)")
    # the choices of letters at a place: the sequence's, but at the site itself, and the variants'
    choices = "concat(if(w + j = site or substring(text, w + j - from + 1, 1) = '*', array(), array(substring(text, w + j - from + 1, 1))), transform(filter(_v, v -> v.at = w + j), v -> v.residue))"
    choices = choices.replace("array(), array(", "cast(array() as array<string>), array(")
    windows = f"aggregate(sequence(0, {least - 1}), array(''), (a, j) -> flatten(transform(a, s -> transform({choices}, c -> concat(s, c)))))"
    windows = placed.select("protein", "from", "text", "_v", "w", F.explode(F.expr(windows)).alias("seed"))
    asked = wanted.select(F.col("_p").alias("pattern"), F.posexplode(F.expr(f"transform(sequence(1, length(_p) - {least - 1}), i -> substring(_p, i, {least}))")).alias("shift", "seed"))
    hits = windows.join(asked, "seed").withColumn("position", F.col("w") - F.col("shift")).where("position >= from and position + length(pattern) <= from + length(text)")
    letters = "transform(split(pattern, ''), (c, j) -> named_struct('at', position + j, 'c', c, 'own', substring(text, position + j - from + 1, 1)))"
    hits = hits.withColumn("letters", F.expr(f"filter({letters}, x -> x.c <> x.own and x.c <> '')")).where("forall(letters, x -> exists(_v, v -> v.at = x.at and v.residue = x.c))")
    used = F.expr("array_join(transform(letters, x -> concat(x.at, ':', x.own, '>', x.c)), ';')")
    found = plain.unionByName(hits.select("pattern", "protein", F.col("position").cast("long").alias("position"), used.alias("variants")).distinct())
    return _looked_up(every, found, ["protein", "position", "variants"])


def with_context(found: DataFrame, targets: DataFrame, patterns: DataFrame, target_id: str, target: str, pattern_id: str, pattern: str) -> DataFrame:
    """Adds before and after (a character, - at the ends) and ntt, the tolerable tryptic termini."""
    j = found.join(targets.select(target_id, F.col(target).alias("_t")), target_id).join(patterns.select(pattern_id, F.col(pattern).alias("_p")), pattern_id)
    before = F.expr("if(position > 1, substring(_t, position - 1, 1), '-')")
    after = F.expr("if(position + length(_p) <= length(_t), substring(_t, position + length(_p), 1), '-')")
    j = j.withColumn("before", before).withColumn("after", after)
    start = F.expr("before = '-' or (before in ('K', 'R') and not startswith(_p, 'P'))").cast("int")
    end = F.expr("after = '-' or (right(_p, 1) in ('K', 'R') and after <> 'P')").cast("int")
    return j.withColumn("ntt", start + end).drop("_t", "_p")


def substitutions(peptide: Column, original: Column) -> Column:
    """The places (from 0) and original letters at which two sequences of one length differ, as 0,A;3,C; and so on."""
    pairs = F.zip_with(F.split(peptide, ""), F.split(original, ""), lambda a, b: F.when(a != b, b))
    return F.array_join(F.array_compact(F.transform(pairs, lambda x, i: F.when(x.isNotNull(), F.concat(i.cast("string"), F.lit(","), x, F.lit(";"))))), "")


def alternatives(hits: DataFrame, sink: str | None = None, float_: str | None = None, most: int = 1, least_ntt: int = 0) -> DataFrame:
    """hits (peptide, original, protein, ntt) with substitutions and nth: a peptide's proteins by fewest substitutions,
    most tolerable termini, priority and name. Proteins that begin with sink come later, with float_ earlier."""
    rows = hits.withColumn("substitutions", F.size(F.filter(F.split(substitutions(F.col("peptide"), F.col("original")), ";"), lambda x: x != "")))
    priority = F.lit(1)
    if sink:
        priority = priority + F.col("protein").startswith(sink).cast("int")
    if float_:
        priority = priority - F.col("protein").startswith(float_).cast("int")
    order = Window.partitionBy("peptide").orderBy("substitutions", F.desc("ntt"), "_priority", "protein")
    return rows.where((F.col("substitutions") <= most) & (F.col("ntt") >= least_ntt)).withColumn("_priority", priority).withColumn("nth", F.row_number().over(order)).drop("_priority")


def collapse(sequences: DataFrame, id_col: str, sequence: str) -> DataFrame:
    """id_col, representative (the smallest id of an equal sequence), n: equal sequences once, as members of one."""
    groups = sequences.groupBy(sequence).agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("n"))
    return sequences.select(id_col, sequence).join(groups, sequence).select(id_col, "representative", "n")


def expanded(peptides: DataFrame, column: str = "peptide") -> DataFrame:
    """Each peptide with every letter of the alphabet for each X: peptide, expanded."""
    letters = ", ".join(f"'{x}'" for x in ALPHABET)
    every = f"aggregate(split({column}, ''), array(''), (a, c) -> flatten(transform(a, x -> transform(if(c = 'X', array({letters}), array(c)), y -> concat(x, y)))))"
    return peptides.select(F.col(column).alias("peptide"), F.explode(F.expr(every)).alias("expanded"))


def fuzzy(peptides: DataFrame, sites: int, column: str = "peptide") -> DataFrame:
    """peptide, pattern: X at one site, at each two, or at three that follow each other."""
    if sites not in (1, 2, 3):
        raise ValueError("there are one to three free sites")
    at = "explode(sequence(1, {}))"
    put = "concat(substring({0}, 1, {1} - 1), '{2}', substring({0}, {1} + {3}))"
    rows = peptides.select(F.col(column).alias("peptide")).where(F.length("peptide") >= sites)
    if sites == 3:
        return rows.withColumn("i", F.expr(at.format("length(peptide) - 2"))).select("peptide", F.expr(put.format("peptide", "i", "XXX", 3)).alias("pattern"))
    one = rows.withColumn("i", F.expr(at.format("length(peptide)"))).select("peptide", "i", F.expr(put.format("peptide", "i", "X", 1)).alias("pattern"))
    if sites == 1:
        return one.select("peptide", "pattern")
    two = one.where("i < length(peptide)").withColumn("j", F.expr("explode(sequence(i + 1, length(peptide)))"))
    return two.select("peptide", F.expr(put.format("pattern", "j", "X", 1)).alias("pattern"))


def within_mass(peptide: Column, target: Column, tolerance: float) -> Column:
    """Whether a peptide weighs as much as target, give or take tolerance, itself or with any of the modifications that
    its termini and residues may have, one each."""
    table = {}
    for residue, mass in MODIFICATIONS:
        table.setdefault(residue, []).append(mass)
    options = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, [0.0, *v])))])
    lacking = target - peptide_mass(peptide)
    letters = F.filter(F.split(F.concat(F.lit("nc"), peptide), ""), lambda c: F.array_contains(F.map_keys(options), c))
    # sums that can be had so far, to four places as the masses are, none beyond what is lacking
    step = lambda a, c: F.array_distinct(F.filter(F.flatten(F.transform(a, lambda s: F.transform(F.element_at(options, c), lambda m: F.rint((s + m) * 1e4) / 1e4))), lambda s: s <= lacking + tolerance))
    sums = F.aggregate(letters, F.array(F.lit(0.0)), step)
    return (lacking >= -tolerance) & ((lacking < tolerance) | F.exists(sums, lambda s: s - lacking > -tolerance))


def modified(peptide: Column, target: Column, tolerance: float) -> Column:
    """The peptide and behind it, as (+mass), the modifications that make it weigh as much as target, give or take
    tolerance: of several choices the one that modifies the first site (termini, then residues) where they differ, by
    the first modification in the table's order. The peptide alone where it needs none, null where none fit."""
    table = {}
    for residue, mass in MODIFICATIONS:
        table.setdefault(residue, []).append(mass)
    option = lambda m: F.struct(F.lit(m).alias("mass"), F.lit(f"(+{m:.4f})" if m else "").alias("text"))
    options = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(option, [*v, 0.0])))])
    lacking = target - peptide_mass(peptide)
    letters = F.filter(F.split(F.concat(F.lit("nc"), peptide), ""), lambda c: F.array_contains(F.map_keys(options), c))
    fits = lambda s: s - lacking > -tolerance
    added = lambda s, o: F.struct((F.rint((s["sum"] + o["mass"]) * 1e4) / 1e4).alias("sum"), F.concat(s["text"], o["text"]).alias("text"))

    def step(found: Column, letter: Column) -> Column:
        # choices stay in order of preference, so of equal sums the first will do; one that fits takes no more
        each = F.flatten(F.transform(found, lambda s: F.when(fits(s["sum"]), F.array(s)).otherwise(F.transform(F.element_at(options, letter), lambda o: added(s, o)))))
        light = F.filter(each, lambda s: s["sum"] <= lacking + tolerance)
        return F.filter(light, lambda s, i: F.array_position(light["sum"], s["sum"]) == i + 1)

    none = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("text")))
    first = F.try_element_at(F.filter(F.aggregate(letters, none, step), lambda s: fits(s["sum"])), F.lit(1))["text"]
    return F.when(lacking < -tolerance, None).when(lacking < tolerance, peptide).otherwise(F.concat(peptide, first))


def within_substitutions(targets: DataFrame, patterns: DataFrame, most: int, target_id: str, target: str, pattern_id: str, pattern: str) -> DataFrame:
    """Pairs of equal length with at most so many differing characters, found by equal pieces.

    Cut into most + 1 pieces, two such texts agree in one of them: pairs are joined on (length, piece, its text). Equal
    texts meet once, and a pair where its first equal piece is."""
    pieces = most + 1
    cut = f"transform(sequence(0, {most}), k -> substring(_s, int(k * length(_s) / {pieces}) + 1, int((k + 1) * length(_s) / {pieces}) - int(k * length(_s) / {pieces})))"

    def cut_up(df: DataFrame, text: str, name: str) -> DataFrame:
        rows = df.select(F.col(text).alias("_s")).distinct().withColumn("_pieces", F.expr(cut))
        return rows.select(F.col("_s").alias(name), F.length("_s").alias("_n"), F.col("_pieces").alias(f"{name}_pieces"), F.posexplode("_pieces").alias("k", "piece"))

    pairs = cut_up(targets, target, "_t").join(cut_up(patterns, pattern, "_p"), ["_n", "k", "piece"]).where("not exists(zip_with(slice(_t_pieces, 1, k), slice(_p_pieces, 1, k), (a, b) -> a = b), x -> x)")
    differ = F.expr("size(filter(zip_with(split(_t, ''), split(_p, ''), (a, b) -> a <> b), x -> x))")
    pairs = pairs.select("_t", "_p", differ.alias("substitutions")).where(F.col("substitutions") <= most)
    named = pairs.join(targets.select(target_id, F.col(target).alias("_t")), "_t").join(patterns.select(pattern_id, F.col(pattern).alias("_p")), "_p")
    return named.select(target_id, pattern_id, "substitutions")

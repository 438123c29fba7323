"""Comparing annotations: structural differences, loci, class codes, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.functions.scalars import rounded
from evimap.functions.tables import dealt, written

#: Class codes and what they stand for: fixed values of the report.
CLASS_CODES = {
    "=": "exact match to prediction-supported model",
    "c": "contained within prediction-supported model",
    "j": "novel isoform with shared splice junctions",
    "e": "single exon transfrag partially covering a prediction intron",
    "i": "fully contained within a prediction intron",
    "k": "contains a prediction-supported transcript (reverse containment)",
    "m": "retained intron(s); all introns matched or retained",
    "n": "retained intron(s); not all introns matched/covered",
    "o": "other same-strand overlap with prediction exons",
    "p": "possible polymerase run-on fragment",
    "r": "repeat-associated transcript",
    "u": "no overlap with any prediction-supported gene locus",
    "x": "exonic overlap on opposite strand",
    "s": "intron match on the opposite strand",
    "y": "contains a prediction-supported model within its intron(s)",
}
IDENTICAL, NOVEL, ACCEPTED = ("=",), ("s", "x", "i", "y", "p", "u"), ("=", "j", "c", "k", "m", "n")


def models(segments: DataFrame, key: str = "protein", place: str | None = None) -> DataFrame:
    """One row per model: seqid, strand, gene where there is one, regions (sorted); with a place, the last row's seqid, strand and gene hold."""
    what = [c for c in ("seqid", "strand", "gene") if c in segments.columns]
    last = [F.max_by(c, place).alias(c) if place else F.max(c).alias(c) for c in what]
    return segments.groupBy(key).agg(*last, F.sort_array(F.collect_set(F.struct("start", "end"))).alias("regions"))


def first_boundary(m: str) -> str:
    """Where translation of a model (a struct) begins; any strand but + reads backwards."""
    return f"if({m}.strand = '+', {m}.regions[0].start, element_at({m}.regions, -1).end)"


def last_boundary(m: str) -> str:
    return f"if({m}.strand = '+', element_at({m}.regions, -1).end, {m}.regions[0].start)"


def chain(m: str) -> str:
    """The junctions of a model: end of a region and start of the next."""
    return f"array_sort(array_distinct(zip_with(slice({m}.regions, 1, size({m}.regions) - 1), slice({m}.regions, 2, size({m}.regions)), (a, b) -> struct(a.end as donor, b.start as acceptor))))"


def classify_difference(pairs: DataFrame, p: str = "p", r: str = "r") -> DataFrame:
    """Adds difference from two models (structs of seqid, strand, regions): a decision list, first hit wins."""
    pf, pl, rf, rl = first_boundary(p), last_boundary(p), first_boundary(r), last_boundary(r)
    return pairs.withColumn(
        "difference",
        F.expr(f"""case
            when {p} is null or {r} is null then 'missing_coordinates'
            when coalesce(size({p}.regions), 0) < 1 or coalesce(size({r}.regions), 0) < 1 then 'missing_cds_regions'
            when {p}.seqid <> {r}.seqid or {p}.strand <> {r}.strand then 'different_chromosome_or_strand'
            when {chain(p)} <> {chain(r)} then 'different_splice'
            when {pf} = {rf} and {pl} = {rl} and size({p}.regions) = size({r}.regions) then 'same_start_same_stop'
            when {pf} = {rf} and {pl} = {rl} then 'same_start_same_stop_different_exons'
            when {pf} = {rf} and abs({pl} - {rl}) > 3 then 'same_start_different_stop'
            when {pf} = {rf} then 'same_start_same_stop'
            when {pl} = {rl} then 'different_start_same_stop'
            when ({p}.strand = '+' and {pf} < {rf}) or ({p}.strand <> '+' and {pf} > {rf}) then 'upstream_extension'
            else 'downstream_truncation' end"""),
    )


def stop_difference(p: str = "p", r: str = "r", tolerance: int = 3) -> Column:
    """Whether two models of one strand begin at the same place and end more than so many bases apart, spliced alike or not."""
    same = f"{p}.seqid <=> {r}.seqid and {p}.strand <=> {r}.strand and size({p}.regions) > 0 and size({r}.regions) > 0"
    return F.expr(f"coalesce({p} is not null and {r} is not null and {same} and {first_boundary(p)} = {first_boundary(r)} and abs({last_boundary(p)} - {last_boundary(r)}) > {tolerance}, false)")


#: Junctions of a name that are compared with each other; a name with more is looked up at each of them.
NAME_JUNCTIONS = 32


def _named(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def spans(located: DataFrame, name: str = "peptide") -> DataFrame:
    """One row per located peptide of several blocks: name, seqid, b (blocks, sorted), js (seqid, donor and acceptor of each two neighbouring
    blocks, distinct), forked (whether two of these share one end)."""
    rows = located.where(F.col(name).isNotNull() & F.col("seqid").isNotNull() & (F.size("b") > 1)).select(F.col(name).alias("name"), "seqid", F.array_sort("b").alias("b"))
    rows = rows.withColumn("js", F.array_distinct(F.expr("zip_with(slice(b, 1, size(b) - 1), slice(b, 2, size(b)), (x, y) -> struct(seqid, x.e as donor, y.s as acceptor))")))
    return rows.select("name", "seqid", "b", "js", F.expr("size(js) > 1 and (size(array_distinct(js.donor)) < size(js) or size(array_distinct(js.acceptor)) < size(js))").alias("forked"))


def _two(js: str) -> Column:
    """Each two junctions of a sorted array."""
    return F.expr(f"flatten(transform({js}, (x, i) -> transform(slice({js}, i + 2, size({js})), y -> struct(x as one, y as two))))")


def _listed_support(sets: DataFrame, listed: DataFrame) -> DataFrame:
    """set, listed: junction_support() of sets of junctions, name by name."""
    at = listed.withColumn("place", _named("name", "seqid", "b")).select("place", "name", F.explode("js").alias("j"))
    ours = at.join(sets.select("set", F.explode("own").alias("j")), "j")
    theirs = at.join(sets.select("set", F.explode("theirs").alias("j")), "j").select(F.col("set").alias("_set"), F.col("place").alias("_place"), F.col("j").alias("_j"))
    against = (F.col("set") == F.col("_set")) & (F.col("place") == F.col("_place")) & ((F.col("j.donor") == F.col("_j.donor")) | (F.col("j.acceptor") == F.col("_j.acceptor")))
    return ours.join(theirs, against, "left_anti").groupBy("set").agg(F.countDistinct("name").alias("listed"))


def junction_support(pairs: DataFrame, located: DataFrame, key: str = "qry_id", name: str = "peptide") -> DataFrame:
    """key, splice_support: peptides (by name) across a junction that only the predicted model has, unless the same
    location also spans a junction that only the reference has and that shares an end with it.

    pairs: key, p and r. Matching is by sequence id and place; both models need regions, the predicted one two.

    Models and peptides that meet at a junction are not paired: that grows with the square of how many stand there. Models of
    equal junctions are one set, and names of equal junctions one class. A set's names are those of its junctions, summed up, less
    those counted more than once: classes that have two of its junctions. Only names with a location that spans junctions with an end
    in common, or with more than NAME_JUNCTIONS, are looked up one by one."""
    some = pairs.where("size(p.regions) > 1 and size(r.regions) > 0 and p.seqid is not null")
    of = lambda m: F.expr(f"transform({chain(m)}, x -> struct(p.seqid as seqid, x.donor as donor, x.acceptor as acceptor))")
    some = some.select(key, of("p").alias("pj"), of("r").alias("rj")).select(key, F.array_except("pj", "rj").alias("own"), F.array_except("rj", "pj").alias("theirs")).where("size(own) > 0 or size(theirs) > 0")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    # what is one pair's own and another's of the same key only the reference's has itself against it
    sets = some.groupBy(key).agg(every("own"), every("theirs")).select(key, F.array_sort(F.array_except("own", "theirs")).alias("own"), F.array_sort("theirs").alias("theirs"))
    members = written(sets.where("size(own) > 0").withColumn("set", _named("own", "theirs")))
    sets = written(members.groupBy("set").agg(F.first("own").alias("own"), F.first("theirs").alias("theirs")))

    rows = written(spans(located, name))
    long = rows.groupBy("name").agg(F.sum(F.size("js")).alias("n"), F.max("forked").alias("forked")).where(F.col("forked") | (F.col("n") > NAME_JUNCTIONS)).select("name")
    long = written(long)
    listed = _listed_support(sets, rows.join(long, "name", "left_semi"))
    names = rows.join(long, "name", "left_anti").groupBy("name").agg(F.array_sort(every("js")).alias("js"))
    classes = written(names.groupBy("js").agg(F.count(F.lit(1)).alias("names")))
    # names of each junction, and names of each two
    at = classes.select(F.explode("js").alias("j"), "names").groupBy("j").agg(F.sum("names").alias("names"))
    counted = sets.select("set", F.explode("own").alias("j")).join(at, "j").groupBy("set").agg(F.sum("names").alias("counted"))
    two = classes.where("size(js) > 1").select(_named("js").alias("class"), "names", F.explode(_two("js")).alias("jj"))
    both = two.join(sets.where("size(own) > 1").select("set", F.explode(_two("own")).alias("jj")), "jj").groupBy("set", "class").agg(F.first("names").alias("names"), F.count(F.lit(1)).alias("n"))
    # of k junctions there are k (k - 1) / 2 twos, and k - 1 are too many
    again = both.groupBy("set").agg(F.sum(F.col("names") * F.expr("cast(round((sqrt(8 * n + 1) - 1) / 2) as bigint)")).alias("again"))
    total = counted.join(again, "set", "left").join(listed, "set", "full").select("set", F.expr("coalesce(counted, 0) - coalesce(again, 0) + coalesce(listed, 0)").alias("splice_support"))
    return members.select(key, "set").join(total, "set").select(key, "splice_support")


#: Measures of a predicted model in the report.
REPORTED = ("n_terminal_peptides", "c_terminal_peptides", "splice_peptides", "mapped_peptides", "sequence_coverage")
START_DIFFERENCES = ("different_start_same_stop", "upstream_extension", "downstream_truncation")
SPLICE_DIFFERENCES = ("different_splice", "same_start_same_stop_different_exons")


def evidence_report(codes: DataFrame, scores: DataFrame, predicted: DataFrame, reference: DataFrame, located: DataFrame, name: str = "peptide") -> DataFrame:
    """Differences from the reference that peptides speak for: predicted_id, reference_id, structural_difference,
    peptide_evidence_category and the model's measures, splice_peptides being those across its own junctions.

    codes: qry_id, ref_id, class_code, of which identical and novel ones are left out; scores: protein and measures, 0
    where there is none; predicted, reference: models(). A different stop with C-terminal peptides comes first, then a
    different splicing with peptides on it, then a different start with N-terminal peptides."""
    some = codes.where(F.col("class_code").isNull() | ~F.col("class_code").isin(*IDENTICAL, *NOVEL)).select("qry_id", "ref_id")
    rows = some.join(scores.select(F.col("protein").alias("qry_id"), *REPORTED), "qry_id", "left").na.fill(0)
    model = lambda m, key, to: m.select(F.col("protein").alias(key), F.struct("seqid", "strand", "regions").alias(to))
    rows = rows.join(model(predicted, "qry_id", "p"), "qry_id", "left").join(model(reference, "ref_id", "r"), "ref_id", "left")
    rows = classify_difference(rows).withColumn("_stop", stop_difference() & (F.col("c_terminal_peptides") > 0)).withColumn("_pair", F.struct("qry_id", "ref_id"))
    splice = F.col("difference").isin(*SPLICE_DIFFERENCES) & ~F.col("_stop")
    rows = written(rows)
    rows = rows.join(junction_support(rows.where(splice), located, "_pair", name), "_pair", "left")
    start = F.col("difference").isin(*START_DIFFERENCES) & (F.col("n_terminal_peptides") > 0)
    category = F.when(F.col("_stop"), "peptide_support_different_stop").when(splice & (F.col("splice_support") > 0), "peptide_support_different_splice").when(start, "peptide_support_different_start")
    rows = rows.withColumn("peptide_evidence_category", category).where("peptide_evidence_category is not null")
    measures = [F.coalesce(F.when(F.col("peptide_evidence_category") == "peptide_support_different_splice", F.col("splice_support")), F.col(c)).alias(c) if c == "splice_peptides" else F.col(c) for c in REPORTED]
    return rows.select(F.col("qry_id").alias("predicted_id"), F.col("ref_id").alias("reference_id"), F.col("difference").alias("structural_difference"), "peptide_evidence_category", *measures)


def category_summary(rows: DataFrame, category: str, id_col: str, examples: int = 10) -> DataFrame:
    """category, n, examples (so many smallest ids, sorted, joined). The members are rows of category and id."""
    ids = rows.select(category, id_col).distinct()
    few = ids.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(id_col))).where(F.col("_n") <= examples)
    listed = few.groupBy(category).agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("examples"))
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).join(listed, category)


def set_text(c: str) -> Column:
    """The distinct values of a group as {a,b}."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))), ","), F.lit("}"))


def locus_summary(rows: DataFrame) -> DataFrame:
    """protein, genes (sorted, joined; the protein where there is none), seqid, strand, start, end."""
    genes = F.array_join(F.array_sort(F.collect_set(F.col("gene").cast("string"))), ",")
    out = rows.groupBy("protein").agg(genes.alias("genes"), F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumn("genes", F.when(F.col("genes") == "", F.col("protein").cast("string")).otherwise(F.col("genes")))


def class_code_summary(rows: DataFrame, code: str) -> DataFrame:
    """class_code, n, description, fraction (4 places); null codes are NA."""
    counts = rows.groupBy(F.coalesce(F.col(code), F.lit("NA")).alias("class_code")).agg(F.count(F.lit(1)).alias("n"))
    table = F.create_map(*[F.lit(x) for kv in CLASS_CODES.items() for x in kv])
    total = F.sum("n").over(Window.partitionBy())  # over a row per code
    return counts.select("class_code", "n", F.coalesce(F.element_at(table, F.col("class_code")), F.lit("other/unknown")).alias("description"), rounded(F.col("n") / total, 4).alias("fraction"))


def overlap_statistics(pairs: DataFrame, left: str, right: str, n_left: int, n_right: int) -> DataFrame:
    """One row: matched_left, matched_right, shared, only_left, only_right, union_, jaccard."""
    m = pairs.agg(F.countDistinct(left).alias("matched_left"), F.countDistinct(right).alias("matched_right"))
    m = m.withColumn("shared", F.least("matched_left", "matched_right")).withColumn("only_left", F.lit(n_left) - F.col("shared")).withColumn("only_right", F.lit(n_right) - F.col("shared"))
    m = m.withColumn("union_", F.col("shared") + F.col("only_left") + F.col("only_right"))
    return m.withColumn("jaccard", F.when(F.col("union_") > 0, rounded(F.col("shared") / F.col("union_"), 4)).otherwise(0.0))


def accepted_totals(summary: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """One row from class_code and n: accepted_overlap, other_classes, total."""
    t = summary.agg(F.sum(F.when(F.trim("class_code").isin(*accepted), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("t"))
    return t.select(F.coalesce("a", F.lit(0)).cast("long").alias("accepted_overlap"), F.greatest(F.coalesce(F.col("t") - F.col("a"), F.lit(0)), F.lit(0)).cast("long").alias("other_classes"), F.coalesce("t", F.lit(0)).cast("long").alias("total"))


def between(codes: DataFrame, queries: DataFrame, references: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """Accepted rows of codes whose query and reference are both among the ids (column protein) given."""
    trimmed = codes.select(F.trim("qry_id").alias("qry_id"), F.trim("ref_id").alias("ref_id"), F.trim("class_code").alias("class_code")).where(F.col("class_code").isin(*accepted))
    known = lambda t, c: t.select(F.col("protein").cast("string").alias(c)).distinct()
    return trimmed.join(known(queries, "qry_id"), "qry_id", "left_semi").join(known(references, "ref_id"), "ref_id", "left_semi")


def novel_candidates(prediction: DataFrame, codes: DataFrame, assembly: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """Novel predicted loci that assembled models of the same strand confirm, numbered.

    prediction, assembly: locus_summary(); codes: qry_id (assembled), ref_id (predicted), class_code. A strand that is
    missing on both sides counts as the same."""
    p = prediction.select(F.col("protein").cast("string").alias("prediction_protein"), F.col("genes").alias("prediction_gene"), "seqid", "strand", F.col("start").alias("prediction_start"), F.col("end").alias("prediction_end"))
    hits = codes.select(F.trim("qry_id").alias("qry_id"), F.trim("ref_id").alias("prediction_protein"), F.trim("class_code").alias("class_code")).where(F.col("class_code").isin(*accepted))
    hits = hits.join(p.select("prediction_protein", "strand"), "prediction_protein")
    a = assembly.select(F.col("protein").cast("string").alias("qry_id"), F.col("genes").alias("bam_gene"), F.col("strand").alias("_strand")).distinct()
    hits = hits.join(a, "qry_id", "left").where(F.coalesce("strand", F.lit("")) == F.coalesce("_strand", F.lit("")))
    per = hits.groupBy("prediction_protein").agg(set_text("qry_id").alias("bam_proteins"), set_text("bam_gene").alias("bam_genes"), set_text("class_code").alias("bam_class_codes"), F.countDistinct("qry_id").alias("bam_match_count"))
    return numbered(p.join(per, "prediction_protein"), "bam_match_count", "seqid", ["prediction_start", "prediction_protein"])


def rank_candidates(matches: DataFrame, loci: DataFrame) -> DataFrame:
    """Numbered candidates: matches (protein, other, code) per locus, most matches first, then place, then protein."""
    per = matches.groupBy("protein").agg(set_text("other").alias("others"), set_text("code").alias("codes"), F.countDistinct("other").alias("n_matches"))
    return numbered(per.join(loci, "protein"), "n_matches", "seqid", ["start", "protein"])


def numbered(rows: DataFrame, count: str, group: str, rest: list[str]) -> DataFrame:
    """Adds candidate_id by count (most first), group, rest. Numbers run within (count, group); what comes before a
    group is summed over the table of groups, so no task sees all rows."""
    groups = rows.groupBy(count, group).agg(F.count(F.lit(1)).alias("_size"))
    groups = groups.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(F.desc(count), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(count).alias("_count"), F.col(group).alias("_group"), "_before")
    nth = F.row_number().over(Window.partitionBy(count, group).orderBy(*rest))
    out = rows.withColumn("_nth", nth).join(groups, (F.col(count) == F.col("_count")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("candidate_id", F.format_string("HPNGC_%04d", F.col("_before") + F.col("_nth"))).drop("_nth", "_before", "_count", "_group")


def merged_models(rows: DataFrame, place: str = "line_no", count: int | None = None) -> DataFrame:
    """The CDS rows of feature tables as a normalised annotation: for each protein a transcript row, then its distinct CDS rows.

    Sequence, source and strand are the first row's, the gene the first one named, the score the largest. count: how many
    rows there are, about; with it they are dealt by protein once, to as many tasks as that takes."""
    cds = rows.where("type = 'cds' and trim(protein) <> ''").withColumn("protein", F.trim("protein"))
    cds = cds if count is None else dealt(cds, count, "protein")
    clean = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    named = F.nullif(F.trim("gene"), F.lit(""))
    facts = cds.groupBy("protein").agg(*[F.min_by(c, place).alias(c) for c in ("seqid", "source", "strand")], F.min_by(named, F.when(named.isNotNull(), F.col(place))).alias("gene"), F.min("start").alias("low"), F.max("end").alias("high"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    attrs = F.concat(F.lit('gene_id "'), clean(F.coalesce("gene", "protein")), F.lit('"; transcript_id "'), clean(F.col("protein")), F.lit('";'))
    facts = facts.withColumn("attrs", attrs).drop("gene")
    frame = F.when(F.trim("frame").isin("0", "1", "2"), F.trim("frame")).otherwise(".")
    whole = facts.select("seqid", "source", F.lit("transcript").alias("type"), F.col("low").alias("start"), F.col("high").alias("end"), "score", "strand", F.lit(".").alias("frame"), "attrs", "protein")
    parts = cds.select("protein", "start", "end", frame.alias("frame")).distinct().join(facts, "protein")
    return whole.unionByName(parts.select("seqid", "source", F.lit("CDS").alias("type"), "start", "end", "score", "strand", "frame", "attrs", "protein"))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")



"""The engine's operators over the driver's tables, with the same in SQL.

The tables hold no annotation, so each query reads one through a projection: a line item is a segment of the model
named by its order, or a peptide of that model; an order is a model's first segment, its transcript, its sequence and
its score; documents are sequences and benchmark items peptides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.functions import scalars
from evimap.functions.tables import dealt, new_folder, written
from evimap.operators import charts, compare, evidence, genome, index, intervals, learning, overlap, search, selection
from evimap.sources import annotations, reports


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    customers = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return _t(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf).select("o_orderkey", "o_custkey", "c_nationkey")
    return _t(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _strand(key: str):
    return F.when(F.col(key) % 2 == 0, "+").otherwise("-").alias("strand")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """protein, gene, seqid, strand, start, end."""
    start = F.col("l_linenumber").cast("long") * 1000 + F.col("l_partkey") % 200
    rows = _lines(spark, sf).select(
        F.col("l_orderkey").alias("protein"), F.col("o_custkey").alias("gene"), F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqid"),
        _strand("l_orderkey"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3 + F.col("l_suppkey") % 3).alias("end"),
    )
    # dealt by model once: distinct, windows, sums and joins by model find their rows where they are
    return dealt(rows, _t(spark, sf, "lineitem").count(), "protein").distinct()


def all_segments(spark: SparkSession, sf: str) -> DataFrame:
    """segments(), and one of each order, so that some models have no peptide."""
    first = _orders(spark, sf).select(F.col("o_orderkey").alias("protein"), F.col("o_custkey").alias("gene"), F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqid"), _strand("o_orderkey"), F.lit(10).cast("long").alias("start"), (F.col("o_custkey") % 300 + 12).alias("end"))
    return segments(spark, sf).unionByName(dealt(first, _t(spark, sf, "lineitem").count(), "protein"))


def reference_segments(seg: DataFrame) -> DataFrame:
    """segments() with some ends moved."""
    moved = lambda c, k, by: (F.col(c) + F.when(F.col(c) % k == 0, by).otherwise(0)).alias(c)
    return seg.select("protein", "seqid", "strand", moved("start", 11, 3), moved("end", 13, 6))


def peptides(spark: SparkSession, sf: str) -> DataFrame:
    """peptide, protein, gene, pep_start, pep_end, prot_len."""
    start = F.col("l_partkey") % 90 + 1
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("peptide"), F.col("l_orderkey").alias("protein"), F.col("o_custkey").alias("gene"),
        start.alias("pep_start"), F.least(start + F.col("l_quantity").cast("long") % 20, F.lit(100)).alias("pep_end"), F.lit(100).cast("long").alias("prot_len"),
    )
    return dealt(rows, _t(spark, sf, "lineitem").count(), "peptide").distinct()


def peptide_rows(seg: DataFrame, pep: DataFrame, count: int) -> DataFrame:
    """Peptides with their models' splice sites and coverage, specificity, terminal and splice flags.

    Specificity goes by peptide, the rest by protein: the rows (count, about) are dealt once for each."""
    rows = evidence.flagged(dealt(evidence.specificity(pep), count, "protein"), seg)
    return rows.withColumn("n_terminal", F.col("pep_start") == 1).withColumn("c_terminal", F.col("pep_end") == F.col("prot_len"))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.features(peptide_rows(written(segments(spark, sf)), peptides(spark, sf), _t(spark, sf, "lineitem").count()))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every model with a sequence: measures, isoforms, transcript and external score; at 0 without peptides."""
    # what several branches of the plan read is written once; peptides are dealt as specificity needs them, which a table would forget
    seg, pep, orders = written(all_segments(spark, sf)), peptides(spark, sf), _t(spark, sf, "orders")
    transcripts = orders.select(F.col("o_orderkey").alias("protein"), F.when(F.col("o_orderstatus") == "P", "gene").otherwise("mrna").alias("type"), (F.floor(F.col("o_totalprice")).cast("long") % 100 / 100.0).alias("score"))
    lengths = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("protein"), F.lit(100).cast("long").alias("protein_length"))
    external = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("protein"), (F.col("o_orderkey") * 37 % 1000 / 1000.0).alias("external_score"))
    facts = evidence.model_facts(seg, evidence.transcript_scores(transcripts))
    rows = peptide_rows(seg, pep, _t(spark, sf, "lineitem").count()).drop("splice_sites").join(facts.drop("low", "high"), "protein")
    f = evidence.with_external_scores(evidence.with_unmatched(evidence.features(rows), facts, lengths), external)
    return f.withColumn("transcript_score", scalars.rounded(F.col("transcript_score"), 6))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """score_table() with its rules and support; four peptides stand for the classifier's yes."""
    c = written(evidence.confidence(score_table(spark, sf)).withColumn("positive", F.col("mapped_peptides") >= 4))
    return evidence.support(evidence.score_filter(c, "high", "external_score"))


def protein_support(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).drop("positive", "score_supported", "cutoff")


def located(seg: DataFrame, pep: DataFrame) -> DataFrame:
    return intervals.located(intervals.project_codons(intervals.codon_coordinates(seg), pep))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("=", "j", "c", "u", "k", "o"))), F.when(F.col("o_orderkey") % 7 < 6, (F.col("o_orderkey") % 7 + 1).cast("int")))
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("qry_id"), F.col("o_orderkey").alias("ref_id"), code.alias("class_code"))


def model_pairs(seg: DataFrame) -> DataFrame:
    """qry_id, p and r: each model and the reference's."""
    of = lambda seg, to: compare.models(seg).select("protein", F.struct("seqid", "strand", "regions").alias(to))
    return of(seg, "p").join(of(reference_segments(seg), "r"), "protein").withColumnRenamed("protein", "qry_id")


def junction_support(spark: SparkSession, sf: str) -> DataFrame:
    seg = written(segments(spark, sf))
    return compare.junction_support(written(model_pairs(seg)), written(located(seg, peptides(spark, sf)).select("peptide", "seqid", "b")))


def evidence_report(spark: SparkSession, sf: str) -> DataFrame:
    seg, pep = written(segments(spark, sf)), written(peptides(spark, sf))
    found = written(located(seg, pep).select("peptide", "seqid", "b"))
    return compare.evidence_report(codes(spark, sf), evidence.features(peptide_rows(seg, pep, _t(spark, sf, "lineitem").count())), compare.models(seg), compare.models(reference_segments(seg)), found)


def structure_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = compare.classify_difference(model_pairs(segments(spark, sf))).withColumn("stop", compare.stop_difference())
    return d.select(F.col("qry_id").alias("protein"), "difference", "stop")


def _rates(df: DataFrame) -> DataFrame:
    return df.select(*[scalars.rounded(F.col(c), 6).alias(c) if t == "double" and c not in ("sequence_coverage", "isoforms", "transcript_score", "external_score") else F.col(c) for c, t in df.dtypes])


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("protein"), (F.pmod(F.floor(F.col("c_acctbal")).cast("long"), F.lit(1000)) / 1000.0).alias("score"), (F.col("c_mktsegment") == "BUILDING").alias("high"))


def _loci(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("event_type", F.when(F.col("user_id") % 2 == 0, "prediction").otherwise("assembly").alias("branch"), start.alias("start"), (start + F.floor("value").cast("long")).alias("end"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    """Part and supplier of every line item as matched models, the ship flag as a code."""
    code = F.when(F.col("l_returnflag") == "N", "=").when(F.col("l_returnflag") == "A", "j").otherwise("u")
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("qry_id"), F.col("l_partkey").cast("string").alias("ref_id"), code.alias("class_code"))


def _part_loci(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("protein"), F.col("p_type").alias("genes"), F.col("p_brand").alias("seqid"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_size").alias("start"), (F.col("p_size") + 5).alias("end"))


def novel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("protein"), F.col("s_nationkey").cast("string").alias("genes"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    found = compare.novel_candidates(_part_loci(spark, sf), _matches(spark, sf), suppliers)
    return found.select("candidate_id", "seqid", "strand", "prediction_protein", "prediction_gene", "prediction_start", "prediction_end", "bam_proteins", "bam_genes", "bam_class_codes", "bam_match_count")


def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    matches = _matches(spark, sf).select(F.col("ref_id").cast("long").alias("protein"), F.col("qry_id").alias("other"), F.col("class_code").alias("code"))
    return compare.rank_candidates(matches, _part_loci(spark, sf)).select("candidate_id", "protein", "seqid", "others", "codes", "n_matches")


def overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    parts, suppliers = _t(spark, sf, "part").select(F.col("p_partkey").alias("protein")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("protein"))
    return compare.overlap_statistics(compare.between(_matches(spark, sf), suppliers, parts), "ref_id", "qry_id", parts.count(), suppliers.count())


def _annotation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as lines of an annotation, their attributes in several styles; place by line item."""
    key = F.col("l_orderkey").cast("string")
    style = F.col("l_suppkey") % 6
    attrs = F.when(style == 0, F.concat(F.lit("ID=c"), key, F.lit("; Parent=m"), key)).when(style == 1, F.concat(F.lit('gene_id "g"; transcript_id "m'), key, F.lit('";'))).when(style == 2, F.lit('transcript_id ""; note "x"')).when(style == 3, F.lit("ID= ;Name=n")).when(style == 4, F.concat(F.lit("GeneID=h;transcript_id=m"), key)).otherwise(F.lit("note=1"))
    kind = F.when(F.col("l_linenumber") == 1, "gene").when(F.col("l_linenumber") % 2 == 0, "CDS").otherwise("exon")
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("?")
    start = F.col("l_linenumber").cast("long") * 1000 + F.col("l_partkey") % 200
    cells = [F.lit("chr1"), F.lit("x"), kind, start.cast("string"), (start + F.col("l_quantity").cast("long")).cast("string"), F.lit("."), strand, F.lit("."), attrs]
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return _t(spark, sf, "lineitem").select(F.concat_ws("\t", *cells).alias("value"), place.alias("place"))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    found = annotations.transcript_models(_annotation_lines(spark, sf))
    return found.select("transcript", "strand", "gene", F.col("start").alias("low"), F.col("end").alias("high"), F.array_join(F.transform("exons", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("exons"))


def cds_models(spark: SparkSession, sf: str) -> DataFrame:
    m = compare.models(annotations.cds_segments(_annotation_lines(spark, sf)), place="place")
    return m.select("protein", "gene", "strand", F.array_join(F.transform("regions", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("regions"))


def orf_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's segments as exons, two parts of each transcript as an ORF."""
    rows = segments(spark, sf).groupBy(F.col("protein").alias("transcript")).agg(F.max("seqid").alias("seqid"), F.max("strand").alias("strand"), F.lit(".").alias("score"), F.max("gene").alias("gene"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
    orfs = _t(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("orf"), F.col("o_orderkey").alias("transcript"), F.expr("array(struct(5L as start, 20L as end, '0' as frame), struct(31L as start, 90L as end, '1' as frame))").alias("parts"))
    return intervals.project_orfs(orfs, rows).select("protein", "gene", "seqid", "type", F.col("start").alias("s"), F.col("end").alias("e"), "strand", "frame")


def merged_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf).select("seqid", F.lit("x").alias("source"), F.lit("cds").alias("type"), "start", "end", (F.col("start") % 10 / 10.0).alias("score"), "strand", (F.col("end") % 4).cast("string").alias("frame"), F.col("gene").cast("string").alias("gene"), F.col("protein").cast("string").alias("protein"), F.struct("start", "end").alias("line_no"))
    return compare.merged_models(rows, count=_t(spark, sf, "lineitem").count()).select("seqid", "source", "type", F.col("start").alias("s"), F.col("end").alias("e"), scalars.general_number(F.col("score")).alias("score"), "strand", "frame", "attrs")


def translated_models(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's chromosome is the digests of its orders' keys as bases, one line an order; a line item is a segment of its order's model."""
    orders = _orders(spark, sf)
    bases = F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    line = lambda value, order: orders.select(F.struct(F.col("c_nationkey").alias("n"), (F.col("o_orderkey") * order / 1000).cast("long").alias("k")).alias("block"), (F.col("o_orderkey") * order).alias("place"), value.alias("value"))
    headers = line(F.concat(F.lit(">chr"), F.col("c_nationkey").cast("string"), F.lit(" x")), -1).groupBy("block.n", "value").agg(F.lit(-1).cast("long").alias("place"))
    headers = headers.select(F.struct("n", F.lit(-1).cast("long").alias("k")).alias("block"), "place", "value")
    tiled = genome.tiles(genome.placed(headers.unionByName(line(bases, 1))))
    return genome.translated(segments(spark, sf), tiled)


def _exon_models(spark: SparkSession, sf: str) -> DataFrame:
    """id, seqid, strand, exons (sorted): segments() by their models. Line items are dealt once, as the two places they come to."""
    lines = _t(spark, sf, "lineitem")
    start = F.col("l_linenumber").cast("long") * 1000 + F.col("l_partkey") % 200
    rows = lines.select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3 + F.col("l_suppkey") % 3).alias("end"))
    n = lines.count()
    exons = dealt(rows, n, "id").groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("exons"))
    # an order is in the table once; if it weren't, segments would differ by their genes
    orders = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), "o_custkey", F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqid"), _strand("o_orderkey"))
    orders = dealt(orders, n, "id").groupBy("id", "seqid", "strand").agg(F.size(F.collect_set("o_custkey")).alias("genes"))
    return exons.join(orders, "id").select("id", "seqid", "strand", F.expr("sort_array(flatten(array_repeat(exons, genes)))").alias("exons"))


def class_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Models of one to seven exons against every third of them, one exon fewer in some, with some ends moved; spread over a
    chromosome so that a few dozen stand at a place."""
    models = written(overlap.numbered(_exon_models(spark, sf)))
    moved = "transform(exons, x -> struct(x.start + {0} AS start, x.end + {1} AS end))".format
    reference = models.where("id % 3 = 0").withColumn("exons", F.expr(moved("IF(x.start % 11 = 0, 3, 0)", "IF(x.end % 13 = 0, 6, 0)")))
    reference = reference.withColumn("exons", F.expr("sort_array(filter(exons, x -> NOT (id % 5 = 0 AND x.start % 2 = 0)))"))
    placed = F.expr(moved(*["id % 61 * 5000"] * 2))
    return overlap.coded(models.withColumn("exons", placed), reference.withColumn("exons", placed)).withColumn("ref_id", F.col("ref_id").cast("string"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as sequences of residues."""
    return _t(spark, sf, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of benchmark items of six to forty characters: peptides of every length class."""
    return _t(spark, sf, "benchmark").select(F.col("item_id"), F.expr("substring(text, 1 + int(item_id % 7), 6 + int(item_id * 5 % 35))").alias("p"))


def search_context(spark: SparkSession, sf: str) -> DataFrame:
    docs, pieces = _t(spark, sf, "documents"), _pieces(spark, sf)
    found = search.occurrences(docs, pieces, "doc_id", "text", "item_id", "p")
    return search.with_context(found, docs, pieces, "doc_id", "text", "item_id", "p").select("doc_id", "item_id", "position", "before", "after", "ntt")


def peptide_lookup(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    asked = words.select(F.col("s").alias("peptide")).unionByName(words.select(F.substring("s", 3, 5).alias("peptide")))
    return search.lookup(asked, _proteins(words))


def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """peptide_lookup by an index that is written first."""
    words, path = _words(spark, sf), new_folder(spark, "index")
    index.write_index(_proteins(words), path)
    asked = words.select(F.col("s").alias("peptide")).unionByName(words.select(F.substring("s", 3, 5).alias("peptide")))
    return index.index_lookup(spark, asked, path)


def _proteins(words: DataFrame) -> DataFrame:
    return words.select(F.col("p_partkey").alias("id"), F.concat(F.lit("M"), "s", "s").alias("sequence"))


def fuzzy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first eleven letters of each part's name, some of them with two letters exchanged, with two free sites in all doubled names."""
    words = _words(spark, sf)
    exchanged = F.when(F.col("p_partkey") % 3 == 0, F.expr("concat(substring(s, 2, 4), 'W', substring(s, 7, 2), 'I', substring(s, 10, 3))")).otherwise(F.substring("s", 2, 11))
    found = search.fuzzy_lookup(words.select(exchanged.alias("peptide")), _proteins(words), 2)
    return found.withColumn("substitutions", F.coalesce("substitutions", F.lit(-1)))


def wildcard_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve letters of each part's name with six X among them, in all doubled names."""
    words = _words(spark, sf)
    return search.lookup(words.select(F.expr("concat(substring(s, 2, 3), 'XXX', substring(s, 8, 2), 'X', substring(s, 11, 1), 'XX')").alias("peptide")), _proteins(words), wildcards=True)


def variant_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Ten letters of each part's name, with letters exchanged in some, in doubled names that have two variant sites each."""
    words = _words(spark, sf)
    exchanged = F.expr("case p_partkey % 4 when 0 then substring(s, 2, 10) when 1 then concat(substring(s, 2, 3), 'W', substring(s, 6, 6)) when 2 then concat(substring(s, 2, 5), 'K', substring(s, 8, 4)) else concat(substring(s, 2, 3), 'W', substring(s, 6, 1), 'K', substring(s, 8, 4)) end")
    variants = F.expr("array(struct(6 as at, 'W' as residue), struct(8 as at, 'K' as residue))")
    return search.variant_lookup(words.select(exchanged.alias("peptide")), _proteins(words).withColumn("variants", variants))


def peptide_location(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last four letters of each part's name in its doubled name, after an M for even parts."""
    w = _words(spark, sf).select(F.col("p_partkey").alias("protein"), "s")
    pieces = w.select("protein", F.explode(F.array(F.left("s", F.lit(4)), F.right("s", F.lit(4)))).alias("peptide"))
    return evidence.locate(pieces, w.select("protein", F.concat(F.when(F.col("protein") % 2 == 0, "M").otherwise(""), "s", F.lit("*"), "s").alias("sequence")))


def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the same length as alternatives of each other's name."""
    w = _words(spark, sf).groupBy("s").agg(F.min("p_partkey").alias("k"))
    pairs = search.within_substitutions(w, w.select(F.col("k").alias("k2"), F.col("s").alias("s2")), 3, "k", "s", "k2", "s2").join(w, "k").join(w.select(F.col("k").alias("k2"), F.col("s").alias("s2")), "k2")
    hits = pairs.select(F.col("s").alias("peptide"), F.col("s2").alias("original"), F.concat(F.when(F.col("k2") % 3 == 0, "DECOY_").otherwise(""), F.col("s2")).alias("protein"), (F.col("k2") % 3).alias("ntt"), search.substitutions(F.col("s"), F.col("s2")).alias("places"))
    return search.alternatives(hits, sink="DECOY_", most=3).select("peptide", "protein", "ntt", "places", "substitutions", "nth")


def fuzzy_substitutions(spark: SparkSession, sf: str) -> DataFrame:
    """Part names, equal ones once, that differ in up to four places; each pair once."""
    names = _t(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return search.within_substitutions(names, names.select(F.col("k").alias("k2"), F.col("p_name").alias("name")), 4, "k", "p_name", "k2", "name").where("k < k2")


def fuzzy_patterns(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf).select("s").distinct().select(F.col("s").alias("peptide"))
    return search.fuzzy(words, 2).groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), F.min("pattern").alias("lowest"), F.max("pattern").alias("highest"))


def mass_window(spark: SparkSession, sf: str) -> DataFrame:
    w = _words(spark, sf).select("s").distinct()
    mass = scalars.peptide_mass(F.col("s"))
    # one of the masses is the word's own, one has an oxidation more, one has what no modification gives; both_as
    # has an oxidation and a deamidation more, whose order is that of their sites
    return w.select("s", scalars.rounded(mass, 4).alias("mass"), scalars.searchable(F.col("s")).alias("searchable"), *[search.within_mass(F.col("s"), mass + x, 0.01).alias(n) for n, x in (("own", 0.004), ("oxidised", 15.9949), ("lighter", -1.0), ("odd", 3.3333))],
        *[search.modified(F.col("s"), mass + x, 0.01).alias(n) for n, x in (("own_as", 0.004), ("oxidised_as", 15.9949), ("both_as", 16.9789))])


def classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    m = learning.metrics(rows.select(F.col("quality").cast("double").alias("label"), (F.col("n_chars") > 1000).alias("positive")))
    return m.select(*[scalars.rounded(F.col(c), 6).alias(c) for c in m.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "protein_support": protein_support,
    "isoforms_per_gene": lambda s, d: segments(s, d).groupBy("gene").agg(F.countDistinct("protein").alias("isoforms")),
    "protein_extent": lambda s, d: segments(s, d).groupBy("protein").agg(F.min("start").alias("low"), F.max("end").alias("high")),
    "model_facts": lambda s, d: evidence.model_facts(all_segments(s, d)).drop("transcript_score"),
    "codon_coordinates": lambda s, d: intervals.codon_coordinates(segments(s, d)).select("protein", F.col("start").alias("s"), F.col("end").alias("e"), "cds_start", "cds_end", "splice_sites"),
    "specificity_flags": lambda s, d: evidence.specificity(peptides(s, d).select("peptide", "protein", "gene")),
    "interval_coverage": lambda s, d: intervals.union_coverage(peptides(s, d)),
    "contained_semi": lambda s, d: intervals.contained(peptides(s, d), intervals.codon_coordinates(segments(s, d))).select("peptide", "protein", "pep_start", "pep_end"),
    "project_to_genome": lambda s, d: intervals.project_codons(intervals.codon_coordinates(segments(s, d)), peptides(s, d).drop("gene")).select("protein", "peptide", "pep_start", "pep_end", "genome_start", "genome_end"),
    "transcript_projection": lambda s, d: intervals.project_transcript(segments(s, d), peptides(s, d).select("protein", "peptide", F.col("pep_start").alias("f_start"), (F.col("pep_end") + 60).alias("f_end")), "protein").select("protein", "peptide", "f_start", "genome_start", "genome_end"),
    "orf_projection": orf_projection,
    "protein_features": feature_table,
    "score_table": score_table,
    "score_filter": lambda s, d: evidence.score_filter(written(evidence.confidence(score_table(s, d))), "high", "external_score").select("protein", "external_score", scalars.rounded(F.col("cutoff"), 6).alias("cutoff"), "score_supported"),
    "evidence_partitions": lambda s, d: evidence.partitions(score_table(s, d)),
    "engineered_features": lambda s, d: _rates(evidence.engineered(feature_table(s, d))),
    "high_low_confidence": lambda s, d: evidence.confidence(score_table(s, d)).select("protein", "high", "low"),
    "roc_points": lambda s, d: evidence.roc(_scores(s, d)).select("i", scalars.rounded(F.col("tpr"), 6).alias("tpr"), scalars.rounded(F.col("fpr"), 6).alias("fpr")),
    "roc_cutoff": lambda s, d: evidence.cutoff(evidence.roc(_scores(s, d))).select(scalars.rounded(F.col("cutoff"), 6).alias("cutoff"), scalars.rounded(F.col("youden"), 6).alias("youden")),
    "substring_search": lambda s, d: search.occurrences(_t(s, d, "documents"), _t(s, d, "benchmark"), "doc_id", "text", "item_id", "text"),
    "search_context": search_context,
    "peptide_lookup": peptide_lookup,
    "lookup_report": lambda s, d: reports.lookup_report(peptide_lookup(s, d)),
    "peptide_location": peptide_location,
    "alternatives": alternatives,
    "translated_models": translated_models,
    "class_codes": class_codes,
    "fuzzy_patterns": fuzzy_patterns,
    "fuzzy_lookup": fuzzy_lookup,
    "wildcard_lookup": wildcard_lookup,
    "variant_lookup": variant_lookup,
    "index_lookup": index_lookup,
    "wildcards": lambda s, d: search.expanded(_words(s, d).select(F.concat("s", F.lit("X")).alias("peptide")).distinct()),
    "mass_window": mass_window,
    "fuzzy_substitutions": fuzzy_substitutions,
    "sequence_collapse": lambda s, d: search.collapse(_t(s, d, "part"), "p_partkey", "p_name"),
    "attribute_extract": lambda s, d: _t(s, d, "pages").select("page_id", scalars.extracted(F.col("url"), "[?&]page=([^&#]+)").alias("page"), scalars.extracted(F.col("url"), "utm_source=([^&#]+)").alias("source")),
    "reference_cleaning": lambda s, d: annotations.cleaned(_annotation_lines(s, d)).groupBy("value", "keep").agg(F.count(F.lit(1)).alias("n")),
    "removed_rows": lambda s, d: annotations.removed_rows(annotations.cleaned(_annotation_lines(s, d))),
    "feature_rows": lambda s, d: annotations.feature_rows(_annotation_lines(s, d)).select("type", F.col("start").alias("s"), F.col("end").alias("e"), "score", "strand", "gene", "protein"),
    "resolved_lines": lambda s, d: selection.resolved(_annotation_lines(s, d)).groupBy("value", "protein").agg(F.count(F.lit(1)).alias("n")),
    "transcript_models": transcripts,
    "cds_models": cds_models,
    "splice_junctions": lambda s, d: intervals.junctions(segments(s, d)),
    "structure_diff": structure_diff,
    "junction_support": junction_support,
    "evidence_report": evidence_report,
    "category_summary": lambda s, d: compare.category_summary(structure_diff(s, d), "difference", "protein"),
    "difference_counts": lambda s, d: charts.difference_counts(codes(s, d).where("class_code = 'u'").select(F.col("qry_id").alias("protein")), evidence_report(s, d).groupBy(F.col("peptide_evidence_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))),
    "locus_summary": lambda s, d: compare.locus_summary(segments(s, d)).select("protein", "genes", "seqid", "strand", F.col("start").alias("low"), F.col("end").alias("high")),
    "locus_clusters": lambda s, d: intervals.clusters(_loci(s, d), ["event_type"]).select("event_type", F.col("start").alias("low"), F.col("end").alias("high"), "n", "label"),
    "class_code_summary": lambda s, d: compare.class_code_summary(_t(s, d, "part").withColumn("code", F.lower(F.substring("p_type", 1, 1))), "code"),
    "accepted_totals": lambda s, d: compare.accepted_totals(compare.class_code_summary(codes(s, d), "class_code")),
    "overlap_stats": overlap_stats,
    "novel_candidates": novel_candidates,
    "candidate_ranking": candidate_ranking,
    "merged_dedupe": lambda s, d: compare.first_per_key(segments(s, d), "protein", "start", "end").select("protein", "gene", "seqid", F.col("start").alias("s"), F.col("end").alias("e")),
    "merged_models": merged_models,
    "evidence_bars": lambda s, d: charts.evidence_bars(labelled(s, d)),
    "legacy_bars": lambda s, d: charts.legacy_bars(evidence.partitions(score_table(s, d))),
    "coverage_histogram": lambda s, d: charts.coverage_histogram(written(labelled(s, d))),
    "score_histogram": lambda s, d: charts.score_histogram(written(labelled(s, d))),
    "peptide_types": lambda s, d: charts.type_counts(located(segments(s, d), peptides(s, d))),
    "bed12_rows": lambda s, d: intervals.bed12(intervals.project_codons(intervals.codon_coordinates(segments(s, d)), peptides(s, d))),
    "subset_by_ids": lambda s, d: selection.by_ids(segments(s, d), _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"))).select("protein", "gene", "seqid", F.col("start").alias("s"), F.col("end").alias("e")),
    "merged_sequences": lambda s, d: selection.merge_sequences(_t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence")), _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("sequence"))),
    "classifier_metrics": classifier_metrics,
}

_M = """m AS (SELECT DISTINCT l_orderkey AS protein, o_custkey AS gene, 'chr' || c_nationkey AS seqid, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    l_linenumber * 1000 + l_partkey % 200 AS s, l_linenumber * 1000 + l_partkey % 200 + l_quantity::BIGINT * 3 + l_suppkey % 3 AS e
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_ALL = f"""{_M.replace('m AS', 'm0 AS', 1)}, m AS (SELECT * FROM m0 UNION ALL SELECT o_orderkey, o_custkey, 'chr' || c_nationkey, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END, 10, o_custkey % 300 + 12
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
_P = """p AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS peptide, l_orderkey AS protein, o_custkey AS gene, l_partkey % 90 + 1 AS ps,
    least(l_partkey % 90 + 1 + l_quantity::BIGINT % 20, 100) AS pe, 100::BIGINT AS plen FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_C = """c0 AS (SELECT *, (e - s + 1) // 3 AS cds_len FROM m),
    c AS (SELECT *, ce - cds_len + 1 AS cs FROM (SELECT *, sum(cds_len) OVER (PARTITION BY protein ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS ce, count(*) OVER (PARTITION BY protein) - 1 AS splice_sites FROM c0))"""
_G = """x0 AS (SELECT c.*, p.peptide, p.ps, p.pe, p.plen, max(ce) OVER (PARTITION BY c.protein) AS last FROM c JOIN p ON c.protein = p.protein),
    x1 AS (SELECT *, CASE WHEN ce = last THEN greatest(pe - last, 0) ELSE 0 END AS more FROM x0),
    x2 AS (SELECT protein, peptide, seqid, strand, ps, pe, plen, cs, CASE WHEN strand = '+' THEN s ELSE s - 3 * more END AS s, CASE WHEN strand = '+' THEN e + 3 * more ELSE e END AS e, ce + more AS ce FROM x1),
    x3 AS (SELECT *, greatest(ps, cs) AS os, least(pe, ce) AS oe FROM x2 WHERE pe >= cs AND ps <= ce),
    g AS (SELECT *, CASE WHEN strand = '+' THEN s + (os - cs) * 3 ELSE e - ((oe - cs + 1) * 3 - 1) END AS gs, CASE WHEN strand = '+' THEN s + (oe - cs + 1) * 3 - 1 ELSE e - (os - cs) * 3 END AS ge FROM x3)"""
_B = f"""{_M}, {_P}, {_C}, {_G}, b AS (SELECT protein, peptide, seqid, strand, ps, pe, plen, list(gs ORDER BY gs, ge) AS ss, list(ge ORDER BY gs, ge) AS es FROM g GROUP BY ALL),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seqid, strand, peptide, ss, es ORDER BY protein) AS n FROM b) WHERE n = 1)"""
_SPEC = """sp AS (SELECT peptide, protein, gene, CASE WHEN np = 1 THEN '+' ELSE '-' END AS protein_specific, CASE WHEN ng = 1 THEN '+' ELSE '-' END AS gene_specific
    FROM (SELECT DISTINCT peptide, protein, gene FROM p) JOIN (SELECT peptide, count(DISTINCT protein) AS np, count(DISTINCT gene) AS ng FROM p GROUP BY peptide) USING (peptide))"""
_COV = """i0 AS (SELECT DISTINCT protein, ps, pe FROM p),
    i1 AS (SELECT *, max(pe) OVER (PARTITION BY protein ORDER BY ps, pe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i0),
    i2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR ps > reach THEN 1 ELSE 0 END) OVER (PARTITION BY protein ORDER BY ps, pe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM i1),
    cov AS (SELECT protein, round_even(sum(n) / 100.0::DOUBLE * 10000, 0) / 10000 AS coverage FROM (SELECT protein, isle, max(pe) - min(ps) + 1 AS n FROM i2 GROUP BY ALL) GROUP BY protein)"""
_FACTS = """facts AS (SELECT DISTINCT m.protein, isoforms, splice_sites, low, high, transcript_score FROM m JOIN (SELECT gene, count(DISTINCT protein) AS isoforms FROM m GROUP BY gene) USING (gene)
    JOIN (SELECT protein, count(*) - 1 AS splice_sites, min(s) AS low, max(e) AS high FROM (SELECT DISTINCT seqid, protein, s, e FROM m) GROUP BY protein) USING (protein)
    LEFT JOIN (SELECT o_orderkey AS protein, (floor(o_totalprice)::BIGINT % 100) / 100.0::DOUBLE AS transcript_score FROM orders WHERE o_orderstatus <> 'P') USING (protein))"""
_ROWS = """r AS (SELECT p.*, {splice_sites}, coverage, protein_specific, gene_specific, ps = 1 AS n_terminal, pe = plen AS c_terminal,
        NOT EXISTS (SELECT 1 FROM c WHERE c.protein = p.protein AND cs <= ps AND ce >= pe) AS spliced
        FROM p JOIN {source} USING (protein) JOIN cov USING (protein) JOIN sp ON sp.peptide = p.peptide AND sp.protein = p.protein AND sp.gene = p.gene),
    f AS (SELECT protein, max(plen) AS protein_length, {facts}, round_even(avg(coverage) * 100, 0) / 100 AS sequence_coverage, count(DISTINCT peptide) AS mapped_peptides,
        count(*) FILTER (n_terminal) AS n_terminal_peptides, count(*) FILTER (c_terminal) AS c_terminal_peptides, count(*) FILTER (protein_specific = '+') AS protein_specific_peptides,
        count(*) FILTER (gene_specific = '+') AS gene_specific_peptides, count(*) FILTER (spliced) AS splice_peptides, count(*) FILTER (NOT spliced) AS internal_peptides FROM r GROUP BY protein)"""
_F = f"{_M}, {_P}, {_C}, {_SPEC}, {_COV}, " + _ROWS.format(splice_sites="splice_sites", source="(SELECT protein, count(*) - 1 AS splice_sites FROM m GROUP BY protein)", facts="max(splice_sites) AS splice_sites")
_ST = f"{_ALL}, {_P}, {_C}, {_SPEC}, {_COV}, {_FACTS}, " + _ROWS.format(splice_sites="isoforms, splice_sites, transcript_score", source="facts", facts="max(splice_sites) AS splice_sites, avg(isoforms) AS isoforms, avg(transcript_score) AS transcript_score") + """,
    every AS (SELECT * FROM f UNION ALL BY NAME SELECT protein, 100::BIGINT AS protein_length, splice_sites, isoforms::DOUBLE AS isoforms, transcript_score, 0.0::DOUBLE AS sequence_coverage, 0::BIGINT AS mapped_peptides, 0::BIGINT AS n_terminal_peptides,
        0::BIGINT AS c_terminal_peptides, 0::BIGINT AS protein_specific_peptides, 0::BIGINT AS gene_specific_peptides, 0::BIGINT AS splice_peptides, 0::BIGINT AS internal_peptides
        FROM facts WHERE protein NOT IN (SELECT protein FROM f) AND protein % 11 <> 0),
    st AS (SELECT every.* REPLACE (round_even(coalesce(transcript_score, 0) * 1000000, 0) / 1000000 AS transcript_score), coalesce((protein * 37 % 1000) / 1000.0::DOUBLE * (CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END), 0) AS external_score
        FROM every JOIN orders ON protein = o_orderkey)"""
_HIGH = "protein_specific_peptides >= 2 OR sequence_coverage >= 0.8 OR (n_terminal_peptides >= 1 AND c_terminal_peptides >= 1 AND gene_specific_peptides > 0) OR (splice_peptides = splice_sites AND splice_peptides > 0 AND gene_specific_peptides > 0)"
_LOW = "mapped_peptides < 2 AND gene_specific_peptides = 0 AND (protein_length < 200 OR protein_length > 500)"
#: From a table sc of score and high: points of the curve, and the cutoff.
_ROC = """no AS (SELECT score FROM sc WHERE score NOT IN (SELECT score FROM sc WHERE high)), grid AS (SELECT i::INT AS i, 1.0::DOUBLE - i / 999.0::DOUBLE AS cut FROM range(1000) AS t(i)),
    rp AS (SELECT i, cut, (SELECT count(*) FROM sc WHERE high AND score >= cut)::DOUBLE / greatest((SELECT count(*) FROM sc WHERE high), 1) AS tpr,
        (SELECT count(*) FROM no WHERE score >= cut)::DOUBLE / greatest((SELECT count(*) FROM no), 1) AS fpr FROM grid),
    rs AS (SELECT *, row_number() OVER (ORDER BY fpr, i) - 1 AS nth, tpr + (1 - fpr) - 1 AS j, fpr - lag(fpr) OVER (ORDER BY fpr, i) AS df, tpr - lag(tpr) OVER (ORDER BY fpr, i) AS dt FROM rp),
    cu AS (SELECT CASE WHEN (SELECT count(*) FROM sc WHERE high) = 0 OR (SELECT max(abs(score)) FROM sc) = 0 THEN 0 WHEN max(j) > 0.2 THEN (SELECT cut FROM rs ORDER BY j DESC, nth LIMIT 1)
        ELSE coalesce((SELECT cut FROM rs WHERE nth >= 2 AND df <> 0 AND dt / df < 1 ORDER BY nth LIMIT 1), 0) END AS cutoff, max(j) AS youden FROM rs)"""
_S = f"""{_ST}, hl AS (SELECT *, {_HIGH} AS high, {_LOW} AS low FROM st), sc AS (SELECT external_score AS score, high FROM hl), {_ROC},
    ss AS (SELECT hl.*, greatest(cutoff, 0.5) AS cutoff, external_score > greatest(cutoff, 0.5) AS score_supported FROM hl, cu),
    s AS (SELECT *, CASE WHEN high OR (NOT low AND mapped_peptides >= 4) OR score_supported THEN '+' ELSE '-' END AS supported FROM ss),
    t AS (SELECT * EXCLUDE (cutoff, score_supported), CASE WHEN high THEN 'high' WHEN supported = '+' THEN 'moderate' ELSE 'no-support' END AS confidence FROM s)"""
_SC = "sc AS (SELECT (((floor(c_acctbal)::BIGINT % 1000) + 1000) % 1000) / 1000.0::DOUBLE AS score, c_mktsegment = 'BUILDING' AS high FROM customer)"


def _rate(a: str, b: str, name: str) -> str:
    return f"round_even(({a})::DOUBLE / greatest({b}, 1) * 1000000, 0) / 1000000 AS {name}"


def _model(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN strand = '+' THEN ss[1] ELSE es[-1] END AS f, CASE WHEN strand = '+' THEN es[-1] ELSE ss[1] END AS l, list_sort(list_distinct([es[i] || '-' || ss[i + 1] FOR i IN range(1, len(ss))])) AS chain
        FROM (SELECT protein, max(seqid) AS seqid, max(strand) AS strand, list(s ORDER BY s, e) AS ss, list(e ORDER BY s, e) AS es FROM (SELECT DISTINCT protein, seqid, strand, s, e FROM {source}) GROUP BY protein))"""


_D = f"""rm AS (SELECT protein, seqid, strand, s + CASE WHEN s % 11 = 0 THEN 3 ELSE 0 END AS s, e + CASE WHEN e % 13 = 0 THEN 6 ELSE 0 END AS e FROM m), {_model('pm', 'm')}, {_model('rr', 'rm')},
    w AS (SELECT p.protein, CASE WHEN p.chain <> r.chain THEN 'different_splice' WHEN p.f = r.f AND p.l = r.l AND len(p.ss) = len(r.ss) THEN 'same_start_same_stop' WHEN p.f = r.f AND p.l = r.l THEN 'same_start_same_stop_different_exons'
        WHEN p.f = r.f AND abs(p.l - r.l) > 3 THEN 'same_start_different_stop' WHEN p.f = r.f THEN 'same_start_same_stop' WHEN p.l = r.l THEN 'different_start_same_stop'
        WHEN (p.strand = '+' AND p.f < r.f) OR (p.strand <> '+' AND p.f > r.f) THEN 'upstream_extension' ELSE 'downstream_truncation' END AS difference, p.f = r.f AND abs(p.l - r.l) > 3 AS stop
        FROM pm AS p JOIN rr AS r ON r.protein = p.protein)"""
_J = """pl AS (SELECT peptide AS name, seqid, unnest([es[i] || '-' || ss[i + 1] FOR i IN range(1, len(ss))]) AS j, peptide || seqid || ss::VARCHAR || es::VARCHAR AS place FROM o WHERE len(ss) > 1),
    sp2 AS (SELECT name, seqid, place, j, split_part(j, '-', 1) AS d, split_part(j, '-', 2) AS a FROM pl),
    own AS (SELECT p.protein, p.seqid, unnest(list_filter(p.chain, lambda x: NOT list_contains(r.chain, x))) AS j FROM pm AS p JOIN rr AS r USING (protein) WHERE len(p.ss) > 1),
    oth AS (SELECT p.protein, p.seqid, unnest(list_filter(r.chain, lambda x: NOT list_contains(p.chain, x))) AS j FROM pm AS p JOIN rr AS r USING (protein) WHERE len(p.ss) > 1),
    hit AS (SELECT protein, name, place, d, a FROM sp2 JOIN own USING (seqid, j)), bad AS (SELECT protein, place, d, a FROM sp2 JOIN oth USING (seqid, j)),
    js AS (SELECT protein, count(DISTINCT name) AS splice_support FROM hit WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.protein = hit.protein AND bad.place = hit.place AND (bad.d = hit.d OR bad.a = hit.a)) GROUP BY protein)"""
_CODES = "cd AS (SELECT o_orderkey AS protein, (['=', 'j', 'c', 'u', 'k', 'o'])[CASE WHEN o_orderkey % 7 < 6 THEN o_orderkey % 7 + 1 END] AS class_code FROM orders)"
_E = f"""{_B}, {_SPEC}, {_COV}, {_ROWS.format(splice_sites='splice_sites', source='(SELECT protein, count(*) - 1 AS splice_sites FROM m GROUP BY protein)', facts='max(splice_sites) AS splice_sites')}, {_D}, {_J}, {_CODES},
    e0 AS (SELECT cd.protein, coalesce(difference, 'missing_coordinates') AS difference, coalesce(stop, false) AS stop, splice_support, {', '.join(f'coalesce({c}, 0) AS {c}' for c in compare.REPORTED)}
        FROM cd LEFT JOIN w USING (protein) LEFT JOIN f USING (protein) LEFT JOIN js USING (protein) WHERE class_code IS NULL OR class_code NOT IN ('=', 's', 'x', 'i', 'y', 'p', 'u')),
    ev AS (SELECT *, CASE WHEN stop AND c_terminal_peptides > 0 THEN 'peptide_support_different_stop' WHEN difference IN ('different_splice', 'same_start_same_stop_different_exons') THEN CASE WHEN splice_support > 0 THEN 'peptide_support_different_splice' END
        WHEN difference IN ('different_start_same_stop', 'upstream_extension', 'downstream_truncation') AND n_terminal_peptides > 0 THEN 'peptide_support_different_start' END AS category FROM e0)"""
_L = """li AS (SELECT *, 'm' || l_orderkey AS model, l_suppkey % 6 AS style, CASE WHEN l_linenumber = 1 THEN 'gene' WHEN l_linenumber % 2 = 0 THEN 'CDS' ELSE 'exon' END AS kind,
    CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '?' END AS strand, l_linenumber * 1000 + l_partkey % 200 AS s, l_linenumber * 1000 + l_partkey % 200 + l_quantity::BIGINT AS e FROM lineitem)"""
_PLACE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag"
_ATTRS = """CASE style WHEN 0 THEN 'ID=c' || l_orderkey || '; Parent=' || model WHEN 1 THEN 'gene_id "g"; transcript_id "' || model || '";' WHEN 2 THEN 'transcript_id ""; note "x"' WHEN 3 THEN 'ID= ;Name=n'
    WHEN 4 THEN 'GeneID=h;transcript_id=' || model ELSE 'note=1' END"""
_VALUE = f"concat_ws(chr(9), 'chr1', 'x', kind, s, e, '.', strand, '.', {_ATTRS})"
_KEEP = "kind <> 'gene' AND strand <> '?' AND style IN (0, 1, 4)"
_INSIDE = "({0}.s >= {1}.s AND {0}.e <= {1}.e)".format
_SAME_RUN = "(len({0}it) > 0 AND contains(array_to_string([x::VARCHAR FOR x IN {1}it], ''), array_to_string([x::VARCHAR FOR x IN {0}it], '')) AND len(flatten([[1 FOR x IN {1}it IF e.s <= x.e AND e.e >= x.s] FOR e IN {0}ex])) = 0)".format
_KEPT = "(len([1 FOR e IN qex IF e.s < x.s AND e.e > x.e]) > 0)"
_CLASSES = f"""ra AS (SELECT protein, seqid, strand, s + CASE WHEN s % 11 = 0 THEN 3 ELSE 0 END AS s, e + CASE WHEN e % 13 = 0 THEN 6 ELSE 0 END AS e FROM m),
    em AS (SELECT 'q' AS side, protein AS id, seqid, strand, list({{'s': s + protein % 61 * 5000, 'e': e + protein % 61 * 5000}} ORDER BY s, e) AS ex FROM m GROUP BY ALL
           UNION ALL SELECT 'r', protein, seqid, strand, list({{'s': s + protein % 61 * 5000, 'e': e + protein % 61 * 5000}} ORDER BY s, e) FROM ra WHERE protein % 3 = 0 AND NOT (protein % 5 = 0 AND s % 2 = 0) GROUP BY ALL),
    ei AS (SELECT *, [{{'s': ex[i].e + 1, 'e': ex[i + 1].s - 1}} FOR i IN range(1, len(ex))] AS it, {{'s': ex[1].s, 'e': ex[-1].e}} AS w, list_sum([x.e - x.s + 1 FOR x IN ex]) AS n FROM ei0),
    pr AS (SELECT q.id, r.id AS rid, q.strand <> r.strand AS opp, q.ex AS qex, r.ex AS rex, q.it AS qit, r.it AS rit, q.w AS q, r.w AS r, q.n AS qn, r.n AS rn,
           coalesce(list_sum([coalesce(list_sum([greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1) FOR b IN r.ex]), 0) FOR a IN q.ex]), 0) AS ov
           FROM ei AS q JOIN ei AS r ON q.side = 'q' AND r.side = 'r' AND q.seqid = r.seqid AND q.w.s <= r.w.e + 2000 AND r.w.s <= q.w.e + 2000),
    pc AS (SELECT id, rid, ov, CASE
        WHEN ov > 0 AND NOT opp THEN CASE
            WHEN len(qit) = 0 AND len(rit) = 0 AND 5 * ov >= 4 * greatest(qn, rn) THEN '=' WHEN len(qit) > 0 AND qit = rit THEN '='
            WHEN {_INSIDE('q', 'r')} AND {_SAME_RUN('q', 'r')} THEN 'c' WHEN len(qit) = 0 AND len([1 FOR e IN rex IF {_INSIDE('q', 'e')}]) > 0 THEN 'c'
            WHEN {_INSIDE('r', 'q')} AND {_SAME_RUN('r', 'q')} THEN 'k' WHEN len(rit) = 0 AND len([1 FOR e IN qex IF {_INSIDE('r', 'e')}]) > 0 THEN 'k'
            WHEN len([1 FOR x IN rit IF {_KEPT}]) > 0 THEN CASE WHEN len([1 FOR x IN rit IF x.s > q.s AND x.e < q.e AND NOT (list_contains(qit, x) OR {_KEPT})]) = 0
                AND len([1 FOR x IN qit IF x.s > r.s AND x.e < r.e AND NOT list_contains(rit, x)]) = 0 THEN 'm' ELSE 'n' END
            WHEN list_has_any([x.s FOR x IN qit], [x.s FOR x IN rit]) OR list_has_any([x.e FOR x IN qit], [x.e FOR x IN rit]) THEN 'j'
            WHEN len(qit) = 0 AND len([1 FOR x IN rit IF least(q.e, x.e) - greatest(q.s, x.s) + 1 >= 10]) > 0 THEN 'e' ELSE 'o' END
        WHEN opp AND list_has_any(qit, rit) THEN 's' WHEN ov > 0 THEN 'x' WHEN len([1 FOR x IN rit IF {_INSIDE('q', 'x')}]) > 0 THEN 'i' WHEN len([1 FOR x IN qit IF {_INSIDE('r', 'x')}]) > 0 THEN 'y'
        WHEN NOT opp AND (q.s > r.e OR r.s > q.e) AND greatest(q.s - r.e, r.s - q.e) <= 2000 THEN 'p' END AS code FROM pr),
    pb AS (SELECT id, rid, code, row_number() OVER (PARTITION BY id ORDER BY strpos('{overlap.CODES}', code), ov DESC, rid) AS nth FROM pc WHERE code IS NOT NULL)""".replace("FROM ei0)", "FROM em)")
_W = "wd AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part)"
_LOOKUP = f"""{_W}, asked AS (SELECT DISTINCT x, translate(x, 'I', 'L') AS y FROM (SELECT s AS x FROM wd UNION ALL SELECT substr(s, 3, 5) FROM wd)), pr AS (SELECT p_partkey, translate('M' || s || s, 'I', 'L') AS q FROM wd),
    hits AS (SELECT x, p_partkey, y, q, unnest(range(1, len(q) - len(y) + 2)) AS position FROM asked JOIN pr ON contains(q, y) WHERE len(y) >= 5 AND regexp_matches(y, '^[ACDEFGHIKLMNPQRSTVWY]+$')),
    good AS (SELECT x AS peptide, p_partkey::VARCHAR AS protein, position::BIGINT AS position FROM hits WHERE substr(q, position, len(y)) = y),
    lk AS (SELECT * FROM good UNION ALL SELECT x, 'UNMAPPED', 0 FROM asked WHERE x NOT IN (SELECT peptide FROM good))"""


def _histogram(source: str, value: str, groups: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{g}' AS grp, {value} AS x FROM {source} WHERE {e}" for g, e in groups.items())
    return f"""h0 AS ({each}), h1 AS (SELECT grp, min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo, max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi, count(*) AS n0 FROM h0 GROUP BY grp),
        h2 AS (SELECT grp, least(floor((x - lo) / ((hi - lo) / 20)), 19)::INT AS bin, lo, hi, n0, count(*) AS n FROM h0 JOIN h1 USING (grp) GROUP BY ALL)
        SELECT grp AS "group", bin, n, round_even(n / (n0 * ((hi - lo) / 20)) * 1000000, 0) / 1000000 AS density FROM h2"""


_MASS = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scalars.RESIDUE_MASS.items()) + " ELSE 0 END"

ORACLE_SQL: dict[str, str] = {
    "protein_support": f"WITH {_S} SELECT * FROM t",
    "isoforms_per_gene": f"WITH {_M} SELECT gene, count(DISTINCT protein) AS isoforms FROM m GROUP BY gene",
    "protein_extent": f"WITH {_M} SELECT protein, min(s) AS low, max(e) AS high FROM m GROUP BY protein",
    "model_facts": f"WITH {_ALL}, {_FACTS} SELECT DISTINCT protein, isoforms, splice_sites, low, high FROM facts",
    "codon_coordinates": f"WITH {_M}, {_C} SELECT protein, s, e, cs AS cds_start, ce AS cds_end, splice_sites FROM c",
    "specificity_flags": f"WITH {_P}, {_SPEC} SELECT * FROM sp",
    "interval_coverage": f"WITH {_P}, {_COV} SELECT * FROM cov",
    "contained_semi": f"WITH {_M}, {_P}, {_C} SELECT peptide, protein, ps AS pep_start, pe AS pep_end FROM p WHERE EXISTS (SELECT 1 FROM c WHERE c.protein = p.protein AND cs <= ps AND ce >= pe)",
    "project_to_genome": f"WITH {_M}, {_P}, {_C}, {_G} SELECT protein, peptide, ps AS pep_start, pe AS pep_end, gs AS genome_start, ge AS genome_end FROM g",
    "transcript_projection": f"""WITH {_M}, {_P}, k AS (SELECT *, te - (e - s) AS ts FROM (SELECT *, sum(e - s + 1) OVER (PARTITION BY protein ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS te FROM m)),
        q AS (SELECT k.protein, peptide, ps AS f_start, strand, s, e, greatest(ps, ts) - ts AS a, least(pe + 60, te) - ts AS b FROM p JOIN k ON p.protein = k.protein WHERE pe + 60 >= ts AND ps <= te)
        SELECT protein, peptide, f_start, CASE WHEN strand = '+' THEN s + a ELSE e - b END AS genome_start, CASE WHEN strand = '+' THEN s + b ELSE e - a END AS genome_end FROM q""",
    "orf_projection": f"""WITH {_M}, k AS (SELECT *, te - (e - s) AS ts FROM (SELECT *, sum(e - s + 1) OVER (PARTITION BY protein ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS te FROM m)),
        q AS (SELECT k.*, frame, greatest(fs, ts) - ts AS a, least(fe, te) - ts AS b FROM k, (VALUES (5, 20, '0'), (31, 90, '1')) AS v(fs, fe, frame) WHERE fe >= ts AND fs <= te)
        SELECT 'o' || protein AS protein, gene, seqid, 'CDS' AS type, CASE WHEN strand = '+' THEN s + a ELSE e - b END AS s, CASE WHEN strand = '+' THEN s + b ELSE e - a END AS e, strand, frame FROM q
        UNION ALL SELECT 'o' || protein, max(gene), max(seqid), 'transcript', min(s), max(e), max(strand), '.' FROM m GROUP BY protein""",
    "protein_features": f"WITH {_F} SELECT * FROM f",
    "score_table": f"WITH {_ST} SELECT * FROM st",
    "score_filter": f"WITH {_S} SELECT protein, external_score, round_even(cutoff * 1000000, 0) / 1000000 AS cutoff, score_supported FROM ss",
    "evidence_partitions": f"""WITH {_ST}, n AS (SELECT count(*) AS n, count(*) FILTER (mapped_peptides > 0) AS a, count(*) FILTER (n_terminal_peptides > 0) AS b, count(*) FILTER (c_terminal_peptides > 0) AS c,
        count(*) FILTER (splice_sites > 0 AND splice_peptides >= splice_sites) AS d, count(*) FILTER (splice_sites > 0 AND splice_peptides > 0 AND splice_peptides < splice_sites) AS e FROM st)
        SELECT 'mapped_peptides' AS bar, a AS supported, 0::BIGINT AS partial, n - a AS unsupported FROM n UNION ALL SELECT 'n_terminal_support', b, 0, n - b FROM n UNION ALL SELECT 'c_terminal_support', c, 0, n - c FROM n
        UNION ALL SELECT 'splice_site_support', d, e, n - d - e FROM n""",
    "engineered_features": f"""WITH {_F} SELECT *, {_rate('mapped_peptides', 'protein_length', 'mapped_peptides_per_aa')}, {_rate('protein_specific_peptides', 'mapped_peptides', 'protein_specific_rate')},
        {_rate('gene_specific_peptides', 'mapped_peptides', 'gene_specific_rate')}, {_rate('splice_peptides', 'mapped_peptides', 'splice_rate')}, {_rate('internal_peptides', 'mapped_peptides', 'internal_rate')},
        {_rate('n_terminal_peptides + c_terminal_peptides', 'mapped_peptides', 'terminal_rate')}, {_rate('splice_peptides', 'internal_peptides', 'junction_evidence')},
        (n_terminal_peptides > 0)::INT AS has_n_term, (c_terminal_peptides > 0)::INT AS has_c_term, (n_terminal_peptides > 0 AND c_terminal_peptides > 0)::INT AS has_both_term,
        (protein_specific_peptides > 0)::INT AS has_any_protein_specific, (splice_peptides > 0)::INT AS has_any_splice,
        round_even((protein_specific_peptides::DOUBLE / greatest(mapped_peptides, 1) - gene_specific_peptides::DOUBLE / greatest(mapped_peptides, 1)) * 1000000, 0) / 1000000 AS isoform_specificity FROM f""",
    "high_low_confidence": f"WITH {_ST} SELECT protein, {_HIGH} AS high, {_LOW} AS low FROM st",
    "roc_points": f"WITH {_SC}, {_ROC} SELECT i, round_even(tpr * 1000000, 0) / 1000000 AS tpr, round_even(fpr * 1000000, 0) / 1000000 AS fpr FROM rp",
    "roc_cutoff": f"WITH {_SC}, {_ROC} SELECT round_even(cutoff * 1000000, 0) / 1000000 AS cutoff, round_even(youden * 1000000, 0) / 1000000 AS youden FROM cu",
    "substring_search": """WITH h AS (SELECT doc_id, item_id, d.text AS t, b.text AS p FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text)),
        u AS (SELECT *, unnest(range(1, length(t) - length(p) + 2)) AS position FROM h) SELECT doc_id, item_id, position FROM u WHERE substr(t, position, length(p)) = p""",
    "search_context": """WITH b AS (SELECT item_id, substr(text, 1 + item_id % 7, 6 + item_id * 5 % 35) AS p FROM benchmark), h AS (SELECT doc_id, item_id, text AS t, p FROM documents JOIN b ON contains(text, p)),
        u AS (SELECT *, unnest(range(1, length(t) - length(p) + 2)) AS position FROM h), v AS (SELECT * FROM u WHERE substr(t, position, length(p)) = p),
        x AS (SELECT *, CASE WHEN position > 1 THEN substr(t, position - 1, 1) ELSE '-' END AS before, CASE WHEN position + length(p) <= length(t) THEN substr(t, position + length(p), 1) ELSE '-' END AS after FROM v)
        SELECT doc_id, item_id, position, before, after, (before = '-' OR (before IN ('K', 'R') AND p[1] <> 'P'))::INT + (after = '-' OR (p[-1] IN ('K', 'R') AND after <> 'P'))::INT AS ntt FROM x""",
    "peptide_lookup": f"WITH {_LOOKUP} SELECT * FROM lk",
    "index_lookup": f"WITH {_LOOKUP} SELECT * FROM lk",
    "lookup_report": f"WITH {_LOOKUP} SELECT 'peptide' || chr(9) || 'protein' || chr(9) || 'location' AS value UNION ALL SELECT peptide || chr(9) || protein || chr(9) || position FROM lk",
    "translated_models": f"""WITH {_M}, g AS (SELECT 'chr' || c_nationkey AS seqid, string_agg(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY o_orderkey) AS t
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), j AS (SELECT protein, strand, string_agg(substr(t, s, e - s + 1), '' ORDER BY s, e) AS d FROM m JOIN g ON m.seqid = g.seqid GROUP BY ALL),
        c AS (SELECT protein, CASE WHEN strand = '-' THEN reverse(translate(d, 'ACGT', 'TGCA')) ELSE d END AS d FROM j)
        SELECT protein, coalesce(array_to_string([substr('{genome.AMINO_ACIDS}', 16 * (strpos('TCAG', d[3 * i + 1]) - 1) + 4 * (strpos('TCAG', d[3 * i + 2]) - 1) + strpos('TCAG', d[3 * i + 3]), 1) FOR i IN range(0, len(d) // 3)], ''), '') AS sequence FROM c""",
    "class_codes": f"WITH {_M}, {_CLASSES} SELECT e.id AS qry_id, rid::VARCHAR AS ref_id, coalesce(code, 'u') AS class_code FROM ei AS e LEFT JOIN pb ON e.id = pb.id AND nth = 1 WHERE side = 'q'",
    "fuzzy_lookup": f"""WITH {_W}, q AS (SELECT DISTINCT trim(CASE WHEN p_partkey % 3 = 0 THEN s[2:5] || 'W' || s[7:8] || 'I' || s[10:12] ELSE s[2:12] END) AS peptide FROM wd),
        a AS (SELECT peptide, translate(peptide, 'I', 'L') AS p FROM q), t AS (SELECT DISTINCT translate('M' || s || s, 'I', 'L') AS t FROM wd),
        w AS (SELECT DISTINCT p FROM a WHERE len(p) >= 5 AND regexp_matches(p, '^[ACDEFGHIKLMNPQRSTVWY]+$')), n AS (SELECT DISTINCT len(p) AS n FROM w),
        u AS (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, n), f AS (SELECT DISTINCT substr(t, i, n) AS f FROM u WHERE regexp_matches(substr(t, i, n), '^[{search.ALPHABET}]+$')),
        h AS (SELECT p, f, hamming(p, f)::INT AS substitutions FROM w JOIN f ON len(p) = len(f) AND hamming(p, f) <= 2),
        r AS (SELECT p, p_partkey, i AS position, substitutions, array_to_string([(j - 1) || ',' || f[j] || ';' FOR j IN range(1, len(p) + 1) IF p[j] <> f[j]], '') AS places
              FROM h JOIN u ON len(f) = n AND substr(u.t, i, n) = f JOIN wd ON translate('M' || s || s, 'I', 'L') = u.t)
        SELECT peptide, coalesce(p_partkey::VARCHAR, 'UNMAPPED') AS protein, coalesce(position, 0) AS position, coalesce(substitutions, -1) AS substitutions, places FROM a LEFT JOIN r ON a.p = r.p""",
    "variant_lookup": f"""WITH {_W}, a AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN s[2:11] WHEN 1 THEN s[2:4] || 'W' || s[6:11] WHEN 2 THEN s[2:6] || 'K' || s[8:11] ELSE s[2:4] || 'W' || s[6:6] || 'K' || s[8:11] END AS peptide FROM wd),
        b AS (SELECT peptide, translate(peptide, 'I', 'L') AS p FROM a), w AS (SELECT DISTINCT p FROM b WHERE len(p) >= 5 AND regexp_matches(p, '^[ACDEFGHIKLMNPQRSTVWY]+$')),
        t AS (SELECT DISTINCT translate('M' || s || s, 'I', 'L') AS t FROM wd), x AS (SELECT t, CASE WHEN i % 2 = 1 THEN t[:5] || 'W' || t[7:] ELSE t END AS y, i FROM t, range(4) AS r(i)),
        z AS (SELECT DISTINCT t, CASE WHEN i >= 2 THEN y[:7] || 'K' || y[9:] ELSE y END AS z FROM x), u AS (SELECT t, z, n, unnest(range(1, len(z) - n + 2)) AS i FROM z, (SELECT DISTINCT len(p) AS n FROM w)),
        h AS (SELECT DISTINCT p, t, i FROM u JOIN w ON substr(z, i, n) = p), r AS (SELECT p, p_partkey, i AS position,
            array_to_string([j || ':' || h.t[j] || '>' || p[j - i + 1] FOR j IN range(i, i + len(p)) IF h.t[j] <> p[j - i + 1]], ';') AS variants FROM h JOIN wd ON translate('M' || s || s, 'I', 'L') = h.t)
        SELECT peptide, coalesce(p_partkey::VARCHAR, 'UNMAPPED') AS protein, coalesce(position, 0) AS position, variants FROM b LEFT JOIN r ON b.p = r.p""",
    "wildcard_lookup": f"""WITH {_W}, a AS (SELECT DISTINCT s[2:4] || 'XXX' || s[8:9] || 'X' || s[11:11] || 'XX' AS peptide FROM wd), b AS (SELECT peptide, translate(peptide, 'I', 'L') AS p FROM a),
        t AS (SELECT DISTINCT translate('M' || s || s, 'I', 'L') AS t FROM wd),
        w AS (SELECT DISTINCT p, replace(p, 'X', '[{search.ALPHABET}]') AS e FROM b WHERE regexp_matches(p, '^[ACDEFGHIKLMNPQRSTVWXY]+$')),
        u AS (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (SELECT DISTINCT len(p) AS n FROM w)), f AS (SELECT DISTINCT substr(t, i, n) AS f FROM u),
        h AS (SELECT p, f FROM w JOIN f ON len(p) = len(f) AND p[1:3] = f[1:3] AND regexp_full_match(f, e)), r AS (SELECT p, p_partkey, i AS position FROM h JOIN u ON len(f) = n AND substr(u.t, i, n) = f JOIN wd ON translate('M' || s || s, 'I', 'L') = u.t)
        SELECT peptide, coalesce(p_partkey::VARCHAR, 'UNMAPPED') AS protein, coalesce(position, 0) AS position FROM b LEFT JOIN r ON b.p = r.p""",
    "peptide_location": f"""WITH {_W}, p AS (SELECT p_partkey AS protein, s, unnest([s[:4], s[-4:]]) AS peptide, translate(CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE '' END || s || s, 'I', 'L') AS q FROM wd),
        x AS (SELECT *, strpos(q, translate(peptide, 'I', 'L'))::INT AS pep_start FROM p), y AS (SELECT *, CASE WHEN pep_start > 0 THEN pep_start + 3 ELSE 0 END::INT AS pep_end FROM x)
        SELECT protein, peptide, pep_start, pep_end, length(q)::INT AS prot_len, pep_start = 1 OR (pep_start = 2 AND q[1] = 'M') AS n_terminal, pep_end = length(q) AS c_terminal FROM y""",
    "alternatives": f"""WITH {_W}, d AS (SELECT s, min(p_partkey) AS k FROM wd GROUP BY s), x AS (SELECT a.s AS peptide, CASE WHEN b.k % 3 = 0 THEN 'DECOY_' ELSE '' END || b.s AS protein, b.k % 3 AS ntt, hamming(a.s, b.s)::INT AS substitutions,
        array_to_string([(i - 1) || ',' || b.s[i] || ';' FOR i IN range(1, len(a.s) + 1) IF a.s[i] <> b.s[i]], '') AS places FROM d AS a JOIN d AS b ON len(a.s) = len(b.s) AND hamming(a.s, b.s) <= 3)
        SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY substitutions, ntt DESC, starts_with(protein, 'DECOY_'), protein)::INT AS nth FROM x""",
    "fuzzy_patterns": f"""WITH {_W}, d AS (SELECT DISTINCT s FROM wd), x AS (SELECT s, i, unnest(range(i + 1, len(s) + 1)) AS j FROM (SELECT s, unnest(range(1, len(s))) AS i FROM d)),
        y AS (SELECT s, substr(s, 1, i - 1) || 'X' || substr(s, i + 1, j - i - 1) || 'X' || substr(s, j + 1) AS p FROM x) SELECT s AS peptide, count(*) AS n, min(p) AS lowest, max(p) AS highest FROM y GROUP BY s""",
    "wildcards": f"WITH {_W} SELECT DISTINCT s || 'X' AS peptide, replace(s || 'X', 'X', l) AS expanded FROM wd, (SELECT unnest(string_split('{search.ALPHABET}', '')) AS l) WHERE NOT contains(s, 'X')",
    "mass_window": f"""WITH {_W}, d AS (SELECT DISTINCT s FROM wd) SELECT s, round_even(({scalars.C_TERMINUS + scalars.N_TERMINUS + scalars.PROTON}::DOUBLE + list_sum(list_transform(string_split(s, ''), lambda c: {_MASS}))) * 10000, 0) / 10000 AS mass,
        len(s) >= 5 AND regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWY]+$') AS searchable, true AS own, contains(s, 'M') AS oxidised, false AS lighter, false AS odd, s AS own_as,
        CASE WHEN contains(s, 'M') THEN s || '(+15.9949)' END AS oxidised_as,
        CASE WHEN contains(s, 'M') AND regexp_matches(s, '[NQ]') THEN s || CASE WHEN regexp_extract(s, '[MNQ]') = 'M' THEN '(+15.9949)(+0.9840)' ELSE '(+0.9840)(+15.9949)' END END AS both_as FROM d""",
    "fuzzy_substitutions": "WITH d AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) SELECT a.k AS k, b.k AS k2, hamming(a.p_name, b.p_name)::INT AS substitutions FROM d AS a JOIN d AS b ON a.k < b.k AND length(a.p_name) = length(b.p_name) AND hamming(a.p_name, b.p_name) <= 4",
    "sequence_collapse": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS representative, count(*) OVER (PARTITION BY p_name) AS n FROM part",
    "attribute_extract": "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, 'utm_source=([^&#]+)', 1), '') AS source FROM pages",
    "reference_cleaning": f"WITH {_L} SELECT {_VALUE} AS value, {_KEEP} AS keep, count(*) AS n FROM li GROUP BY ALL",
    "feature_rows": f"""WITH {_L} SELECT lower(kind) AS type, s, e, 0.0::DOUBLE AS score, strand, CASE style WHEN 0 THEN CASE kind WHEN 'gene' THEN 'c' || l_orderkey ELSE model END WHEN 1 THEN 'g' WHEN 4 THEN 'h' ELSE CASE kind WHEN 'gene' THEN {_ATTRS} END END AS gene,
        CASE kind WHEN 'gene' THEN CASE style WHEN 0 THEN 'c' || l_orderkey WHEN 1 THEN model WHEN 4 THEN 'h' ELSE {_ATTRS} END ELSE CASE WHEN style IN (0, 1, 4) THEN model END END AS protein FROM li WHERE kind <> 'exon'""",
    "resolved_lines": f"""WITH {_L}, k AS (SELECT DISTINCT model AS known FROM li WHERE kind = 'CDS' AND style IN (1, 4)) SELECT {_VALUE} AS value, CASE WHEN style IN (1, 4) THEN model WHEN style = 0 THEN known END AS protein, count(*) AS n FROM li LEFT JOIN k ON known = model GROUP BY ALL""",
    "removed_rows": f"WITH {_L} SELECT count(*) FILTER (NOT ({_KEEP})) AS removed FROM li",
    "transcript_models": f"""WITH {_L}, x AS (SELECT *, CASE style WHEN 0 THEN 'c' || l_orderkey ELSE model END AS transcript, CASE style WHEN 0 THEN model WHEN 1 THEN 'g' ELSE model END AS gene FROM li WHERE kind = 'exon' AND style IN (0, 1, 4))
        SELECT transcript, (list(strand ORDER BY {_PLACE}))[-1] AS strand, (list(gene ORDER BY {_PLACE}))[-1] AS gene, min(s) AS low, max(e) AS high, array_to_string(list(s || '-' || e ORDER BY s, e), ',') AS exons FROM x GROUP BY transcript""",
    "cds_models": f"""WITH {_L}, x AS (SELECT *, CASE style WHEN 1 THEN 'g' WHEN 4 THEN 'h' END AS gene FROM li WHERE kind = 'CDS' AND style IN (0, 1, 4)), y AS (SELECT model, string_agg(s || '-' || e, ',' ORDER BY s, e) AS regions FROM (SELECT DISTINCT model, s, e FROM x) GROUP BY model)
        SELECT model AS protein, (list(gene ORDER BY {_PLACE}))[-1] AS gene, (list(strand ORDER BY {_PLACE}))[-1] AS strand, any_value(regions) AS regions FROM x JOIN y USING (model) GROUP BY model""",
    "splice_junctions": f"WITH {_M} SELECT * FROM (SELECT protein, e AS donor, lead(s) OVER (PARTITION BY protein ORDER BY s, e) AS acceptor FROM m) WHERE acceptor IS NOT NULL",
    "structure_diff": f"WITH {_M}, {_D} SELECT protein, difference, stop FROM w",
    "junction_support": f"WITH {_B}, {_D}, {_J} SELECT protein AS qry_id, splice_support FROM js",
    "evidence_report": f"""WITH {_E} SELECT protein AS predicted_id, protein AS reference_id, difference AS structural_difference, category AS peptide_evidence_category, n_terminal_peptides, c_terminal_peptides,
        CASE WHEN category = 'peptide_support_different_splice' THEN splice_support ELSE splice_peptides END AS splice_peptides, mapped_peptides, sequence_coverage FROM ev WHERE category IS NOT NULL""",
    "category_summary": f"WITH {_M}, {_D} SELECT difference, count(*) AS n, array_to_string(list(protein ORDER BY protein)[1:10], ',') AS examples FROM w GROUP BY difference",
    "difference_counts": f"""WITH {_E}, x AS (SELECT category AS what, count(*) AS n FROM ev GROUP BY 1 UNION ALL SELECT 'novel', count(DISTINCT protein) FROM cd WHERE class_code = 'u')
        SELECT k.what, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('novel'), ('peptide_support_different_splice'), ('peptide_support_different_start'), ('peptide_support_different_stop')) AS k(what) LEFT JOIN x ON x.what = k.what""",
    "locus_summary": f"WITH {_M} SELECT protein, string_agg(DISTINCT gene::VARCHAR, ',' ORDER BY gene::VARCHAR) AS genes, min(seqid) AS seqid, min(strand) AS strand, min(s) AS low, max(e) AS high FROM m GROUP BY protein",
    "locus_clusters": """WITH l AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'prediction' ELSE 'assembly' END AS branch, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(value)::BIGINT AS e FROM events),
        r AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM r)
        SELECT event_type, min(s) AS low, max(e) AS high, count(*) AS n, CASE WHEN min(branch) = max(branch) THEN min(branch) || '-only' ELSE 'shared' END AS label FROM i GROUP BY event_type, isle""",
    "class_code_summary": "WITH c AS (SELECT lower(substr(p_type, 1, 1)) AS class_code, count(*) AS n FROM part GROUP BY 1) SELECT class_code, n, CASE class_code "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in compare.CLASS_CODES.items())
    + " ELSE 'other/unknown' END AS description, round_even(n::DOUBLE / (SELECT sum(n) FROM c) * 10000, 0) / 10000 AS fraction FROM c",
    "accepted_totals": f"WITH {_CODES} SELECT count(*) FILTER (class_code IN ('=', 'j', 'c', 'k', 'm', 'n')) AS accepted_overlap, count(*) FILTER (class_code IS NULL OR class_code NOT IN ('=', 'j', 'c', 'k', 'm', 'n')) AS other_classes, count(*) AS total FROM cd",
    "overlap_stats": """WITH p AS (SELECT count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem WHERE l_returnflag IN ('N', 'A') AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier)),
        q AS (SELECT a, b, least(a, b) AS s, (SELECT count(*) FROM part) AS na, (SELECT count(*) FROM supplier) AS nb FROM p)
        SELECT a AS matched_left, b AS matched_right, s AS shared, na - s AS only_left, nb - s AS only_right, s + na - s + nb - s AS union_, round_even(s::DOUBLE / (na + nb - s) * 10000, 0) / 10000 AS jaccard FROM q""",
    "novel_candidates": """WITH h AS (SELECT DISTINCT l_partkey AS k, l_suppkey::VARCHAR AS q, s_nationkey::VARCHAR AS g, CASE l_returnflag WHEN 'N' THEN '=' ELSE 'j' END AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('N', 'A') AND l_partkey % 2 = l_suppkey % 2),
        x AS (SELECT k, '{' || string_agg(DISTINCT q, ',' ORDER BY q) || '}' AS bam_proteins, '{' || string_agg(DISTINCT g, ',' ORDER BY g) || '}' AS bam_genes, '{' || string_agg(DISTINCT c, ',' ORDER BY c) || '}' AS bam_class_codes, count(DISTINCT q) AS bam_match_count FROM h GROUP BY k),
        y AS (SELECT p_brand AS seqid, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, k::VARCHAR AS prediction_protein, p_type AS prediction_gene, p_size AS prediction_start, p_size + 5 AS prediction_end, bam_proteins, bam_genes, bam_class_codes, bam_match_count FROM x JOIN part ON k = p_partkey)
        SELECT 'HPNGC_' || printf('%04d', row_number() OVER (ORDER BY bam_match_count DESC, seqid, prediction_start, prediction_protein)) AS candidate_id, * FROM y""",
    "candidate_ranking": """WITH x AS (SELECT l_partkey AS protein, '{' || string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) || '}' AS others,
            '{' || string_agg(DISTINCT CASE l_returnflag WHEN 'N' THEN '=' WHEN 'A' THEN 'j' ELSE 'u' END, ',' ORDER BY CASE l_returnflag WHEN 'N' THEN '=' WHEN 'A' THEN 'j' ELSE 'u' END) || '}' AS codes, count(DISTINCT l_suppkey) AS n_matches FROM lineitem GROUP BY 1)
        SELECT 'HPNGC_' || printf('%04d', row_number() OVER (ORDER BY n_matches DESC, p_brand, p_size, protein)) AS candidate_id, protein, p_brand AS seqid, others, codes, n_matches FROM x JOIN part ON protein = p_partkey""",
    "merged_dedupe": f"WITH {_M} SELECT protein, gene, seqid, s, e FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY s, e) AS n FROM m) WHERE n = 1",
    "merged_models": f"""WITH {_M}, x AS (SELECT protein, any_value(seqid) AS seqid, any_value(strand) AS strand, min(s) AS lo, max(e) AS hi, max(s % 10 / 10.0::DOUBLE) AS sc, 'gene_id "' || any_value(gene) || '"; transcript_id "' || protein || '";' AS attrs FROM m GROUP BY protein),
        y AS (SELECT *, CASE WHEN sc = 0 THEN '0' ELSE printf('%g', sc) END AS score FROM x)
        SELECT seqid, 'x' AS source, 'transcript' AS type, lo AS s, hi AS e, score, strand, '.' AS frame, attrs FROM y UNION ALL
        SELECT y.seqid, 'x', 'CDS', s, e, score, y.strand, CASE WHEN e % 4 < 3 THEN (e % 4)::VARCHAR ELSE '.' END, attrs FROM m JOIN y USING (protein)""",
    "evidence_bars": f"WITH {_S} " + " UNION ALL ".join(f"SELECT '{k}' AS bar, count(*) FILTER ({k} > 0 AND supported = '+') AS supported, count(*) FILTER ({k} > 0 AND supported <> '+') AS peptide_evidence, count(*) FILTER ({k} <= 0) AS no_peptides, count(*) AS total FROM t" for k in ("mapped_peptides", "n_terminal_peptides", "c_terminal_peptides", "splice_peptides")),
    "legacy_bars": f"WITH {_ST} " + " UNION ALL ".join(f"SELECT '{b}' AS bar, 0::BIGINT AS supported, count(*) FILTER ({e}) AS peptide_evidence, count(*) FILTER (NOT ({e})) AS no_peptides, count(*) AS total FROM st" for b, e in (("mapped_peptides", "mapped_peptides > 0"), ("n_terminal_support", "n_terminal_peptides > 0"), ("c_terminal_support", "c_terminal_peptides > 0"), ("splice_site_support", "splice_sites > 0 AND splice_peptides > 0"))),
    "coverage_histogram": f"WITH {_S}, {_histogram('t', 'sequence_coverage', charts.COVERAGE_GROUPS)}",
    "score_histogram": f"WITH {_S}, {_histogram('t', 'external_score', {'all': 'true', 'supported': chr(39).join(('supported = ', '+', ''))})}",
    "peptide_types": f"WITH {_B} SELECT CASE WHEN len(ss) > 1 THEN 'spliced' WHEN ps = 1 THEN 'n_terminal' WHEN pe = plen THEN 'c_terminal' ELSE 'internal' END AS type, count(*) AS n FROM o GROUP BY 1",
    "subset_by_ids": f"WITH {_M} SELECT protein, gene, seqid, s, e FROM m WHERE protein IN (SELECT s_suppkey FROM supplier) OR gene IN (SELECT s_suppkey FROM supplier)",
    "merged_sequences": "SELECT p_partkey AS id, p_name AS sequence FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)",
    "bed12_rows": f"""WITH {_B}
        SELECT seqid AS chrom, ss[1] - 1 AS chrom_start, list_max(es) AS chrom_end, CASE WHEN strand = '-' THEN reverse(peptide) ELSE peptide END AS name, 0 AS score, strand, ss[1] - 1 AS thick_start, list_max(es) AS thick_end,
            CASE WHEN len(ss) > 1 THEN '255,0,0' WHEN ps = 1 THEN '0,255,0' WHEN pe = plen THEN '0,0,255' ELSE '153,153,153' END AS rgb, len(ss)::INT AS block_count,
            array_to_string([es[i] - ss[i] + 1 FOR i IN range(1, len(ss) + 1)], ',') AS block_sizes, array_to_string([ss[i] - ss[1] FOR i IN range(1, len(ss) + 1)], ',') AS block_starts FROM o""",
    "classifier_metrics": """WITH x AS (SELECT quality = 1 AS y, n_chars > 1000 AS z FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), n AS (SELECT count(*) FILTER (y AND z) AS tp, count(*) FILTER (NOT y AND z) AS fp, count(*) FILTER (y AND NOT z) AS fn, count(*) FILTER (NOT y AND NOT z) AS tn FROM x)
        SELECT round_even((tp + tn)::DOUBLE / (tp + tn + fp + fn) * 1000000, 0) / 1000000 AS accuracy, round_even(tp::DOUBLE / (tp + fp) * 1000000, 0) / 1000000 AS "precision", round_even(tp::DOUBLE / (tp + fn) * 1000000, 0) / 1000000 AS recall,
            round_even((2 * tp)::DOUBLE / (2 * tp + fp + fn) * 1000000, 0) / 1000000 AS f1 FROM n""",
}

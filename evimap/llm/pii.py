"""Personal data: patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Every word of a
document that holds an entity is a candidate term. A term's share of all texts and its share of an entity's
documents give the pointwise mutual information between term and entity. Where that is DISCLOSURE of the entity's
information content or more, and is no chance, the term discloses the entity: it is generalised to a class, and from
REMOVAL on removed. Base spans always stay.

Chance: were term and entity independent, at least so many common documents would turn up with a probability of at
most 2 ** -(documents * KL divergence of the two shares) (Hoeffding). Over all terms of the corpus, that may promise
LEVEL disclosing terms for an entity at most. So no number of mentions is asked for: what one or two are worth depends
on how rare the term is and how many rare terms any document has.

Copies of a document, exact or near, count once: documents are counted by the distinct values of a sketch of their
three-word runs, taking the least count of SKETCHES independent ones.

The first pass writes entities and terms of the documents that have any (few); pairs are counted with partial sums,
only for entities that could reach the level with the rarest of terms.

Defined results: a null or empty text has no spans; equal or null ids are rows of their own; a text of any length
is one row; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evimap.llm.common import NOT_SPACE, SPACE, Words, materialise, mix, quoted, slices, windows

KINDS = ("email", "ip", "card", "phone", "term", "gone")
#: Shares of an entity's information, and disclosing terms that chance may give an entity.
DISCLOSURE, REMOVAL, LEVEL = 0.6, 0.9, 0.05
#: Sketches of a document, each the least value of a hash over its three-word runs.
SKETCHES = 8
#: Stripped from both ends of a word to make a term.
_EDGES = ".,;:!?()[]{}\"'<>|*#$%&"

#: The patterns of the four kinds. Quantifiers that can't usefully give back are possessive, and an address begins where
#: its run of digits does, so that a scan takes time in proportion to the text.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKS = str.maketrans("", "", " ().+-")
_WORD = re.compile(NOT_SPACE + "+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    """The digits of a card or phone match."""
    return s.translate(_MARKS)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, by the @ in them: no other character of one is an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, kind an index of KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            # 19 digits and the marks between them are 37 characters
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Terms of a text with their places; words that touch a span are left out. spans: in order."""
    at = reach = 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            term = m[0].strip(_EDGES)
            if len(term) >= 3:
                start = m.start() + m[0].index(term)
                yield term, start, start + len(term)


def _sketches(text: str) -> list[int]:
    """Copies agree in all, near copies very likely in one, other texts hardly in any."""
    words = Words(pa.array([text]))
    runs, _ = windows(words.fingerprints(), words.first, 3)
    if not len(runs):
        return [int.from_bytes(md5(text.encode()).digest()[:8], "little", signed=True)] * SKETCHES
    return [int(mix(runs ^ mix(np.array([k + 1], np.uint64))).min().astype(np.int64)) for k in range(SKETCHES)]


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (unique), digest of the text, its entities, terms and sketches, of documents that have entities."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    if spans := base_spans(text) if text else []:
                        entities = {f"{KINDS[k]}:{text[s:e].lower() if k < 2 else _digits(text[s:e])}" for s, k, e in spans}
                        terms = {t for t, _, _ in _terms(text, spans)}
                        out.append({"row": row, "digest": md5(text.encode()).digest(), "entities": sorted(entities), "terms": sorted(terms), "sketches": _sketches(text)})
                        row += 1
                yield pa.RecordBatch.from_pylist(out, _FOUND)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(each, "row long, digest binary, entities array<string>, terms array<string>, sketches array<long>")


#: Disclosing terms that may be broadcast; with more of them texts are joined with the terms that stand in them.
BROADCAST_TERMS = 1 << 18
_FOUND = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("sketches", pa.list_(pa.int64()))])
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _texts_terms(text_col: str):
    terms = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+"), lambda w: F.btrim(w, F.lit(_EDGES))))
    return F.filter(terms, lambda t: F.length(t) >= 3)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df: in how many documents a term stands, over all documents."""
    return docs.select(F.explode(_texts_terms(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _copies_once(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n: documents of each key, copies once."""
    values = rows.select(*keys, F.posexplode("sketches").alias("_k", "_s")).distinct()
    return values.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min("n").alias("n"))


def disclosures(found: DataFrame, docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, removal: float = REMOVAL, level: float = LEVEL) -> DataFrame:
    """entity, term, kind: the terms that give an entity away, with what happens to them (an index of KINDS)."""
    frequencies = materialise(document_frequencies(docs, text_col), "terms")
    n, n_terms = float(max(docs.count(), 1)), max(frequencies.count(), 1)
    asked = math.log2(n_terms / level)
    mentions = found.select("row", F.explode("entities").alias("entity"), "sketches")
    entities = _copies_once(mentions, "entity").withColumnRenamed("n", "documents").where(F.col("documents") * math.log2(n) >= asked)
    entities = entities.join(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("holders")), "entity")
    pairs = mentions.join(entities.select("entity"), "entity").join(found.select("row", F.explode("terms").alias("term")), "row")
    scored = _copies_once(pairs, "entity", "term").withColumnRenamed("n", "both").join(entities, "entity").join(frequencies, "term")
    q, p = F.col("both") / F.col("documents"), F.col("df") / n
    information, mutual = F.log2(n / F.col("holders")), F.log2(q / p)
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    divergence = F.when(q <= p, 0.0).otherwise(q * F.log2(q / p) + F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0))
    sure = scored.withColumn("_share", share).where(F.col("_share") >= disclosure).where(F.col("documents") * divergence >= asked)
    return sure.select("entity", "term", F.when(F.col("_share") >= removal, 5).otherwise(4).alias("kind"))


def disclosing_terms(docs: DataFrame, text_col: str, **thresholds) -> DataFrame:
    """term, kind: the terms that disclose an entity, written."""
    found = materialise(detect(docs, text_col), "pii")
    return materialise(disclosures(found, docs, text_col, **thresholds).groupBy("term").agg(F.max("kind").alias("kind")), "pii")


def term_hits(docs: DataFrame, text_col: str, kinds: DataFrame) -> DataFrame:
    """digest (of a text), hits (term, kind): the disclosing terms that stand in it."""
    hits = docs.select(F.unhex(F.md5(text_col)).alias("digest"), F.explode(_texts_terms(text_col)).alias("term")).join(kinds, "term")
    return materialise(hits.groupBy("digest").agg(F.collect_set(F.struct("term", "kind")).alias("hits")), "pii")


def _with_spans(docs: DataFrame, text_col: str, keep: list, each, schema: str, **thresholds) -> DataFrame:
    """keep and each text with its base spans and places of disclosing terms through each (text, spans, terms)."""
    kinds_of = disclosing_terms(docs, text_col, **thresholds)
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    every = None
    if kinds_of.count() <= BROADCAST_TERMS:  # the tasks look the words of a text up: no text is shuffled
        every = docs.sparkSession.sparkContext.broadcast({r["term"]: r["kind"] for r in kinds_of.collect()})
        rows = rows.withColumn("hits", F.expr("cast(null as array<struct<term:string,kind:int>>)"))
    else:
        rows = rows.withColumn("digest", F.unhex(F.md5("text"))).join(term_hits(docs, text_col, kinds_of), "digest", "left").drop("digest")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True):
                    spans = base_spans(text) if text else []
                    kinds = every.value if every else {h["term"]: h["kind"] for h in hits or []}
                    out.append(each(text, spans, [(a, kinds[t], b) for t, a, b in _terms(text, spans) if t in kinds] if kinds else []))
                yield packed(part, out)

    def packed(part, out):
        columns = {name: pa.array([x[i] for x in out], type_) for i, (name, type_) in enumerate(_OUT[schema])}
        kept = [c for c in part.schema.names if c not in ("text", "hits")]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns.values()], names=[*kept, *columns])

    fields = [f for f in rows.schema.fields if f.name not in ("text", "hits")]
    return rows.mapInArrow(run, StructType([*fields, *StructType.fromDDL(schema).fields]))


_KINDS_OF = "array<struct<kind:int,start:long,end:long>>"
_OUT = {f"spans {_KINDS_OF}, terms {_KINDS_OF}": [("spans", _SPANS), ("terms", _SPANS)], "text string": [("text", pa.string())]}


def _structs(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for s, k, e in spans]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per document: doc_id, spans (base), terms."""
    return _with_spans(docs, text_col, [F.col(id_col).cast("long").alias("doc_id")], lambda text, spans, terms: (_structs(spans), _structs(terms)), f"spans {_KINDS_OF}, terms {_KINDS_OF}", **thresholds)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with base spans and disclosing terms replaced in the text; other columns and clean texts as they were."""
    doc = F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text_col] or [F.lit(0).alias("_")]).alias("doc")
    out = _with_spans(docs, text_col, [doc], lambda text, spans, terms: (rewritten(text, _structs(spans + terms)) if spans or terms else text,), "text string", **thresholds)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"doc.{quoted(c)}")).alias(c) for c in docs.columns])


def rewritten(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for start, end, kind in sorted((s["start"], -s["end"], s["kind"]) for s in spans):
        end = -end
        if end <= at:
            continue
        out += [text[at : max(at, start)], "" if kind == 5 else f"[{KINDS[kind].upper()}]" if start >= at else ""]
        at = end
    return "".join(out) + text[at:]


def digests(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and a listing of all spans by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans_):
        parts = F.transform(F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("s"), s["kind"].alias("k"), s["end"].alias("e")))), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string")))
        return F.array_join(parts, ",")

    counts = [F.expr(f"size(filter(spans, s -> s.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat("spans", "terms")).alias("spans"))

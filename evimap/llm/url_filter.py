"""URL filtering by a broadcast trie.

Rules are (host, path prefix, verdict). The trie's first levels are host labels from the last one on, so a rule
sits where its host and all subdomains pass; below a host stand its path segments, and under the segments
before a rule's last one the rules that end within the next segment. Of all rules that fit, the longest host
and path together wins, whatever it says; of equally long ones the one of the longer host, and of an allow and a block
entry for the same host and path the block.

A list of up to MAX_RULES is broadcast. A longer one is a table: pages are joined with it on each of their host's
suffixes and each prefix of their path, with the same result.

Defined results: a null url or one without :// has an empty host and path, no rule and the verdict for
unlisted pages; null and equal ids are rows of their own; equal urls give equal rows; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that may be broadcast (about 200 bytes each).
MAX_RULES = 200_000
SCHEMA = "host string, path string, rule string, verdict string"
_LOWER = {c: c + 32 for c in range(65, 91)}


class Trie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("label", label), {})
            *full, last = path.split("/")
            for segment in full:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("ends", {})
            if verdict == "block" or last not in ends:
                ends[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, with its verdict."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            under = node
            for segment in segments:
                if ends := under.get("ends"):
                    for k in range(len(segment) + 1):
                        if (rule := ends.get(segment[:k])) and (best is None or len(rule[0]) >= len(best[0])):
                            best = rule
                under = under.get(("segment", segment))
                if under is None:
                    break
        return best


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_LOWER), rest[cut:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], unlisted: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = MAX_RULES) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict. rules: (host, path prefix, "allow" or "block")."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    if len(rules) > most:
        return _joined(rows, rules, unlisted).withColumnRenamed("id", id_col)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def each(batches):
        find = trie.value.find
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule, verdict = (host and find(host, path)) or (None, unlisted)
                for column, x in zip(out, (host, path, rule, verdict), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in out)], names=["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(each, f"id {dict(rows.dtypes)['id']}, {SCHEMA}").withColumnRenamed("id", id_col)


def _joined(rows: DataFrame, rules: list[tuple[str, str, str]], unlisted: str) -> DataFrame:
    """The same for a list that is too long for a broadcast, by equi-joins."""
    table = rows.sparkSession.createDataFrame([(h.translate(_LOWER), p, h + p, v) for h, p, v in rules], "_host string, _path string, rule string, verdict string")
    table = table.groupBy("_host", "_path").agg(F.max(F.struct("verdict", "rule")).alias("r")).select("_host", "_path", "r.*")  # block comes after allow
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = rows.select("id", rest.alias("_rest")).withColumn("_raw", F.regexp_extract("_rest", "^[^/?#]*", 0))
    upper = "".join(map(chr, _LOWER))
    urls = split.select("id", F.translate("_raw", upper, upper.lower()).alias("host"), F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), "^[^?#]*", 0).alias("path"))
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))")
    fits = distinct.select("host", "path", F.explode(suffixes).alias("_host")).join(table.select("_host").distinct(), "_host", "left_semi")
    fits = fits.select("*", F.explode(F.expr("transform(sequence(0, length(path)), n -> left(path, n))")).alias("_path")).join(table, ["_host", "_path"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("_host") + F.length("_path")).alias("n"), F.length("_host").alias("h"), "rule", "verdict")).alias("b"))
    found = urls.join(best, ["host", "path"], "left")
    return found.select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(unlisted)).alias("verdict"))

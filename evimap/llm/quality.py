"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed rule.
Policies are versions of a mask over those bits, applied without touching the texts again, and ablations (how
many documents each policy rejects by one rule alone, or would keep without it) are counts over the masks.

Repeated windows: each document's windows of five words are hashed and sorted with their places packed into the
low bits, so that equal windows are neighbours; neighbours are compared by their words, so hashes only order.
A text in which two different windows share a hash is measured by sorting the windows themselves.

Defined results: a null or empty text has no words and fails the rule on length; a text of any length is one row;
equal rows give equal results; an empty table gives an empty ledger; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap.llm.common import SPACE, quoted

WINDOW = 5
#: Rules by bit, each true where a document fails it. The first two are the base rules.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols"),
    "v3": (*BASE, "many_symbols", "repeated_lines", "long_words", "short_words"),
}
CURRENT = "v3"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fence: bool = False) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", f"{SPACE}+"), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(id_col, "_text", "_words", F.size("_words").alias("_n"), F.size(lines).alias("_lines"), F.size(F.array_distinct(lines)).alias("_distinct_lines"))
    return rows.select(
        id_col,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_lines").cast("long").alias("n_lines"),
        (F.col("_lines") - F.col("_distinct_lines")).cast("long").alias("n_dup_lines"),
        _repeated_words().cast("long").alias("n_repeat_words"),
        # not deterministic to Spark: a filter above that uses it isn't pushed below, where it would measure anew for each rule
        *([F.spark_partition_id().alias("_part")] if fence else []),
    )


def _repeated_words() -> Column:
    """Words covered by windows that occur twice or more, from _words and _n."""
    same = f"shiftright(_s[i], _bits) = shiftright(_s[i + {{0}}], _bits)"
    place = "cast(_s[{}] & (shiftleft(1L, _bits) - 1) as int)"
    words = f"array_join(slice(_words, {{}} + 1, {WINDOW}), ' ')"
    here, after = words.format(place.format("i")), words.format(place.format("i + 1"))
    # neighbours with the same hash: 1 if their words agree, 2 if not
    pairs = f"""
        transform(sequence(0, size(_s) - 1), i -> case when i + 1 >= size(_s) or not ({same.format(1)}) then 0 when {here} = {after} then 1 else 2 end)
    """
    by_hash = f"""
        array_sort(transform(filter(sequence(0, size(_s) - 1), i -> _p[i] = 1 or (i > 0 and _p[i - 1] = 1)), i -> {place.format("i")}))
    """
    by_words = f"""
        array_sort(flatten(transform(filter(
            transform(_t, (x, i) -> struct(x.p as p, (i > 0 and _t[i - 1].w = x.w) or (i + 1 < size(_t) and _t[i + 1].w = x.w) as r)), x -> x.r), x -> array(x.p))))
    """
    covered = f"aggregate(transform(_at, (p, i) -> if(i + 1 < size(_at), least({WINDOW}, _at[i + 1] - p), {WINDOW})), 0, (a, x) -> a + x)"
    t = f"array_sort(transform(sequence(0, _n - {WINDOW}), i -> struct({words.format('i')} as w, i as p)))"

    def let(expr: str, **names: str) -> str:
        """expr with values that are computed once, by a lambda over an array of one."""
        for name, value in reversed(names.items()):
            expr = f"transform(array({value}), {name} -> {expr})[0]"
        return expr

    sorted_ = f"sort_array(transform(sequence(0, _n - {WINDOW}), i -> (shiftleft(xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]), _bits) | cast(i as bigint))))"
    at = f"if(exists(_p, x -> x = 2), {let(by_words.strip(), _t=t)}, {by_hash.strip()})"
    whole = let(covered, _bits="int(ceil(log2(_n + 1)))", _h="transform(_words, w -> xxhash64(w))", _s=sorted_, _p=pairs.strip(), _at=at)
    return F.expr(f"case when _n < {WINDOW + 1} then 0 else {whole} end")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fence: bool = False) -> DataFrame:
    """Measurements and failed_bits: bit k is set where rule k fails."""
    bits = " | ".join(f"if({rule}, {1 << k}L, 0L)" for k, rule in enumerate(RULES.values()))
    return measures(docs, id_col, text_col, fence).withColumn("failed_bits", F.expr(bits))


def verdicts(ledger_: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under one policy; whatever fails a base rule goes under any."""
    base, all_ = mask(BASE), mask(BASE) | mask(POLICIES[policy])
    return ledger_.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(all_)) == 0)


def ablations(ledger_: DataFrame) -> DataFrame:
    """policy, rule, rejected, alone: what each policy rejects by each rule, and what it rejects by that rule alone."""
    masks = ledger_.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    spark = ledger_.sparkSession
    rows = [(p, r, mask(rules), 1 << list(RULES).index(r)) for p, rules in POLICIES.items() for r in rules]
    table = F.broadcast(spark.createDataFrame(rows, "policy string, rule string, policy_mask long, bit long"))
    hit = masks.join(table, F.expr("failed_bits & bit <> 0"))
    return hit.groupBy("policy", "rule").agg(F.sum("n").alias("rejected"), F.sum(F.when(F.expr("failed_bits & policy_mask = bit"), F.col("n")).otherwise(0)).alias("alone"))


def keep_good(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those the policy rejects. The rules run on each row in place, without a join."""
    return (
        docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text_in"))
        .transform(lambda d: _measured_row(d))
        .transform(lambda d: verdicts(d, policy))
        .where("kept and _part >= 0")
        .select("_row.*")
    )


def _measured_row(d: DataFrame) -> DataFrame:
    inner = ledger(d.select(F.struct("_row", "_id").alias("_carried"), "_text_in"), "_carried", "_text_in", fence=True)
    return inner.withColumn("_row", F.col("_carried._row"))

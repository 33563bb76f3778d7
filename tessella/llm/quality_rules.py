"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, let, materialize, packed, words

SYMBOLS = "[#*$%&|<>]"
#: Words in a window of which repeats are counted.
WINDOW = 5
RULES = ("short", "repetitive", "symbol_heavy", "line_repeats")
#: A host fails a rule when its shrunk failure rate reaches this.
HOST_LIMIT = 0.5
#: Bounds for the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: equal hashes are neighbours once sorted, and each repeated
    window then adds its words that the next one doesn't begin with."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
        return F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"])

    def spread(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return let(F.sort_array(let(by_hash, repeated)), spread)


def repeat_words(w: Column) -> Column:
    """Number of words in windows of five words found twice or more in the same text."""
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def measures(text: Column) -> dict[str, Column]:
    """Columns computed from one text. A null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return {
        "word_chars": (F.length(whole) - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "_words": let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("rep"))),
    }


def base_rules(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep, the measures, base_failed and a boolean for each rule, for every document."""
    d = docs.select(*keep, *[c.alias(k) for k, c in measures(F.col(text)).items()])
    names = [c for c in d.columns if c not in ("word_chars", "n_symbols", "_lines", "_words")]
    d = d.select(
        *names, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.n").alias("n_lines"),
        F.col("_lines.dup").alias("n_dup_lines"), F.col("_words.rep").alias("n_repeat_words"),
    )
    return d.withColumns({
        "short": F.col("n_words") < 10,
        "repetitive": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbol_heavy": 10 * F.col("n_symbols") > F.col("word_chars"),
        "line_repeats": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }).withColumn("base_failed", F.col("short") | F.col("repetitive"))


def host_verdicts(base: DataFrame, host: str) -> DataFrame:
    """host, host_docs and host_rejected. For each rule, the hosts' failure rates give a beta prior by the method of
    moments (their variance less that of binomial draws); a host's rate is then (failed + mean * weight) / (docs +
    weight). Documents without a host belong to none."""
    sums = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    hosts = materialize(base.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), *sums))
    rate = {r: F.col(r) / F.col("host_docs") for r in RULES}
    m = hosts.agg(
        F.avg(1 / F.col("host_docs")).alias("inv"),
        *[f(rate[r]).alias(f"{r}_{k}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_samp))],
    ).first()
    bad = F.lit(False)
    for r in RULES:
        mean, var = m[f"{r}_mean"] or 0.0, m[f"{r}_var"] or 0.0
        between = var - mean * (1 - mean) * (m["inv"] or 0.0)
        weight = min(MOST_PRIOR, max(LEAST_PRIOR, mean * (1 - mean) / between - 1)) if between > 0 else MOST_PRIOR
        bad = bad | ((F.col(r) + mean * weight) / (F.col("host_docs") + weight) >= HOST_LIMIT)
    return hosts.select(host, "host_docs", bad.alias("host_rejected"))


def with_verdicts(base: DataFrame, host: str) -> DataFrame:
    """base with host_rejected; a host may hold any part of the documents."""
    return join_uneven(base, host_verdicts(base, host), host, "host_docs", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    host_rejected, kept. The text is read once; what follows works on the narrow measures.

    Null and empty texts have no words and fail. A very long text is measured whole, in time n log n of its words.
    Repeated rows are measured each for itself, and each counts for its host. A null host gives no host verdict. An empty
    table gives an empty result. Other columns are left out."""
    base = materialize(base_rules(docs, text, [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("_host")]))
    return with_verdicts(base, "_host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs, all columns, that pass. The rules are computed once: rows that pass those for texts are written
    beside their verdicts, and so are the others' verdicts, which count for their hosts. No text is shuffled."""
    rows = docs.select(packed(docs), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    ruled = base_rules(rows, "_text", [F.col("_row"), F.col("_host")])
    base = materialize(ruled.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "_host", "base_failed", *RULES))
    return with_verdicts(base, "_host").where(~F.col("base_failed") & ~F.col("host_rejected")).select("_row.*")

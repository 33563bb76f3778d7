"""Log-template tree: lines fall into leaves by token count and leading tokens, fields that vary become wildcards, and
templates that recur across documents stay in the first document only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_uneven, materialize, packed, release, row_keys

#: Tree depth below the token count: leading tokens that lines of a leaf share.
LEADING = 2
#: Documents that make a template recurring, and tokens that a line needs to have one.
MIN_DOCS, MIN_TOKENS = 3, 3
#: Lines of more tokens than LONG recur from LONG_DOCS documents on, as chance can't make two of them alike.
LONG, LONG_DOCS = 50, 2
#: Stretches that the tokens below the leading ones are cut into, single tokens in lines of up to LEADING + STRETCHES. Lines
#: of a leaf that differ in two stretches only are alike, so any two fields may vary, wherever they stand and however long
#: the line is; in lines of fewer than TWO_FIELDS tokens one may, in those of fewer than ONE_FIELD none.
STRETCHES, ONE_FIELD, TWO_FIELDS = 6, 4, 8
WILD = "<*>"


def masked_tokens(line: Column) -> Column:
    """The line's tokens, those with a digit as wildcards."""
    clean = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    masked = F.regexp_replace(clean, F.lit(r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"), F.lit(WILD))
    return F.split(F.when(clean.rlike("[0-9]"), masked).otherwise(clean), SPACES)


def needed(n: Column) -> Column:
    """Documents that make a template of n tokens recurring."""
    return F.when(n > LONG, LONG_DOCS).otherwise(MIN_DOCS)


def lines(docs: DataFrame, keep: list, text: Column) -> DataFrame:
    """keep, pos, n, template, leaf, stretches for each line of MIN_TOKENS tokens or more: n tokens, the hash of the masked
    line, that of its place in the tree, and those of its stretches."""
    own = docs.select(*keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    names = [c for c in own.columns if c not in ("pos", "line")]
    own = own.select(*names, "pos", masked_tokens(F.col("line")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    n, tokens = F.size("tokens"), F.col("tokens")
    parts = F.greatest(F.least(F.lit(STRETCHES), n - LEADING), F.lit(1))
    begin = lambda k: F.lit(LEADING) + F.floor((n - LEADING) * k / parts).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.hash(F.slice(tokens, begin(k) + 1, begin(k + 1) - begin(k))))
    return own.select(
        *names, "pos", n.alias("n"), F.xxhash64("tokens").alias("template"), F.xxhash64(n, F.slice(tokens, 1, LEADING)).alias("leaf"),
        F.when(n >= ONE_FIELD, stretches).otherwise(F.array().cast("array<int>")).alias("stretches"),
    )


def wildcards(n: Column, leaf: Column, stretches: Column) -> Column:
    """A hash for each choice of stretches that may vary: of the leaf, the choice, and the other stretches."""
    one, two = [(k, k) for k in range(STRETCHES)], list(combinations(range(STRETCHES), 2))
    choices = lambda pairs: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    fit = F.filter(F.when(n < TWO_FIELDS, choices(one)).otherwise(choices(two)), lambda m: m["j"] < F.size(stretches))
    rest = lambda m: F.transform(stretches, lambda x, k: F.when((k != m["i"]) & (k != m["j"]), x))
    return F.transform(fit, lambda m: F.xxhash64(leaf, m["i"], m["j"], rest(m)))


def thirds(leaf: Column, stretches: Column) -> Column:
    """Hashes of the leaf with each third of the stretches. Lines that differ in two stretches have a third in common."""
    return F.array(*[F.xxhash64(leaf, F.lit(k), F.slice(stretches, 2 * k + 1, 2)) for k in range(STRETCHES // 2)])


def templates(found: DataFrame) -> DataFrame:
    """template, first (the first document's key) and docs (those that hold it) of all that recur in found(doc, n, template,
    leaf, stretches), by themselves or with others of their leaf under wildcards. A document counts once, however many of
    the templates it holds. Of a template's documents the least and the greatest are carried along: if it has more than two
    it recurs anyway, and so do all that are alike. Wildcards are tried where several lines share a leaf, and a third of
    their stretches."""
    seen = found.groupBy("template", "doc").agg(F.min("leaf").alias("leaf"), F.min("n").alias("n"))
    t = materialize(seen.groupBy("template").agg(F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.count("*").alias("docs"), F.min("doc").alias("low"), F.max("doc").alias("high")))
    need = needed(F.col("n"))
    alone = t.where(F.col("docs") >= need).select("template", F.col("low").alias("first"))
    leaves = t.where(F.col("n") >= ONE_FIELD).groupBy("leaf", "n").agg(F.sum("docs").alias("d"), F.count("*").alias("k")).where((F.col("d") >= need) & (F.col("k") > 1)).select("leaf")
    several = materialize(t.join(leaves, "leaf", "left_semi"))
    hashes = found.select("template", "stretches").join(several.select("template"), "template", "left_semi").dropDuplicates(["template"])
    each = materialize(several.join(hashes, "template"))
    third = each.select("template", "docs", F.explode(thirds(F.col("leaf"), F.col("stretches"))).alias("third"))
    shared = third.groupBy("third").agg(F.count("*").alias("k")).where("k > 1").select("third")
    close = each.join(third.join(shared, "third", "left_semi").select("template").distinct(), "template", "left_semi")
    wild = materialize(close.select("template", "n", "docs", "low", "high", F.explode(wildcards(F.col("n"), F.col("leaf"), F.col("stretches"))).alias("general")))
    held = wild.select("general", "n", "docs", F.explode(F.array_distinct(F.array("low", "high"))).alias("doc"))
    groups = held.groupBy("general", "n").agg(F.max("docs").alias("most"), F.count_distinct("doc").alias("d"), F.min("doc").alias("first"))
    groups = groups.where(F.greatest("most", "d") >= need).select("general", "first")
    together = wild.select("template", "general").join(groups, "general").groupBy("template").agg(F.min("first").alias("first"))
    recurring = alone.unionByName(together).groupBy("template").agg(F.min("first").alias("first"))
    result = materialize(recurring.join(t.select("template", "docs"), "template"))
    release(t, several, each, wild)
    return result


def _dropped(keyed: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """_k1, _k2 and drop: places of the lines that go, for the documents that have any. A document is named by its id and
    _k1, half of its key."""
    found = materialize(lines(keyed, [F.struct(doc_id.alias("id"), "_k1").alias("doc"), "_k2"], text))
    lost = join_uneven(found.select("doc", "_k2", "pos", "template"), templates(found), "template", "docs").where(F.col("doc") != F.col("first"))
    dropped = materialize(lost.groupBy("doc._k1", "_k2").agg(F.sort_array(F.collect_set("pos")).alias("drop")))
    release(found)
    return dropped


def _cut(keyed: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    lost = _dropped(keyed, doc_id, text)
    every = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drop")), lambda i: F.get(F.col("_lines"), i))
    both = keyed.join(lost, ["_k1", "_k2"], "left").withColumn("_lines", F.when(F.col("drop").isNotNull(), every))
    return both.select(
        "_row", F.size(every).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("_text"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text without the lines whose template recurs: in MIN_DOCS
    documents or more, or LONG_DOCS if it has more than LONG tokens. The first document of those that hold a template, or
    one alike, (smallest id, nulls first) keeps its lines, so nothing is lost altogether. Documents that are added never
    bring a line back.

    A null text stays null and has one empty line. Lines of fewer than MIN_TOKENS tokens stay. A very long line is one
    line, however many tokens it has. Rows that repeat id and text are one document and are treated alike. A text of which
    every line goes is empty. An empty table gives an empty result; other columns are left out."""
    keyed = docs.select(*row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.struct(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).alias("_row"))
    return _cut(keyed, F.col("_row.doc_id"), F.col("_row.text")).select("_row.doc_id", "n_lines", "n_dropped", F.col("_text").alias("text"))


def keep_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs, all columns, with such lines cut from the text and n_chars counted anew. Documents whose text held words
    and has none left are dropped: all they had stands in other documents."""
    keyed = docs.select(*row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), packed(docs))
    cut = _cut(keyed, F.col("_row")[doc_id], F.col("_row")[text]).where((F.col("n_dropped") == 0) | (F.btrim("_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    new = {text: F.col("_text"), n_chars: F.when(F.col("n_dropped") == 0, F.col("_row")[n_chars]).otherwise(F.length("_text").cast("long")) if n_chars in docs.columns else None}
    return cut.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])

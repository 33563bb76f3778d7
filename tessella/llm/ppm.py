"""Prediction by partial matching: a trie of byte contexts, learned from the corpus, gives each text's probability. The
trie is two tables of all grams and contexts; its frequent grams are also held in memory, and all others joined."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

#: Bytes of context, and of a gram: its context and the byte that follows.
ORDER = 4
GRAM = ORDER + 1
#: A byte that no UTF-8 text holds: it stands before each text and ends it.
EDGE = 0xFF
#: A gram is looked up in memory if it makes up at least one in this many of all, so at most that many are, however large
#: the corpus is. All other grams are looked up by a join.
KEPT_SHARE = 2**21
#: Likewise for the words that are looked up in memory. All other words are looked up by a join.
FREQUENT_SHARE = 2**20
#: Grams or words that a task holds before it passes them on, and bytes of text taken at once.
HELD, BLOCK = 2_000_000, 1 << 20
ALPHA = 0.1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte and at the end of each text, and where each text's grams begin."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edge = bytes([EDGE] * ORDER)
    raw = np.frombuffer(b"".join(x for t in texts for x in (edge, t, edge[:1])), np.uint8).astype(np.int64)
    key = raw[:-ORDER]
    for k in range(1, GRAM):
        key = key << 8 | raw[k : len(raw) - ORDER + k]
    begins = np.cumsum(size) - size
    inside = np.ones(len(key), bool)
    between = (begins + ORDER * np.arange(len(texts)))[1:]  # grams that would span two texts
    for k in range(1, GRAM):
        inside[between - k] = False
    return key[inside], begins


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def learn(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n) and (word, n) over the texts of train(text binary), summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(words: Counter, held: list) -> Iterator[pa.RecordBatch]:
            keys, n = _merge(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words.keys(), *[None] * len(keys)], pa.binary()), pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(keys)]), pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(n)])],
                ["word", "gram", "n"],
            )

        for texts in _parts(batches):
            for t in texts:
                words.update(t.lower().split())
            words[b""] += len(texts)  # the end token, which no word equals
            held.append(np.unique(grams(texts)[0], return_counts=True))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_merge(held)]
            if len(words) > HELD or len(held[0][0]) > HELD:
                yield from out(words, held)
                words, held = Counter(), []
        yield from out(words, held)

    counted = materialize(train.select("text").mapInArrow(run, "word binary, gram long, n long"))
    return (
        counted.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")),
        counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")),
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts in lists of bounded length."""
    for b in batches:
        texts, size = [], 0
        for x in b.column("text"):
            texts.append(x.as_py() or b"")
            size += len(texts[-1])
            if size > BLOCK:
                yield texts
                texts, size = [], 0
        if texts:
            yield texts


class Table:
    """Places of keys, by hashing: the first key that falls on a slot stays there, the others go on to a next table."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, bits = [], np.arange(len(keys)), max(4, int(len(keys) * 4).bit_length())
        while len(left):
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.levels) + 1)) & (2**64 - 1) | 1)
            slot = self._slot(keys[left], factor, bits)
            own = np.full(1 << bits, -1, np.int64)
            own[slot[::-1]] = left[::-1]
            self.levels.append((factor, bits, np.where(own >= 0, keys[own], -1), own))
            left = left[own[slot] != left]
            bits = max(4, int(len(left) * 4).bit_length())

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked key, or -1."""
        out, todo = np.full(len(asked), -1, np.int64), None
        for factor, bits, keys, own in self.levels:
            q = asked if todo is None else asked[todo]
            slot = self._slot(q, factor, bits)
            hit = keys[slot] == q
            if todo is None:
                out, todo = np.where(hit, own[slot], -1), np.flatnonzero(~hit)
            else:
                out[todo[hit]] = own[slot[hit]]
                todo = todo[~hit]
        return out


class Cache:
    """The frequent grams, each with the log10 of its last byte's probability after its context."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.places, self.logp = Table(keys), np.append(logp, 0.0)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the sum over its frequent grams and the number of its other grams; and those grams."""
        gram, begins = grams(texts)
        at = np.concatenate([self.places.find(gram[k : k + BLOCK]) for k in range(0, len(gram), BLOCK)])
        missed = at < 0
        return np.add.reduceat(self.logp[at], begins), np.add.reduceat(missed.astype(np.int64), begins), gram[missed]


def low_bytes(gram: Column, k: Column | int) -> Column:
    """The last k bytes of a gram."""
    return F.get(F.array(*[gram.bitwiseAND(F.lit((1 << 8 * j) - 1).cast("long")) for j in range(GRAM + 1)]), F.lit(k) if isinstance(k, int) else k)


def each_length(found: DataFrame, *more: str) -> DataFrame:
    """more, k and gram: the last k bytes of each gram, for every k from 1 to GRAM."""
    return found.select(*more, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), low_bytes(F.col("gram"), k).alias("gram")) for k in range(1, GRAM + 1)])).alias("x")).select(*more, "x.*")


def tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie as two tables over all grams: k, gram, n of the grams of each length, where shorter grams are sums over
    the longer ones; and for each context (k, ctx; k - 1 bytes) what escapes with symbol exclusion need: den, the log of
    total + distinct bytes; leave, that of an escape from it; and, where the next shorter context is asked after that,
    den_below and leave_below, the same without the bytes seen here. No context has more than 256 grams."""
    n = materialize(each_length(counts, "n").groupBy("k", "gram").agg(F.sum("n").alias("n")))
    shorter = n.select((F.col("k") + 1).alias("k"), F.col("gram").alias("end"), F.col("n").alias("n_end"))
    seen = (
        n.withColumn("end", low_bytes(F.col("gram"), F.col("k") - 1)).join(shorter, ["k", "end"], "left")
        .groupBy("k", F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.sum("n_end").alias("n_ends"))
    )
    seen = materialize(seen)
    up = seen.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("end"), F.col("total").alias("up_total"), F.col("seen").alias("up_seen"))
    both = seen.withColumn("end", low_bytes(F.col("ctx"), F.greatest(F.col("k") - 2, F.lit(0)))).join(up, ["k", "end"], "left")
    below, rest = F.col("up_seen") - F.col("seen"), F.col("up_total") - F.col("n_ends")
    den, den_below = F.log10(F.col("total") + F.col("seen")), F.log10(F.greatest(rest + below, F.lit(1)))
    contexts = both.select(
        "k", "ctx", den.alias("den"), (F.log10("seen") - den).alias("leave"),
        den_below.alias("den_below"), F.when(below > 0, F.log10(below) - den_below).otherwise(0.0).alias("leave_below"),
    )
    return n, materialize(contexts)


def cache(n: DataFrame, contexts: DataFrame) -> Cache:
    """The grams that make up at least one in KEPT_SHARE of all; their probabilities are those of the full tables."""
    top = n.where(F.col("k") == GRAM)
    total = top.agg(F.sum("n")).first()[0] or 0
    often = top.where(F.col("n") * KEPT_SHARE >= total).withColumn("ctx", F.shiftright("gram", 8))
    t = often.join(contexts, ["k", "ctx"]).select("gram", (F.log10("n") - F.col("den")).alias("logp")).toArrow()
    return Cache(t.column(0).to_numpy(), t.column(1).to_numpy())


def resolve(missed: DataFrame, n: DataFrame, contexts: DataFrame) -> DataFrame:
    """gram and logp, log10 of its last byte after its context, for each different missed gram: from the longest known
    context, escaping to shorter ones; bytes that a longer context had seen are excluded from the shorter one's counts."""
    distinct = n.where("k = 1").count()
    each = each_length(missed.select(F.col("gram"), F.col("gram").alias("asked")).distinct(), "asked").withColumn("ctx", F.shiftright("gram", 8))
    # Few short grams and contexts stand in very many grams, so those are sent to the rows: 2**16 of each length at most.
    parts = [
        each.where("k < 3").join(F.broadcast(n.where("k < 3")), ["k", "gram"], "left").join(F.broadcast(contexts.where("k < 3")), ["k", "ctx"], "left"),
        each.where("k = 3").join(n.where("k = 3"), ["k", "gram"], "left").join(F.broadcast(contexts.where("k = 3")), ["k", "ctx"], "left"),
        each.where("k > 3").join(n.where("k > 3"), ["k", "gram"], "left").join(contexts.where("k > 3"), ["k", "ctx"], "left"),
    ]
    found = reduce(DataFrame.unionByName, parts)
    names = ("n", "den", "leave", "den_below", "leave_below")
    row = found.groupBy("asked").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, GRAM + 1) for c in names])
    unseen = F.lit(-math.log10(256 - distinct) if distinct < 256 else 0.0)
    escaped = [unseen]  # by length of the gram looked for: its cost after an escape from the context one byte longer
    for k in range(1, GRAM):
        escaped.append(F.when(F.col(f"n{k}").isNotNull(), F.log10(f"n{k}") - F.col(f"den_below{k + 1}")).otherwise(F.col(f"leave_below{k + 1}") + escaped[-1]))
    logp = unseen
    for k in range(1, GRAM + 1):
        here = F.when(F.col(f"n{k}").isNotNull(), F.log10(f"n{k}") - F.col(f"den{k}")).otherwise(F.col(f"leave{k}") + escaped[k - 1])
        logp = F.when(F.col(f"den{k}").isNotNull(), here).otherwise(logp)
    return row.select(F.col("asked").alias("gram"), logp.alias("logp"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trie and word counts come from all texts whose fold is not 0. A null text is empty: it has the end token only, and
    its score is the end's probability. A null id's fold is that of the empty text. Repeated rows are learned from and
    scored each for itself. Without training texts every byte has probability 1/256 and base_score is 0. A very long text
    is scored whole, in blocks of documents of bounded length. No gram is dropped: a gram too rare for the memory of the
    tasks is looked up in the tables, with the same result. An empty table gives an empty result; other columns are left
    out."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (fold(F.col(f"`{doc_id}`"), folds) == 0).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    counts, vocabulary = learn(own.where("NOT held_out"))
    vocabulary = materialize(vocabulary)
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = vocabulary.where(F.col("n") * FREQUENT_SHARE >= n).toArrow()
    logs = np.log10(often.column("n").to_numpy() + ALPHA) if often.num_rows else np.zeros(0)
    n_grams, contexts = tables(counts)
    model = spark.sparkContext.broadcast((cache(n_grams, contexts), dict(zip(often.column("word").to_pylist(), logs.tolist(), strict=True))))
    ends = vocabulary.where(F.col("word") == F.lit(b"")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    end_log = math.log10(ends + ALPHA)
    each = math.log10(n + ALPHA * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, known = model.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            missed, ends_at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for texts in _parts(iter([b])):
                for t in texts:
                    w = t.lower().split()
                    cols[0].append(len(w) + 1)
                    logs = list(map(known.get, w))
                    rare = [x for x, p in zip(w, logs, strict=True) if p is None]
                    cols[1].append(len(w) - len(rare) + (ends > 0))
                    cols[2].append(math.fsum(filter(None, logs)) + end_log)
                    cols[3].append(rare)
                score, n_missed, others = often.score(texts)
                cols[4] += score.tolist()
                ends_at.append(ends_at[-1][-1] + np.cumsum(n_missed))
                missed.append(others)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.float64()]
            grams_of = pa.ListArray.from_arrays(pa.array(np.concatenate(ends_at), pa.int32()), pa.array(np.concatenate(missed)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b.num_rows)), b.column("doc_id"), b.column("held_out"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), grams_of],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "score", "grams"],
            )
            row += b.num_rows

    schema = own.select(F.lit(0).cast("long").alias("row"), "doc_id", "held_out", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.array(F.lit(b"")).alias("rare"), F.lit(0.0).alias("score"), F.array(F.lit(0).cast("long")).alias("grams")).schema
    scored = materialize(own.mapInArrow(run, schema))
    rare = scored.select("row", F.explode("rare").alias("word")).join(vocabulary.where(F.col("n") * FREQUENT_SHARE < n), "word", "left")
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.log10(c + F.lit(ALPHA))).alias("more"), F.count("n").alias("n_more"))
    missed = scored.select("row", F.explode("grams").alias("gram"))
    costs = missed.join(materialize(resolve(missed, n_grams, contexts)), "gram").groupBy("row").agg(F.sum("logp").alias("cost"))
    return scored.drop("rare", "grams").join(sums, "row", "left").join(costs, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("cost", F.lit(0.0))).alias("score"),
    )

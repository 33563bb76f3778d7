"""Benchmark decontamination: rare n-gram seeds lead from documents to test items, and Smith-Waterman alignment of words
tells copies, edited ones too, from chance.

A seed is an ordered pair of words with at most one word between them. No alignment at the threshold is without seeds:
with m matched words, p points and e errors (a word changed, added or left out costs one point), p = 2m - e. Of its m - 1
neighbouring matches, those with two errors or more between them number at most e / 2, so at least p / 2 - 1 are seeds,
at different words of the item and of the text, within 3n - p words of the text for an item of n words. Therefore all
but the last few of an item's p / 2 - 1 most common words to begin a seed can be left out: an alignment still has as few of
the others, the rare ones. These name candidates; those with fewer seeds than an alignment needs, or with too few words in
common, are left out; the rest are aligned. Nothing at the threshold is lost by that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, row_keys

#: Alignment points; a score is the points as a share of those that a verbatim copy gets.
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
#: Points that an alignment needs at least, or those of a verbatim copy if an item has fewer: short items share a few words
#: with many texts.
LEAST = 12
#: Rare seeds that a candidate must show, or all that an alignment needs if it needs fewer.
RARE = 3
#: Items, and bytes of items, that are sent to the tasks at once. A larger benchmark is worked through in blocks, each
#: against all documents.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16_000_000
#: Bits of a word's number in a seed.
BITS = 31
#: Words compared at once in an alignment.
CELLS = 1 << 20
#: Documents and bytes taken at once.
DOCS, BYTES = 512, 4_000_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: bytes | None) -> list[bytes]:
    """Words without ASCII punctuation and letter case."""
    return (text or b"").lower().translate(None, _PUNCTUATION).split()


def needed(n: np.ndarray) -> np.ndarray:
    """Points that an alignment with an item of n words must have."""
    return np.maximum(np.ceil(THRESHOLD * MATCH * n - 1e-9).astype(np.int64), np.minimum(MATCH * n, LEAST))


def seeds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each seed of a run of word numbers begins, and its number. 0 is no word and ends what stands before it."""
    found = []
    for d in (1, 2):
        at = np.flatnonzero((flat[:-d] > 0) & (flat[d:] > 0))
        found.append((at, flat[at] << BITS | flat[at + d]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def end_to_end(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, two zeros after each, and where each begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    begins = np.cumsum(size) - size
    return np.concatenate([x for t in texts for x in (t, np.zeros(2, np.int64))] or [np.zeros(0, np.int64)]), begins


def expand(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of at, the places first[at] up to first[at + 1], and which of at they are of."""
    n = first[at + 1] - first[at]
    of = np.repeat(np.arange(len(at)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at][of], of


class Items:
    """A block of test items, its words as numbers from 1, and its seeds."""

    def __init__(self, ids: pa.Array, texts: list[bytes | None]):
        split = [(k, w) for k, t in enumerate(texts) if (w := words(t))]
        self.ids = ids.take(pa.array([k for k, _ in split], pa.int64()))
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int64) for _, w in split]
        n = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.points = needed(n)
        self.seeds_needed, self.span = -(-self.points // MATCH) - 1, 3 * n - self.points
        flat, begins = end_to_end(self.words)
        at, key = seeds(flat)
        item = np.searchsorted(begins, at, side="right") - 1
        pairs = np.unique(np.stack((key, item)), axis=1) if len(key) else np.zeros((2, 0), np.int64)
        held = np.unique(pairs[0], return_counts=True)
        self.seeds = held[0]
        common = np.zeros(len(flat), np.int64)
        np.maximum.at(common, at, held[1][np.searchsorted(held[0], key)])
        # Of each item the seeds at its rarest words: all words but as many as an alignment's seeds less those it must show.
        self.rare_needed = np.minimum(self.seeds_needed, RARE)
        starts = np.unique(at)
        of = np.searchsorted(begins, starts, side="right") - 1
        starts = starts[np.lexsort((-common[starts], of))]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        rare = np.zeros(len(flat), bool)
        rare[starts[place >= (self.seeds_needed - self.rare_needed)[of]]] = True
        own = np.unique(np.stack((key, item))[:, rare[at]], axis=1) if len(key) else pairs
        self.rare, self.rare_first = np.unique(own[0], return_index=True)
        self.rare_first, self.rare_item = np.append(self.rare_first, len(own[0])), own[1]
        order = np.lexsort((pairs[0], pairs[1]))
        self.item_seeds, self.item_first = pairs[0][order], np.searchsorted(pairs[1][order], np.arange(len(self.words) + 1))
        alone = np.flatnonzero(n == 1)
        word = np.array([self.words[k][0] for k in alone], np.int64)
        order = np.argsort(word, kind="stable")
        self.alone_item = alone[order]
        self.alone, self.alone_first = np.unique(word[order], return_index=True)
        self.alone_first = np.append(self.alone_first, len(word))

    def numbers(self, text: bytes | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(x, 0) for x in words(text)], np.int64)

    def windows(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(item, document, begin, end): runs of a document's words outside which no alignment at the threshold goes."""
        flat, begins = end_to_end(texts)
        if len(self.alone) and len(flat):
            which = np.minimum(np.searchsorted(self.alone, flat), len(self.alone) - 1)
            at = np.flatnonzero(self.alone[which] == flat)
            place, of = expand(self.alone_first, which[at])
            doc = np.searchsorted(begins, at[of], side="right") - 1
            yield from zip(self.alone_item[place].tolist(), doc.tolist(), (at[of] - begins[doc]).tolist(), (at[of] - begins[doc] + 1).tolist(), strict=True)
        at, key = seeds(flat) if len(flat) > 2 else (np.zeros(0, np.int64),) * 2
        if not len(self.rare) or not len(at):
            return
        known = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
        known = self.seeds[known] == key
        at, key = at[known], key[known]
        order = np.argsort(at, kind="stable")
        at, key = at[order], key[order]
        which = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
        hit = np.flatnonzero(self.rare[which] == key) if len(key) else at
        place, of = expand(self.rare_first, which[hit])
        doc = np.searchsorted(begins, at[hit[of]], side="right") - 1
        pair, where = doc * len(self.words) + self.rare_item[place], at[hit[of]]
        order = np.lexsort((where, pair))
        pair, where = pair[order], where[order]
        fresh = np.concatenate(([True], (pair[1:] != pair[:-1]) | (where[1:] != where[:-1])))[: len(pair)]
        pair, where = pair[fresh], where[fresh]
        item = pair % len(self.words)
        ahead = np.arange(len(pair)) + self.rare_needed[item] - 1
        inside = np.flatnonzero(ahead < len(pair))
        ahead = ahead[inside]
        inside = inside[(pair[ahead] == pair[inside]) & (where[ahead] - where[inside] < self.span[item[inside]])]
        for found in np.unique(pair[inside]).tolist():
            d, i = divmod(found, len(self.words))
            low, high = np.searchsorted(at, (begins[d], begins[d] + len(texts[d])))
            mine = self.item_seeds[self.item_first[i] : self.item_first[i + 1]]
            own = key[low:high]
            own = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own) + low
            p = at[own]
            p = p[np.concatenate(([True], p[1:] != p[:-1]))] - begins[d]  # in order, so this is unique
            c, span = int(self.seeds_needed[i]), int(self.span[i])
            first = p[: max(0, len(p) - c + 1)]
            last = p[c - 1 :]
            near = last - first < span
            if near.any():
                a, b = np.maximum(last[near] - span, 0), np.minimum(first[near] + span + 2, len(texts[d]))
                fresh = np.concatenate(([True], a[1:] > np.maximum.accumulate(b)[:-1]))
                ends = np.append(np.flatnonzero(fresh)[1:], len(a)) - 1
                for x, y in zip(a[fresh].tolist(), np.maximum.accumulate(b)[ends].tolist(), strict=True):
                    yield i, d, x, y


def bound(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """No alignment of the item with a row of texts has more points: a word of the text that the item lacks costs a
    mismatch or a gap, any other is a match at best."""
    held = np.zeros(max(int(texts.max(initial=0)), int(item.max(initial=0))) + 2, bool)
    held[item] = True
    gain = np.cumsum(np.where(held[texts], MATCH, max(MISMATCH, GAP)), axis=1)
    gain = np.concatenate((np.zeros((len(texts), 1), gain.dtype), gain), axis=1)
    return (gain - np.minimum.accumulate(gain, axis=1)).max(axis=1)


def align(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with each row of texts: points, and begin and end of the best local alignment.

    Points are held in the upper half of each number and the alignment's begin in the lower, so both travel together.
    A row's gaps are a running maximum, as every gap costs the same."""
    n = texts.shape[1]
    places = np.arange(n + 1, dtype=np.int64)
    fresh, slope = places[None, :], -GAP * (places << 32)[None, :]
    row = np.repeat(fresh, len(texts), axis=0)
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for x in item.tolist():
        step = np.where(texts == x, MATCH, MISMATCH).astype(np.int64) << 32
        new = np.maximum(row + (GAP * (1 << 32)), fresh)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.maximum(row, fresh)
        at = row.argmax(axis=1)
        value = row[np.arange(len(row)), at]
        better = value >> 32 > best >> 32
        best, end = np.where(better, value, best), np.where(better, at, end)
    return best >> 32, best & 0xFFFFFFFF, end


def _aligned(items: Items, docs: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, begin, end) of the best alignment of each pair that reaches the threshold."""
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i, *where in items.windows(docs):
        by_item.setdefault(i, []).append(tuple(where))
    for i, found in by_item.items():
        item, least = items.words[i], int(items.points[i])
        found.sort(key=lambda x: x[2] - x[1])
        k = 0
        while k < len(found):
            n = 1
            while k + n < len(found) and (n + 1) * (found[k + n][2] - found[k + n][1]) <= CELLS:
                n += 1
            part = found[k : k + n]
            k += n
            texts = np.full((n, max(e - b for _, b, e in part)), -1, np.int64)
            for row, (d, b, e) in zip(texts, part, strict=True):
                row[: e - b] = docs[d][b:e]
            may = np.flatnonzero(bound(item, texts) >= least)
            if not len(may):
                continue
            points, begin, end = align(item, texts[may])
            for j, p, x, y in zip(may.tolist(), points.tolist(), begin.tolist(), end.tolist(), strict=True):
                d, b, _ = part[j]
                score = p / (MATCH * len(item))
                was = best.get((d, i), (0.0, 0, 0))
                if p >= least and (score > was[0] or score == was[0] and b + x < was[1]):
                    best[d, i] = (score, b + x, b + y)
    return [(d, i, *x) for (d, i), x in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    rows = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct()
        t = own.select("id", "text").toArrow()
        yield Items(t.column("id").combine_chunks(), t.column("text").to_pylist())


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded length."""
    at = size = 0
    for k, x in enumerate(b.column("_text")):
        if k - at >= DOCS or size > BYTES:
            yield b.slice(at, k - at)
            at, size = k, 0
        size += len(x.as_buffer()) if x.is_valid else 0
    yield b.slice(at)


def _matches(docs: DataFrame, keep: list, text, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """keep, item_id, score, begin_word, end_word for all pairs at or above the threshold; one pass over docs for each
    block of the benchmark."""
    spark = docs.sparkSession
    own = docs.select(*keep, text.cast("binary").alias("_text"))
    names = own.columns[:-1]
    found = None
    for items in _blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for b in (part for whole in batches for part in _parts(whole)):
                rows = _aligned(items, [items.numbers(t.as_py()) for t in b.column("_text")])
                if rows:
                    d, i, score, begin, end = zip(*rows, strict=True)
                    at = pa.array(d, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(x).take(at) for x in names), items.ids.take(pa.array(i, pa.int64())), pa.array(score), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        [*names, "item_id", "score", "begin_word", "end_word"],
                    )

        kind = benchmark.schema[item_id].dataType
        schema = own.select(*names, F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("begin_word"), F.lit(0).cast("long").alias("end_word")).schema
        part = own.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that align at THRESHOLD of the item's points or more, and at LEAST points
    or a verbatim copy: doc_id, item_id, score, begin_word, end_word (the alignment's words in the document, counted
    without punctuation). All such pairs are found.

    Null and blank texts and items match nothing. A very long text is searched whole; only the runs of it that hold
    enough of an item's seeds are aligned. Repeated rows match each for itself, repeated items once. Of equally good
    alignments of a pair one is given, the same in every run. Item ids may be of any type. Empty tables give an empty result; other
    columns are left out."""
    return _matches(docs, [F.col(f"`{doc_id}`").alias("doc_id")], F.col(f"`{text}`"), benchmark, item_id, item_text)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that match no test item."""
    keyed = docs.select(*row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), packed(docs))
    found = materialize(_matches(keyed, ["_k1", "_k2"], F.col("_row")[text], benchmark, item_id, item_text).select("_k1", "_k2").distinct())
    return keyed.join(found, ["_k1", "_k2"], "left_anti").select("_row.*")

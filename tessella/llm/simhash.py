"""SimHash near-duplicates: fingerprints, links found in BK-trees of fingerprint shards, components, one kept of each.

No tree goes through the driver: a shard's rows reach a task by shuffle, and the task builds their tree. Shards are named
such that linked rows share one. For a small radius they are blocks of the fingerprint's bits: radius differing bits leave
SHARED of radius + SHARED blocks equal, so no link is lost. Texts that share 0.8 of their shingles may differ in over 14 of
64 bits, which blocks can't bound; there shards are named by the texts' MinHash bands, the trees are searched within a
larger radius, and what they give is checked on the shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import join_uneven, materialize, packed, release, row_keys

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A fingerprint's bits fall into radius + SHARED blocks. radius differing bits leave at least SHARED blocks equal, so
#: two linked fingerprints share at least one shard, named by a choice of SHARED blocks and their bits.
SHARED = 2
#: For one document of each group: words of a shingle, and the share of common shingles that two texts need.
KEEP_SHINGLE, KEEP_SIMILARITY = 5, 0.8
#: MinHash values of a text, as BANDS of ROWS each. Two texts with the share 0.8 have no band in common with a probability of
#: (1 - 0.8 ** 4) ** 16 = 0.0002, and with the share 0.2 they have one with 0.025.
BANDS, ROWS = 16, 4
#: Differing bits up to which texts are compared. At the share 0.8 about 9.7 of 64 bits differ, with a deviation of 2.9.
KEEP_RADIUS = 20
#: A shard of more fingerprints than this is cut into trees of about this many, each asked by all parts of the shard.
TREE_SIZE = 20_000
#: A shard's size, which only decides how many trees it is cut into, is taken from one in so many fingerprints.
SIZE_RATE = 16
#: Pairs of query and node held at once.
FRONTIER = 500_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of shingle words, repeats included; of all words if there are fewer, of nothing if none."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(view[a:b], SEED) for a, b in spans), dtype="<u8", count=len(w) - shingle + 1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64, as a signed 64-bit number; no words: zero."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[Column | str], text: Column, shingle: int = SHINGLE) -> DataFrame:
    """keep and fp for every row; a null text has no words."""
    own = docs.select(*keep, text.cast("binary").alias("_text"))
    names = [c for c in own.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(x.as_py(), shingle) for x in b.column("_text")), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), fps], [*names, "fp"])

    schema = own.select(*names).withColumn("fp", F.lit(0).cast("long")).schema
    return own.mapInArrow(run, schema)


def shards(nodes: DataFrame, radius: int = RADIUS, shared: int = SHARED) -> DataFrame:
    """fp and shard, for each shard that may hold a neighbour of the fingerprint."""
    blocks = radius + shared
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), shared):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    names = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(names).alias("shard"))


def build_trees(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each run of equal group numbers. Returns the root of each row's tree, the children's keys
    (parent * 65 + distance to the parent) in order, and the child of each key. All trees grow a level at a time: of
    the rows that stand at a node with the same distance, the first becomes its child and the others go on below it."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    root = np.repeat(first, np.diff(np.concatenate((first, [len(group)]))))
    waiting = np.flatnonzero(root != np.arange(len(group)))
    at, keys, children = root[waiting], [], []
    while len(waiting):
        key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
        found, where, back = np.unique(key, return_index=True, return_inverse=True)
        child = waiting[where]
        keys.append(found)
        children.append(child)
        at = child[back]
        left = at != waiting
        waiting, at = waiting[left], at[left]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def search(fp: np.ndarray, tree: list, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs within the radius. From a node at distance d only edges from d - radius to d + radius are
    followed; the frontier is worked through in parts of bounded size."""
    keys, children = tree
    todo = [(queries[k : k + 2048], roots[k : k + 2048]) for k in range(0, len(queries), 2048)]
    while todo:
        q, node = todo.pop()
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield q[near], node[near]
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right") - lo
        has = n > 0
        q, lo, n = q[has], lo[has], n[has]
        total = np.cumsum(n)
        while len(n):
            upto = max(1, int(np.searchsorted(total, FRONTIER, side="right")))
            part = n[:upto]
            offset = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            todo.append((np.repeat(q[:upto], part), children[np.repeat(lo[:upto], part) + offset]))
            q, lo, n = q[upto:], lo[upto:], n[upto:]
            total = np.cumsum(n)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a and b pairwise; the smallest row of a set is its root."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _pairs(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different rows in a run of one group with at most radius differing bits. Rows of side 0 make up the
    group's tree and ask it too, rows of side 1 only ask it, rows of side 2 only make it up."""
    rows = np.flatnonzero(side != 1)
    if len(rows):
        root, *tree = build_trees(group[rows], fp[rows])
        roots = np.unique(root)
        asks = np.flatnonzero(side != 2)
        at = np.minimum(np.searchsorted(group[rows][roots], group[asks]), len(roots) - 1)
        own = group[rows][roots][at] == group[asks]
        asks, start = asks[own], roots[at[own]]
        both = np.concatenate((fp[rows], fp[asks]))
        for q, node in search(both, tree, np.arange(len(asks)) + len(rows), start, radius):
            a, b = asks[q - len(rows)], rows[node]
            yield a[a != b], b[a != b]


def _link(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of each row to the first of its set, among rows in runs of a group."""
    parent = np.arange(len(fp))
    for a, b in _pairs(group, fp, side, radius):
        parent = unite(parent, a, b)
    hit = np.flatnonzero(parent != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[hit].view(np.int64)), pa.array(fp[parent[hit]].view(np.int64))], ["a", "b"])


def _trees(members: DataFrame, radius: int, task: Callable[..., pa.RecordBatch], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What task makes of the groups of members(fp, shard, parts, more): a shard's tree with all rows that ask it. A shard
    that has parts is cut into so many trees, each of which is asked by every part, once for two parts."""
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    own = F.transform(F.sequence(part, F.col("parts") - 1), lambda j: F.struct(part.alias("tree"), j.alias("asks"), F.when(j == part, 0).otherwise(2).alias("side")))
    asked = F.when(part > 0, F.transform(F.sequence(F.lit(0), part - 1), lambda i: F.struct(i.alias("tree"), part.alias("asks"), F.lit(1).alias("side")))).otherwise(
        F.array().cast("array<struct<tree:int,asks:int,side:int>>")
    )
    alone = F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("asks"), F.lit(0).alias("side")))
    whole = F.col("parts").isNull()
    spread = (
        members.select("fp", "shard", "parts", *more, F.explode(F.when(whole, alone).otherwise(F.concat(own, asked))).alias("x"))
        .select("fp", F.when(whole, F.col("shard")).otherwise(F.xxhash64("shard", "x.tree", "x.asks")).alias("g"), "x.side", *more)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        made = lambda g, fp, side, *rest: task(g, fp, side, radius, *rest)
        for b in batches:
            fp, g, side, *rest = (b.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "g", "side", *more))
            if not len(g):
                continue
            held.append((g, fp.view(np.uint64), side, *rest))
            rows = sum(len(x[0]) for x in held)
            if rows < 50_000 or held[0][0][0] == g[-1]:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(columns[0] != g[-1])[-1]) + 1  # the last group may go on in the next batch
            yield made(*(x[:cut] for x in columns))
            held = [tuple(x[cut:] for x in columns)]
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return spread.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, schema)


def links(nodes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, shared: int = SHARED) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all fingerprints with at most radius differing bits: in each
    shard every linked fingerprint is tied to the first of its local set, so there are fewer links than rows."""
    sized = shards(nodes.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(SIZE_RATE)) == 0), radius, shared).groupBy("shard").count()
    large = materialize(sized.withColumn("n", F.col("count") * SIZE_RATE).where(F.col("n") > tree_size)
                        .select("shard", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")))
    return _trees(shards(nodes, radius, shared).join(large, "shard", "left"), radius, _link, "a long, b long")


#: Odd factors that make BANDS * ROWS hashes of one.
_FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(different: np.ndarray) -> np.ndarray:
    """One number for each band: of its ROWS least values among a text's shingle hashes, each multiplied by a factor."""
    if not len(different):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(different), 4096):
        part = different[at : at + 4096]
        part = part ^ part >> np.uint64(31)
        np.minimum(low, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=low)
    low = (low ^ low >> np.uint64(29)).reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        value = (value ^ low[:, k]) * _FACTORS[k]
        value ^= value >> np.uint64(32)
    return value.view(np.int64)


def sketches(docs: DataFrame, keep: list[Column | str], text: Column, shingle: int) -> DataFrame:
    """keep, fp, n (different shingles) and bands for every row."""
    own = docs.select(*keep, text.cast("binary").alias("_text"))
    names = [c for c in own.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, found = [], [], []
            for x in b.column("_text"):
                hashes = shingle_hashes(x.as_py(), shingle)
                different = np.unique(hashes)
                fps.append(of_hashes(hashes))
                sizes.append(len(different))
                found.append(bands(different))
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), parts], [*names, "fp", "n", "bands"])

    schema = own.select(*names).withColumns({"fp": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "bands": F.array(F.lit(0).cast("long"))}).schema
    return own.mapInArrow(run, schema)


def meetings(nodes: DataFrame) -> DataFrame:
    """shard, fp, n, lead, lead_n of nodes(fp, n, bands) for each band that two or more have; lead is the lowest of them."""
    rows = nodes.select("fp", "n", F.explode("bands").alias("shard"))
    leads = materialize(rows.groupBy("shard").agg(F.min(F.struct("fp", "n")).alias("x"), F.count("*").alias("count")).where("count > 1"))
    return join_uneven(rows, leads, "shard", "count").select("shard", "fp", "n", F.col("x.fp").alias("lead"), F.col("x.n").alias("lead_n"))


def _apart(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, n: np.ndarray, root: np.ndarray, similarity: float) -> pa.RecordBatch:
    """Pairs of a group within the radius whose classes differ and whose numbers of shingles allow the similarity."""
    found = [np.zeros((2, 0), np.int64)]
    for a, b in _pairs(group, fp, side, radius):
        may = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6)
        a, b = fp[a[may]].view(np.int64), fp[b[may]].view(np.int64)
        found.append(np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1))
    return pa.RecordBatch.from_arrays(list(map(pa.array, np.unique(np.concatenate(found, axis=1), axis=1))), ["a", "b"])


def similar(nodes: DataFrame, met: DataFrame, check: Callable[[DataFrame], DataFrame], similarity: float, tree_size: int) -> DataFrame:
    """Pairs (a, b) that connect all alike ones of nodes that met; check keeps the alike of given pairs.

    Of those that meet in a shard each is first compared with the lowest. Then the BK-tree of every shard that holds several
    classes yet is searched for pairs of different classes, and these are compared. So a large group of near copies takes
    few comparisons, and no pair within the radius is left out."""
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= KEEP_RADIUS
    fits = F.least("n", "lead_n") >= F.greatest("n", "lead_n") * F.lit(similarity) - F.lit(1e-6)
    tried = materialize(met.where((F.col("fp") != F.col("lead")) & near & fits).select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct())
    sure = materialize(check(tried))
    of = components(sure)
    classed = materialize(met.select("shard", "fp", "n").join(of, F.col("fp") == F.col("node"), "left").select("shard", "fp", "n", F.coalesce("root", "fp").alias("root")))
    open_ = classed.groupBy("shard").agg((F.min("root") != F.max("root")).alias("open"), F.count("*").alias("count")).where("open")
    left = materialize(classed.join(open_.select("shard", F.when(F.col("count") > tree_size, F.ceil(F.col("count") / tree_size).cast("int")).alias("parts")), "shard"))
    pairs = _trees(left, KEEP_RADIUS, lambda *x: _apart(*x, similarity), "a long, b long", ("n", "root")).distinct().join(tried, ["a", "b"], "left_anti")
    return sure.unionByName(check(materialize(pairs)))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """fp and own, the different shingles of texts(fp, _text), told apart by 32 bits of their XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (np.unique(shingle_hashes(x.as_py(), shingle).astype("<u4")).tobytes() for x in b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(sets, pa.binary())], ["fp", "own"])

    return texts.mapInArrow(run, "fp long, own binary")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets(fp, own) share at least that part of their shingles."""
    both = (
        pairs.join(sets.withColumnsRenamed({"fp": "a", "own": "x"}), "a").select("a", "b", "x")
        .join(sets.withColumnsRenamed({"fp": "b", "own": "y"}), "b").select("a", "b", "x", "y")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            kept = []
            for x, y in zip(r.column("x"), r.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype="<u4") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similarity * (len(x) + len(y) - common))
            yield r.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node with an edge, by alternating large and small stars.
    Each step only takes minima over a node's neighbours, so that a node with very many of them is summed in parts. A
    round is one job, which also sums what it writes: when nothing changes, every node is tied to its root."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        seen = Observation()
        after = materialize(small.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        release(e)
        e, now = after, (seen.get["n"], seen.get["h"])
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def classes(marked: DataFrame, linker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fp, root (the smallest fingerprint of the class) and component_id (its smallest id, nulls aside) for every
    distinct fp of marked(id, fp), linked by the pairs (a, b) that linker gives for the distinct fingerprints."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("id")))
    roots = materialize(components(linker(nodes)))
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    of = linked.join(lowest, "root").select("node", "root", "component_id")
    return nodes.join(of, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and blank texts have fingerprint zero and link like any other. Repeated rows share their component. A
    component whose ids are all null has a null component_id. An empty table gives an empty result; other columns are
    left out."""
    marked = materialize(fingerprints(docs, [F.col(doc_id).alias("id")], F.col(text)))
    of = materialize(classes(marked, lambda nodes: links(nodes, radius, tree_size)).drop("root"))
    return marked.join(of, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = KEEP_SIMILARITY, shingle: int = KEEP_SHINGLE, tree_size: int = TREE_SIZE) -> DataFrame:
    """The rows of docs, all columns, without those that another row of their group makes superfluous.

    A group is what links connect. Texts of equal fingerprints are linked (blank and null ones too); others, if they share
    that part of their different shingles, which is checked on the whole texts, however long they are. They are found if a
    MinHash band is equal and at most KEEP_RADIUS bits differ; of pairs at the similarity itself about one in 2,000 is
    missed by that. The row with the group's smallest id stays (a null id comes last); of rows that share it, the one whose
    key hashes lowest, and one of repeated rows. An empty table stays empty."""
    keyed = docs.select(*row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), packed(docs))
    marked = materialize(sketches(keyed, ["_k1", "_k2", F.col("_row")[doc_id].alias("id")], F.col("_row")[text], shingle))
    shown = materialize(marked.groupBy("fp").agg(F.min(F.struct("_k1", "_k2", "n", "bands")).alias("k")).select("fp", "k.*"))
    met = materialize(meetings(shown))
    used = shown.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", "_k1", "_k2")
    texts = keyed.join(used, ["_k1", "_k2"]).select("fp", F.col("_row")[text].cast("binary").alias("_text"))
    sets = materialize(shingle_sets(texts, shingle).dropDuplicates(["fp"]))
    of = classes(marked.select("id", "fp"), lambda nodes: similar(shown, met, lambda pairs: materialize(alike(pairs, sets, similarity)), similarity, tree_size)).select("fp", "root")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_k1", "_k2")
    first = materialize(marked.join(of, "fp").groupBy("root").agg(F.min(order).alias("k")).select("k._k1", "k._k2"))
    release(shown, met, sets)
    # Repeated rows go before they meet in a task.
    return keyed.dropDuplicates(["_k1", "_k2"]).join(first, ["_k1", "_k2"], "left_semi").select("_row.*")

import math
import random
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import decontaminate, line_dedup, packing, ppm, quality_classifier, quality_rules, queries, revisits, sharding, simhash, token_counts

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "Lorem ipsum dolor sit amet consectetur 7 adipiscing elit. " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1),
    (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some text without an id at all, ten words long it is", "en", "b", 5), (None, None, None, "b", None),
    (4, " \t\n\x0b\f\r", "en", "b", 6), (5, LONG, "la", "a", len(LONG)), (5, "same id, other text", "en", None, 19), (6, "ünïcode Ünïcode <|endoftext|> İstanbul ﬁ 👍　x", "tr", "c", 9),
    (7, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1), (8, "a\n\nb\n\n\nc  d   e\t\tf", "en", "c", 9), (9, "x" * 3000, "en", "c", 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in ("_row", "_k1", "fp", "id", "words", "row", "part", "word", "n", "host_docs", "score", "drop")})


OPERATORS = {
    "op1": lambda d, b, y: quality_rules.score_documents(d),
    "op2": lambda d, b, y: quality_classifier.score_documents(d, y),
    "op3": lambda d, b, y: token_counts.count_tokens(d, WORD),
    "op4": lambda d, b, y: sharding.shard_documents(d),
    "op7": lambda d, b, y: line_dedup.dedup_lines(d),
    "op8": lambda d, b, y: simhash.near_duplicates(d),
    "op9": lambda d, b, y: ppm.score_documents(d),
}


def side_tables(spark):
    return (
        spark.createDataFrame([(0, "quick brown fox jumps over the lazy dog"), (None, None), (1, ""), (2, "ab"), (2, "ab")], "item_id long, text string"),
        spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (7, 1, 1), (8, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_input_row(spark, docs, name):
    got = OPERATORS[name](docs, *side_tables(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert OPERATORS[name](docs.limit(0), *side_tables(spark)).count() == 0


def test_stages_with_odd_rows_and_none(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    side_tables(spark)[0].write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (plain, plain.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES:
            d, cols = stage(spark, d, str(tmp_path)), d.columns
            if name != "packing":
                assert d.columns == cols
        d.count()


def test_matches_with_clashing_columns_and_repeats(spark, docs):
    bench = side_tables(spark)[0].withColumns({c: F.lit(c) for c in ("id", "_text", "score")})
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == {(1, 0): 2, (7, 0): 1} and decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_repeats_are_counted_as_duckdb_does(spark, docs, duck):
    want = duck(queries.oracle_sql()["op1_quality_rules"], tables={"documents": docs.select("doc_id", "text", "source").dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").toPandas()})
    names, rows = want
    got = {r.doc_id: r.asDict() for r in quality_rules.score_documents(docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")).collect()}
    for r in rows:
        w = dict(zip(names, r, strict=True))
        assert {k: got[w["doc_id"]][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} == {k: w[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    from tests.test_queries import same

    same(queries.queries()[name](spark, SF), duck(queries.oracle_sql()[name]))


def test_bad_host_takes_its_documents_along(spark):
    good = "these are ten plain words that pass every single rule number %d here"
    rows = [(k, good % k, f"h{k % 9}") for k in range(900)] + [(1000 + k, "bad bad", "bad") for k in range(90)] + [(2000, good % 5, "bad")]
    got = {r.doc_id: r for r in quality_rules.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[2000].base_failed and got[2000].host_rejected and not got[2000].kept
    assert all(got[k].kept for k in range(900))


def test_ranking_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(got[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())


def test_ranking_is_brute_force(spark, monkeypatch):
    """Pairs, slope and cut against explicit feature differences in dense rows."""
    Q = quality_classifier
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts, y = Q.sample(docs, labels, "doc_id", "text", "quality", 5)
    of = {r.doc_id: r.text for r in docs.collect()}
    want = {r.doc_id: r.quality for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5 and r.doc_id in of}
    assert Counter(zip(texts, y.tolist(), strict=True)) == Counter(((of[k] or "").encode(), v) for k, v in want.items())
    monkeypatch.setattr(Q, "SLOTS", 1 << 8)
    r = Q.Ranking(texts, y)
    rows = []
    for t in texts:
        row = np.zeros((1 << 8) + Q.SHAPES)
        for kind in Q.slots(t):
            for k, n in Counter(kind.tolist()).items():
                row[k] = math.sqrt(n / len(kind))
        row[1 << 8 :] = (np.array(Q.shape(t)) - r.mean) / r.scale
        rows.append(row)
    better, worse = Q.opponents(y)
    assert (y[better] == 1).all() and (y[worse] == 0).all() and set(better) | set(worse) == set(range(len(y))) and len(set(zip(better, worse, strict=True))) == len(better)
    assert min(Counter(worse.tolist()).values()) >= Q.OPPONENTS
    x = np.array(rows)
    diff = x[better] - x[worse]
    slope = -(diff / (1 + np.exp(diff @ r.weights))[:, None]).mean(axis=0) + Q.RIDGE * r.weights
    assert np.abs(slope).max() < 1e-4
    s = np.sort(x @ r.weights)
    n = int((y == 0).sum())
    assert math.isclose(r.cut, (s[n - 1] + s[n]) / 2, rel_tol=1e-4, abs_tol=1e-4) and (r.scores(texts) >= Q.THRESHOLD).sum() == (y == 1).sum()


def test_labels_without_document_use_up_no_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE", 30)
    docs = spark.createDataFrame([(k, "good fine text" if k % 2 else "bad $$ text") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20_000)], "doc_id long, quality int")
    texts, y = quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 5)
    assert len(texts) == 30 and 0 < y.sum() < 30


PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "İ", "ß", "'s", "'RE", "<|endoftext|>", "<|", "1", "２", "½", "日本", "　", "\x85", "\x1c", "​", "👍🏽", "!", "!!", "ﬁ", "Å", "\xa0", "ǅ", "\x00", "ing", "\r\n", "ͅ"]


def test_tokens_are_the_librarys():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.MergeCounter(WORD).count(texts) == [len(x) for x in want]
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(BYTE)
    assert [encoder.encode(t).tolist() for t in texts] == want


def test_long_words_are_merged_as_by_the_library(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (255, 256, 257, 258, 2000, 100_000) for letters in ("aab", "abcdefghijklmnopqrstuvwxyz", "thernio", "aé", "x")]
    texts += [x * n for x in ("a", "ab", "aba", "the", "=-", "é") for n in (300, 5001)]
    tok = Tokenizer.from_file(WORD)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, WORD).collect()}
    for k, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (len(e.ids), len(texts[k].encode()), len(e.ids) > 2048)


def test_order_is_kept_where_a_merge_makes_a_lower_pair():
    counter = token_counts.MergeCounter(WORD)
    counter.low_after = np.zeros_like(counter.low_after)  # as if every merge could
    texts = ["ab" * 400, "a" * 999, "theretherethe" * 50]
    assert counter.count(texts) == [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_packing_of_an_empty_table(spark, docs):
    assert packing.pack(docs.limit(0), BYTE).collect() == []


def test_packing_holds_every_id_once(spark, docs):
    rows = packing.pack(docs, BYTE, length=16).collect()
    tok = Tokenizer.from_file(BYTE)
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in ROWS)
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at, docs_, left = 0, Counter(), []
    for r in rows:
        assert r.sequence_id * 16 + r.offset == at and len(r.ids) == 4 * r.length and r.ids_crc32 == crc32(r.ids) and r.start == len(left)
        at += r.length
        left += np.frombuffer(r.ids, "<u4").tolist()
        if len(left) == r.doc_tokens:
            docs_[r.doc_id, tuple(left)] += 1
            left = []
    assert docs_ == want and not left


def brute_shards(rows, limit):
    """Sizes of the buckets that splitting one bit at a time gives, by recursion over whole MD5 digests."""
    keyed = [(f"{int(md5(str('' if k is None else k).encode()).hexdigest(), 16):0128b}", len((t or "").encode())) for k, t, *_ in rows]

    def split(prefix, own):
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) < 2:
            return {prefix: own}
        return split(prefix + "0", [x for x in own if x[0][len(prefix)] == "0"]) | split(prefix + "1", [x for x in own if x[0][len(prefix)] == "1"])

    return {p: (sum(n for _, n in own), len(own)) for p, own in split("", keyed).items() if own}


@pytest.mark.parametrize("limit", [60, 1000, 20_000, 10**6])
def test_shards_split_bit_by_bit(spark, limit):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(k, "x" * 50) for k in (2315, 67946, 100740, 191338, 196022)]  # these share 20 bits
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit=limit).collect()
    sizes, n = defaultdict(int), Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert all(sizes[r.shard] == r.shard_bytes and n[r.shard] == r.shard_docs and (r.shard_bytes <= limit or r.shard_docs == 1) for r in got)
    want = brute_shards(rows, limit)
    pages = defaultdict(lambda: (0, 0))
    for s in sizes:
        p = s.split(".")[0].split("+")[0]
        pages[p] = (pages[p][0] + sizes[s], pages[p][1] + n[s])
    assert dict(pages) == want and len(got) == len(rows)


@pytest.mark.parametrize("limit", [1000, 50_000])
def test_shards_are_duckdbs_at_small_limits(spark, duck, limit):
    from tessella.llm.sql import op4
    from tests.test_queries import same

    hot = spark.createDataFrame([(7, "y" * 90)] * 200 + [(7, "w" * 700)] * 3 + [(7, None), (7, "")] * 3 + [(8, "z" * 5000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id NOT IN (7, 8)").unionByName(hot)
    same(sharding.shard_documents(docs.repartition(7), limit=limit), duck(op4(limit), tables={"documents": docs.toPandas()}))


def test_written_shards_hold_repeated_rows_within_the_limit(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 50, "a") for k in range(300)] + [(7, "y" * 90, "b")] * 200, "doc_id long, text string, _row string").repartition(7)
    sharding.write_shards(df, str(tmp_path / "s"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(map(tuple, back.drop("_shard").collect())) == Counter(map(tuple, df.collect()))
    assert all(r.n <= 1000 for r in back.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("n")).collect())


def edits(rnd, word, item):
    """Kinds of edited copies: words changed at random, every third one, every second one added, some left out, a part."""
    yield [word() if rnd.random() < 0.2 else w for w in item]
    yield [word() if k % 3 == 2 else w for k, w in enumerate(item)]
    yield [x for w in item for x in (w, word())]
    yield [w for w in item if rnd.random() < 0.7]
    yield item[: len(item) // 2]


def test_all_alignments_at_the_threshold_are_found(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 3)))
    items = [[word() for _ in range(n)] for n in (30, 30, 15, 40, 8, 5, 3, 2, 1, 59)]
    rows = []
    for k in range(300):
        text = [word() for _ in range(rnd.randint(0, 120))]
        at = rnd.randint(0, len(text))
        text[at:at] = [w.upper() + "," for w in list(edits(rnd, word, items[k % len(items)]))[k // len(items) % 5]]
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(f"i{k}", " ".join(w)) for k, w in enumerate(items)], "item_id string, text string")
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    block = decontaminate.Items(pa.array([f"i{k}" for k in range(len(items))]), [" ".join(w).encode() for w in items])
    want = {}
    for k, t in rows:
        w = block.numbers(t.encode())
        for i, (item, least) in enumerate(zip(block.words, block.points, strict=True)):
            points = decontaminate.align(item, w[None, :])[0][0] if len(w) else 0
            if points >= least:
                want[k, f"i{i}"] = points / (2 * len(item))
    assert {(r.doc_id, r.item_id): r.score for r in found} == want and len(found) == len(want) > 150
    assert all(least == max(math.ceil(0.8 * len(w) - 1e-9), min(12, 2 * len(w))) for w, least in zip(items, block.points, strict=True))


def test_every_third_word_changed_is_found_and_a_chance_likeness_is_not(spark):
    item = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)]
    rows = [(1, " ".join(w if k % 3 < 2 else f"x{k}" for k, w in enumerate(item))), (2, " ".join(["some", *item[:4], "text", *item[9:12], "else"]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (None, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows * 2, "doc_id long, text string"), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(1, 1): 2, (1, None): 2} and {round(r.score, 3) for r in got} == {0.517}


@pytest.mark.parametrize("copies", [1, 8, 9, 1000])
@pytest.mark.parametrize("kind", ["edited", "half"])
def test_groups_of_copies_are_found_whatever_their_size(spark, copies, kind):
    """Equal half copies, or copies with a changed word in every five."""
    item = [f"w{chr(97 + k)}" for k in range(20)]
    edited = [w if k % 5 < 4 else "other" for k, w in enumerate(item)]
    rows = [(k, " ".join(["before", *x, "after"])) for k, x in enumerate([edited if kind == "edited" else item[:9]] * copies)] + [(9999, "wa wb wc and else")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in found} == set(range(copies)) and len(found) == copies


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    bench, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.undo()
    assert got == Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) and got


def test_bound_is_no_less_than_the_points():
    rnd = random.Random(6)
    for _ in range(200):
        item, text = ([rnd.randint(0, 9) for _ in range(rnd.randint(1, 15))] for _ in range(2))
        item, texts = np.array([x or 1 for x in item]), np.array([text])
        assert decontaminate.bound(item, texts)[0] >= decontaminate.align(item, texts)[0][0]


def test_alignment_points_are_smith_watermans():
    rnd = random.Random(5)
    for _ in range(40):
        item, text = ([rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(item) + 1, len(text) + 1), int)
        for i, x in enumerate(item):
            for j, y in enumerate(text):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        points, begin, end = decontaminate.align(np.array(item), np.array([text]))
        assert points[0] == h.max() and begin[0] <= end[0] <= len(text)


def test_revisits(spark):
    rows = [
        (1, "http://Www.Ex.com/a/?utm_source=x&b=2&a=1#f", 10, False, {"etag": "e1", "x": "old", "date": "1"}, "one"), (2, "https://ex.com/a?a=1&b=2", 20, False, {"etag": "e2"}, "two"),
        (3, "ex.com/a?b=2&a=1", 15, True, {"etag": "e1", "date": "2", "x": "new"}, None), (4, "ex.com/a?b=2&a=1", 25, True, {"etag": "e1"}, None), (5, "ex.com/a?b=2&a=1", 10, True, {}, None),
        (6, None, 30, True, None, None), (7, "ex.com/a?a=1&b=2", 26, True, None, None), (8, "other.com", None, True, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, headers map<string,string>, payload string")
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert {k: (r.outcome, r.response_id, r.payload) for k, r in got.items()} == {3: ("resolved", 1, "one"), 4: ("mismatch", 2, None), 5: ("no_response", None, None), 6: ("no_response", None, None), 7: ("unchecked", 2, "two"), 8: ("no_response", None, None)}
    assert got[3].headers == {"etag": "e1", "x": "old", "date": "2"}
    assert revisits.resolve(df.limit(0)).count() == 0


def test_revisits_with_header_case_and_repeated_rows(spark):
    schema = "record_id long, url string, ts long, revisit boolean, headers map<string,string>, payload string, row long, key string, canon string"
    more = (None, "k", None)
    rows = [
        (1, "ex.com/a", 10, False, {"ETag": "e1", "Date": "1", "X-Y": "z"}, "one", *more), (1, "ex.com/a", 10, False, {"ETag": "e1", "Date": "1", "X-Y": "z"}, "one", *more),
        (3, "ex.com/a", 15, True, {"etag": "e1", "DATE": "2", "X-Y": "not permitted"}, None, *more), (3, "ex.com/a", 15, True, {"etag": "e1", "DATE": "2", "X-Y": "not permitted"}, None, *more),
        (4, "ex.com/a", 16, True, {"eTaG": "e2"}, None, *more), (5, "ex.com/a", 17, True, {"Last-Modified": "x"}, None, *more), (6, "ex.com/a", None, None, None, None, *more),
    ]
    got = [(r.record_id, r.outcome, r.response_id, r.payload, r.headers) for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()]
    first = (3, "resolved", 1, "one", {"etag": "e1", "date": "2", "x-y": "z"})
    assert sorted(got, key=lambda r: r[0]) == [first, first, (4, "mismatch", 1, None, {"etag": "e2"}), (5, "unchecked", 1, "one", {"etag": "e1", "date": "1", "x-y": "z"})]


def test_revisits_of_one_hot_url_with_a_stray_time(spark):
    rnd = random.Random(8)
    rows = [(k, "ex.com/hot", rnd.randrange(1000), k % 3 == 0, {"etag": "e"}, None if k % 3 == 0 else f"p{k}") for k in range(600)] + [(10**6, "ex.com/hot", 10**15, True, {}, None)]
    got = {r.record_id: r.response_id for r in revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, headers map<string,string>, payload string")).collect()}
    want = {k: max(((u, j) for j, _, u, again, *_ in rows if not again and u < t), default=(0, None))[1] for k, _, t, revisit, *_ in rows if revisit}
    assert got == want


def cut(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_line_templates_generalise_and_keep_the_first(spark):
    rows = [(k, f"unique line of document {chr(97 + k) * 5} indeed\nPage {k} of 90\nPosted by user {chr(97 + k)}x on the big forum\nshort") for k in range(6)]
    # Any two fields of a line of eight tokens or more are wildcards: so is the unique word of the first line, and nothing else of it varies.
    got = cut(spark, rows)
    assert got[0] == rows[0][1] and all(got[k] == "short" for k in range(1, 6))


def test_a_document_counts_once_for_a_template(spark):
    got = cut(spark, [(1, "the same old line a\nthe same old line b\nthe same old line c"), (2, "the same old line a"), (3, "another text here")])
    assert got[2] == "the same old line a" and got[1].count("\n") == 2


@pytest.mark.parametrize("line", ["the user {0} said hello to the kind {1} today", "signed in as {0} now", "a b c {0}", "w1 x y z {0} " + "and so on " * 20 + "{1} end"])
def test_fields_anywhere_are_wildcards(spark, line):
    names = ["ann", "bob", "eve", "kim"]
    rows = [(k, line.format(a, b)) for k, (a, b) in enumerate(zip(names, ["red", "sad", "old", "big"], strict=True))]
    assert cut(spark, rows) == {0: rows[0][1], 1: "", 2: "", 3: ""}
    assert cut(spark, rows[:2]) == dict(rows[:2]) or len(line.split()) > 50


def test_long_lines_recur_from_two_documents_on(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(60)]
    edited = [*words[:30], "changed", *words[31:]]
    rows = [(1, " ".join(words)), (2, "own words of two\n" + " ".join(words)), (3, "own words three\n" + " ".join(edited)), (4, " ".join(words[:40])), (5, " ".join(words[:40]))]
    assert cut(spark, rows) == {1: rows[0][1], 2: "own words of two", 3: "own words three", 4: rows[3][1], 5: rows[4][1]}


def test_added_documents_bring_no_line_back(spark):
    rnd = random.Random(9)
    line = lambda: " ".join(["we saw the", *(rnd.choice("abc") * 3 for _ in range(rnd.choice([1, 3, 6])))])
    rows = [(k, "\n".join(line() for _ in range(3))) for k in range(40)]
    few, many = cut(spark, rows[:20]), cut(spark, rows)
    assert all(set(many[k].split("\n")) <= set(few[k].split("\n")) | {""} for k in few)


@pytest.mark.parametrize("share", [1, 50_000])
def test_hot_templates_are_broadcast_and_others_shuffled(spark, monkeypatch, share):
    from tessella.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", share)
    rows = [(k, f"the very hot line here\nline of group {'abcdefgh'[k % 8]} is here\nown {'x' * (k + 1)}") for k in range(60)]
    assert cut(spark, rows)[59] == "own " + "x" * 60 and cut(spark, rows)[0] == rows[0][1]


def brute_simhash(rows):
    fps = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min((x for x in (k, low.get(root(i))) if x is not None), default=None)
    return Counter((k, f"{fps[i]:016x}", low[root(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("tree_size", [simhash.TREE_SIZE, 5])
def test_simhash_components(spark, docs, tree_size):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = real + [(None if r[0] is None else r[0] + 10_000, r[1]) for r in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.near_duplicates(df, tree_size=tree_size).collect())) == brute_simhash(rows)
    kept = simhash.keep_first(df, tree_size=tree_size).collect()
    assert Counter(k for k, _ in kept) == Counter(brute_keep(rows))


def brute_keep(rows):
    """The ids that stay, by all pairs of texts: equal shingles, or a common share of 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    holders, up = defaultdict(list), list(range(len(rows)))
    empty = [i for i, s in enumerate(sets) if not s]

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j in [j for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)] + (empty[:1] if not s else []):
            up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            holders[x].append(i)
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        ids[root(i)].append(k)
    return [min((k for k in v if k is not None), default=None) for v in ids.values()]


def test_recall_of_near_copies(spark):
    """Of the rows that all pairs of texts make superfluous, nine in ten or more go, and no other row goes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, every = set(brute_keep(rows)), {k for k, _ in rows}
    assert want <= kept and len(every - kept) >= 0.9 * len(every - want) > 20


@pytest.mark.parametrize("tree_size", [simhash.TREE_SIZE, 3])
def test_shards_with_several_classes_are_searched(spark, tree_size):
    """Texts that share a passage, in groups of near copies, whose leads differ."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(30):
        base = passage + [word() for _ in range(40)]
        for _ in range(3):
            edited = list(base)
            edited[rng.randrange(60, 100)] = word()
            rows.append((len(rows), " ".join(edited)))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), tree_size=tree_size).collect()
    assert sorted(r.doc_id for r in kept) == sorted(brute_keep(rows)) == list(range(0, 90, 3))


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, clean = [], []
    for g in range(40):
        base = [word() for _ in range(400)]
        rows.append((g * 10, " ".join(base)))
        clean.append(g * 10)
        for k in range(1, 4):
            edited = list(base)
            for at in rng.sample(range(400), 2):
                edited[at] = word()
            rows.append((g * 10 + k, " ".join(edited)))
        half = base[:200] + [word() for _ in range(200)]  # shares a third of its shingles only
        rows.append((g * 10 + 9, " ".join(half)))
        clean.append(g * 10 + 9)
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(clean) and len(kept) <= len(clean) + 4


def test_ppm_is_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + [(999, b"")]
    df = spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_documents(df).collect()}
    train = [t for k, t in rows if crc32(str(k).encode()) % 10]
    after, c = defaultdict(Counter), Counter()
    for t in train:
        c.update(t.lower().split())
        c[b""] += 1
        padded = b"\xff" * 4 + t + b"\xff"
        for k in range(4, len(padded)):
            for o in range(5):
                after[padded[k - o : k]][padded[k]] += 1

    def logp(context, x):
        gone, total = set(), 0.0
        for o in range(4, -1, -1):
            n = {y: m for y, m in after.get(context[4 - o :], {}).items() if y not in gone}
            if n:
                size = sum(n.values()) + len(n)
                if x in n:
                    return total + math.log10(n[x] / size)
                total += math.log10(len(n) / size)
                gone |= set(n)
        return total - math.log10(256 - len(after[b""]))

    n, v = sum(c.values()), len(c)
    for k, t in rows[-15:]:
        padded = b"\xff" * 4 + t + b"\xff"
        assert math.isclose(got[k].score, sum(logp(padded[i - 4 : i], padded[i]) for i in range(4, len(padded))), rel_tol=1e-9)
        tokens = [*t.lower().split(), b""]
        assert math.isclose(got[k].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)


def test_all_pairs_at_the_similarity_go(spark):
    """Pairs just above 0.8, far apart in bits and among many neighbours, against all pairs of shingle sets."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    frame, rows = [word() for _ in range(150)], []
    for g in range(60):
        base = (frame if g % 2 else []) + [word() for _ in range(60 if g % 2 else 200)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            edited = list(base)
            for at in rng.sample(range(len(base)), 4):
                edited[at] = word()
            rows.append((len(rows), " ".join(edited)))
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in (tuple(t.split()) for _, t in rows)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    lowest = {r: min(i for i in range(len(rows)) if up[i] == r) for r in set(up)}
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(lowest.values())


@pytest.mark.parametrize("share", [1, 2**8])
def test_ppm_scores_rare_grams_by_their_counts(spark, monkeypatch, share):
    """Few grams or none are held in memory, so rare ones are looked up by joins."""
    monkeypatch.setattr(ppm, "KEPT_SHARE", share)
    test_ppm_is_brute_force(spark)


def test_pipeline_against_its_parts(spark):
    """Each stage keeps what brute force over its own input would keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.rules(spark, docs, SF)
    verdict = {r.doc_id for r in quality_rules.score_documents(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict and kept.columns == docs.columns
    lines = corpus_pipeline.line_templates(spark, kept, SF).cache()
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(kept).collect()}
    assert all(texts[r.doc_id] == r.text for r in lines.collect())
    near = corpus_pipeline.near_duplicates(spark, lines, SF).cache()
    assert Counter(r.doc_id for r in near.collect()) == Counter(brute_keep([(r.doc_id, r.text) for r in lines.collect()]))
    clean = corpus_pipeline.benchmark(spark, near, SF).cache()
    hit = {r.doc_id for r in decontaminate.contaminated(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - hit
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}


def test_keep_first_of_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, fp string, own string, root string, low string, a string"
    assert simhash.keep_first(spark.createDataFrame([], schema)).collect() == []
    odd = [(None, None, "x", None, None, None, None), (None, "", None, None, None, None, None), (3, " \n", "y", None, None, None, "z"), (4, "one word more", None, None, None, None, None), (4, "one word more", None, None, None, None, None)]
    kept = simhash.keep_first(spark.createDataFrame(odd, schema))
    assert kept.columns == ["doc_id", "text", "fp", "own", "root", "low", "a"] and sorted(r.doc_id for r in kept.collect()) == [3, 4]

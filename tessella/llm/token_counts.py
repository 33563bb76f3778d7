"""Token counts by rank-synchronous merging: each sequence of a batch applies its lowest-rank pair at the same time."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Words whose counts a task remembers, and the longest remembered.
MEMORY, LONGEST = 500_000, 200
#: Bytes of a pre-token from which on it is merged as a linked list.
LONG = 256
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Rank of neighbours that no rule merges.
_NO_PAIR = 1 << 30
#: White space to str.split(), but not to the tokenizer.
_SEPARATORS = re.compile("[\\x1c-\\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where it is printable and no blank,
    else the next code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def blank_split(text: str) -> list[str]:
    return [w for w in _BLANKS.split(text) if w] if _SEPARATORS.search(text) else text.split()


class MergeCounter:
    """Counts tokens as the vocabulary file's tokenizer does: special strings are tokens and split the text; the rest
    is split into words by white space, which neither normalisation nor the file's pattern crosses, and each word is
    normalised and split into pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], dtype=np.int64)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank], pairs[:, 2]
        # The lowest rank of a pair with the symbol that a rank makes: where it is lower, order within a sequence matters.
        low = np.full(max(vocab.values()) + 1, _NO_PAIR)
        for side in (0, 1):
            np.minimum.at(low, pairs[:, side], np.arange(len(pairs)))
        self.low_after = low[pairs[:, 2]]
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pre = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(joined & (self.keys[at] == key), self.rank[at], _NO_PAIR)

    def merged(self, parts: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        left = size.copy()
        for mine, merge in ((size <= LONG, self._merge_short), (size > LONG, self._merge_long)):
            at = np.flatnonzero(mine & (size > 0))
            if len(at):
                left[at] = merge([parts[k] for k in at])
        return left

    def _symbols(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sequences end to end in one array, and the number of each symbol's sequence."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        return sym, np.repeat(np.arange(len(parts)), size)

    def _merge_short(self, parts: list[bytes]) -> np.ndarray:
        """In each round every sequence merges the first of its pairs of lowest rank, only the ranks beside a merge are
        looked up again, and sequences without a pair leave."""
        sym, seq = self._symbols(parts)
        left = np.bincount(seq, minlength=len(parts))
        rank = np.append(self._ranks(sym[:-1], sym[1:], seq[:-1] == seq[1:]), _NO_PAIR)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), start)
            pair = best >> 32 != _NO_PAIR
            first = (best & 0xFFFFFFFF)[pair]
            sym[first] = self.made[rank[first]]
            left[seq[first]] -= 1
            stays = np.repeat(pair, np.diff(np.append(start, len(sym))))
            stays[first + 1] = False
            place = np.cumsum(stays) - 1
            sym, seq, rank = sym[stays], seq[stays], rank[stays]
            now = place[first]
            now = np.concatenate((now, now[now > 0] - 1))
            after = np.minimum(now + 1, len(sym) - 1)
            rank[now] = self._ranks(sym[now], sym[after], (seq[now] == seq[after]) & (after > now))
        return left

    def _merge_long(self, parts: list[bytes]) -> np.ndarray:
        """The same for long sequences, in time that grows with the merges and not with merges times length. Sequences
        don't touch each other, so all can work on the lowest rank of any of them. A round takes all places of that rank
        at once, from the left where they overlap; should a merge be able to make a pair of lower rank, each sequence takes
        its first place only. Neighbours are linked, and the places of a rank are held in lists by rank."""
        sym, seq = self._symbols(parts)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, _NO_PAIR)
        rank[: n - 1] = self._ranks(sym[:-1], sym[1:], seq[:-1] == seq[1:])
        sym, seq = np.append(sym, 0), np.append(seq, -1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != _NO_PAIR]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for group in np.split(at, cuts) if len(at) else ():
                r = int(rank[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(group)

        wait(np.arange(n))
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if self.low_after[r] < r:
                first = np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))
                if not first.all():
                    wait(at[~first])
                at = at[first]
            else:
                # Of places that follow each other (x x x x), every second is taken, counted from the run's first.
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                begun = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begun) % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = _NO_PAIR
            beyond = after[gone]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            prior = before[at]
            changed = np.unique(np.concatenate((at, prior[prior >= 0])))
            changed = changed[alive[changed]]
            right = after[changed]
            rank[changed] = self._ranks(sym[changed], sym[right], seq[changed] == seq[right])
            wait(changed)
        return np.bincount(seq[:-1][alive], minlength=len(parts))

    def _learn(self, new: list[str]) -> dict[str, int]:
        lower = [w.lower() if w.isascii() else self.normal(w) for w in new]
        split = [[w] if w.isascii() and w.isalpha() else self.pre.findall(w) for w in lower]
        flat = [p.encode() for ps in split for p in ps]
        if not flat:
            return dict.fromkeys(new, 0)
        total = np.concatenate(([0], np.cumsum(self.merged(flat))))
        at = np.concatenate(([0], np.cumsum([len(ps) for ps in split])))
        return dict(zip(new, (total[at[1:]] - total[at[:-1]]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self.special.split(t) for t in texts]
        split = [[w for s in ps for w in blank_split(s)] for ps in pieces]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        new = [w for w in {w for ws in split for w in ws} if w not in known]
        found, k = {}, 0
        while k < len(new):  # parts of bounded total length
            n = size = 0
            while k + n < len(new) and (size := size + len(new[k + n])) < 200_000 or not n:
                n += 1
            found |= self._learn(new[k : k + n])
            k += n
        known |= {w: c for w, c in found.items() if len(w) <= LONGEST}
        if any(len(w) > LONGEST for w in found):
            return [len(ps) - 1 + sum(known[w] if w in known else found[w] for w in ws) for ps, ws in zip(pieces, split, strict=True)]
        get = known.__getitem__
        return [len(ps) - 1 + sum(map(get, ws)) for ps, ws in zip(pieces, split, strict=True)]


@cache
def _of_worker(path: str) -> MergeCounter:
    """One for each worker process, whose tasks come one after another and share what it remembers."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text is empty and has no tokens. Very long texts and words take time in proportion to their length, about. Repeated rows are counted each for itself; a null id is passed on. An empty
    table gives an empty result; other columns are left out. No row leaves its task."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _of_worker(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = b.column("text").to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = own.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_tokens")], F.lit(True).alias("over_limit")).schema
    return own.mapInArrow(run, schema)

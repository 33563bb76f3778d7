"""Concatenate and cut: token totals of partitions give global offsets, and fixed windows cut the stream of tokens."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LENGTH, END = 1024, 0
#: White space as the tokenizer's pattern has it, without the blank and the line feed.
OTHER_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S = f" \n{OTHER_SPACES}"
#: Pieces that the tokenizer's own split never joins: a word with one blank before it, or a run of white space.
_PIECE = re.compile(rf" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ODD = ("\x01", "  ", "\n\n", " \n", "\n ", *OTHER_SPACES)
#: The pattern that splits texts into pre-tokens (a fixed value of byte-level vocabularies).
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces whose ids a task remembers.
MEMORY = 800_000


def pieces(text: str) -> list[str]:
    """The text in pieces whose ids don't depend on what stands around them. Where white space is single blanks and
    line feeds, cutting before each blank and around each line feed gives the same pieces as the pattern, faster."""
    if any(x in text for x in _ODD):
        return _PIECE.findall(text)
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01") if text else []


class Known(dict):
    """Ids of pieces. A new piece of letters that every library has as such is split into pre-tokens here, which are
    looked up each for itself and merged by the library; other pieces go to the library whole."""

    def __init__(self, tok):
        super().__init__({"": b""})
        self.tok, self.merge = tok, tok.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.letters = {b: b if b in printable else next(other) for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if max(piece) >= "\u0250":
            ids = array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        elif len(parts := _PRE.findall(piece)) > 1:
            ids = b"".join([self[x] for x in parts])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of text once. Texts that hold a
    special token's string go to it whole, as that string also changes how the white space before it is split."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known = Known(self.tok)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(self.known) > MEMORY:
            self.known = Known(self.tok)
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces(text))), dtype="<u4")


@cache
def _of_worker(path: str) -> Encoder:
    """One for each worker process, whose tasks come one after another and share what it remembers."""
    return Encoder(path)


def tokenize(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with the end id), part, begins: the document's place in the tokens of
    its task. The place is written down with the ids, so that it holds however the table is read later."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = _of_worker(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                ids = [np.append(encoder.encode(x.as_py()), np.uint32(END)) for x in b.column("text")]
                begins = total + np.cumsum([0, *map(len, ids)])
                total = int(begins[-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(begins[:-1])],
                    ["doc_id", "ids", "part", "begins"],
                )

    schema = own.select("doc_id", F.lit(b"").alias("ids"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("begins")).schema
    return own.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document that a window of `length` tokens holds: doc_id, start, length, ids, ids_crc32,
    doc_tokens, sequence_id, offset. All windows are full but the last.

    A null text is empty and gives the end id alone. A very long text is cut into as many pieces as it fills windows.
    Repeated rows, and rows without id, are packed each for itself. An empty table gives an empty result; other columns are
    left out. What one task sums and all get is one row of 16 bytes for each task that read the input. First pass: tokens are written once, with each
    task's running total. Second pass: the tasks' totals (one row a task) are summed, and each document is cut where
    its global place crosses a multiple of the length."""
    tokens = materialize(tokenize(docs, doc_id, text, tokenizer))
    totals = tokens.groupBy("part").agg(F.max(F.col("begins") + F.length("ids") / 4).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "ids", (F.col("base") + F.col("begins")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (ids, at) in enumerate(zip(b.column("ids"), b.column("at").to_pylist(), strict=True)):
                data = ids.as_buffer()
                n, view, start = data.size // 4, memoryview(data), 0
                while start < n:
                    offset = (at + start) % length
                    end = min(n, start + length - offset)
                    piece = view[4 * start : 4 * end]
                    rows.append(i)
                    out.append((start, end - start, bytes(piece), crc32(piece), n, (at + start) // length, offset))
                    start = end
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = tokens.select("doc_id", *[F.lit(b"" if c == "ids" else 0).cast("binary" if c == "ids" else "long").alias(c) for c in ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")]).schema
    return placed.mapInArrow(cut, schema)

"""Token counts without ids: pieces per distinct pre-token, joined to pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so a text's token count is
the sum over its pre-tokens of how many pieces each has. Every distinct
pre-token of the corpus is listed once, by a shuffle that adds up its
occurrences, and its pieces are counted once. The list is then joined to each
document's pre-token frequencies, and the products are summed; no ids are made.

The join goes two ways. Pre-tokens that make more than a ``HEAVY``-th of all
(so ``HEAVY`` of them at most, whatever the corpus) are broadcast and met where
the document is; all others travel as (document, pre-token, times) rows and
meet the list in a shuffled join. By the same bound that join has no hot key:
a rare pre-token has a row per document at most, and under N / HEAVY rows.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
and ids each give a row; an empty table gives none; other columns of the
input are ignored whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, cut, slices

#: Unicode White_Space, which is what \s means to the tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-token pattern published with the vocabulary.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A blank before a character that isn't one always opens a pre-token, so texts part there.
PART = re.compile(rf" (?=[^{SPACE}])")
PLAIN = re.compile(r" (?:\s|\Z)")
#: Entries that a task's table holds before it starts anew.
TABLE_ENTRIES = 250_000
HEAVY = 1_000_000
#: Bytes of text that are taken apart at a time; a table's keys lie among them in memory, so it is little.
SLICE = 1 << 20
MARKS = frozenset(".,;:!?")


class Library:
    """The tokenizer file of the ``tokenizers`` library, and what its special strings are."""

    def __init__(self, path: str):
        # a task has one core; the library's threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None

    def pieces(self, tokens: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        return list(map(len, self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)))


def special_strings(path: str) -> re.Pattern | None:
    return Library(path).special


def taken_apart(part: str | tuple[str]) -> list[str]:
    """The pre-tokens of a part; a tuple holds one that no blank leads."""
    lead, part = ("", part[0]) if type(part) is tuple else (" ", part)
    if part.isascii():  # letters, or letters and a mark, need no pattern
        if part.isalpha():
            return [lead + part]
        if part[-1:] in MARKS and part[:-1].isalpha():
            return [lead + part[:-1], part[-1]]
    return PRE_TOKEN.findall(lead + part)


class PreTokens:
    """Numbers for the pre-tokens of texts, in a bounded table; parts between blanks are taken apart once."""

    def __init__(self, special: re.Pattern | None, heavy: dict[str, int] | None = None, entries: int = TABLE_ENTRIES):
        self.special, self.heavy, self.entries = special, heavy or {}, entries
        self.clear()

    def clear(self) -> None:
        self.parts, self.tokens = Numbers(), Numbers()
        self.names: list[str] = []
        self.flat, self.first, self.sizes, self.weight = (np.zeros(0, np.int64) for _ in range(4))

    def full(self) -> bool:
        return max(len(self.parts), len(self.tokens)) > self.entries

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the texts' pre-tokens, one text after another, how many each text has, and its special strings."""
        keys, sizes, specials = [], [], []
        for text in texts:
            segments, n = [text], 0
            if self.special is not None and (n := sum(1 for _ in self.special.finditer(text))):
                segments = self.special.split(text)
            before = len(keys)
            for s in filter(None, segments):
                head, *more = PART.split(s) if PLAIN.search(s) else s.split(" ")
                if head:
                    keys.append((head,))  # a part that no blank leads
                keys += more
            sizes.append(len(keys) - before)
            specials.append(n)
        part = np.fromiter(map(self.parts.__getitem__, keys), np.int64, len(keys))
        if fresh := self.parts.take_fresh():
            split = list(map(taken_apart, fresh))
            own = np.fromiter(map(len, split), np.int64, len(split))
            new = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64, own.sum())
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(own) - own])
            self.sizes, self.flat = np.concatenate([self.sizes, own]), np.concatenate([self.flat, new])
            words = self.tokens.take_fresh()
            self.names += words
            self.weight = np.concatenate([self.weight, np.fromiter(map(self.heavy.get, words, repeat(-1)), np.int64, len(words))])
        own = self.sizes[part]
        to = np.cumsum(own)
        tokens = self.flat[np.arange(own.sum()) + np.repeat(self.first[part] - to + own, own)]
        ends = np.concatenate([[0], to])[np.cumsum([0, *sizes])]
        return tokens, np.diff(ends), np.asarray(specials, np.int64)


def frequencies(docs: DataFrame, special: re.Pattern | None) -> DataFrame:
    """(token, c): every pre-token of column _text and how often it occurs, added up before the shuffle in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(table.names, pa.string()), pa.array(total)], ["token", "c"])

        table, total = PreTokens(special), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                found = np.bincount(table.of([x or "" for x in part.column("_text").to_pylist()])[0], minlength=len(table.names))
                found[: len(total)] += total
                total = found
                if table.full():
                    yield flush()
                    table.clear()
                    total = np.zeros(0, np.int64)
        if len(total):
            yield flush()

    return docs.select("_text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def with_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """(token, c, pieces): how many pieces each pre-token has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(path)
        for batch in batches:
            n = library.pieces(batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], [*batch.schema.names, "pieces"])

    return tokens.mapInArrow(run, "token string, c long, pieces int")


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row; ``path``: a tokenizer .json on every node."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    special = special_strings(path)
    known = cut(with_pieces(frequencies(docs, special), path), "pieces")
    total = known.agg(F.sum("c")).first()[0] or 0
    heavy = F.col("c") * HEAVY > total
    common = spark.sparkContext.broadcast({r.token: r.pieces for r in known.where(heavy).toLocalIterator()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PreTokens(special, common.value)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                if table.full():
                    table.clear()
                tokens, sizes, n = table.of([x or "" for x in part.column("_text").to_pylist()])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                weight = table.weight[tokens]
                light = weight < 0
                n = n + np.bincount(doc, np.where(light, 0, weight), len(sizes)).astype(np.int64)
                pairs, times = np.unique(doc[light] * len(table.names) + tokens[light], return_counts=True)
                width = max(1, len(table.names))
                offsets = pa.array(np.searchsorted(pairs // width, np.arange(len(sizes) + 1)).astype(np.int32))
                names = pa.array(list(map(table.names.__getitem__, (pairs % width).tolist())), pa.string())
                rare = [pa.ListArray.from_arrays(offsets, x) for x in (names, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_bytes"), pa.array(n), *rare], ["_id", "n_bytes", "n", "rare", "times"])

    found = docs.mapInArrow(counted, f"_id {kind}, n_bytes long, n long, rare array<string>, times array<int>")
    # the number of a row is written with it
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()), "counted")
    each = found.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    met = each.join(known.where(~heavy).select("token", "pieces"), "token").groupBy("_row").agg(F.sum(F.col("times").cast("long") * F.col("pieces")).alias("_n"))
    whole = found.select("_row", "_id", "n_bytes", "n").join(met, "_row", "left")
    n = F.col("n") + F.coalesce("_n", F.lit(0))
    return whole.select(F.col("_id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))

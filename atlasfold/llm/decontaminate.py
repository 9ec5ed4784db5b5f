"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents become words (A-Z lower-cased, split at ASCII characters
that are neither letter nor digit) joined by single blanks; an item's windows
of ``width`` consecutive words are the automaton's patterns. A text is scanned
once; hits are found as ranges of words and, where spans are asked for, mapped
to character offsets of the original text.

The items are a fixed query set: they are read in blocks of at most
``block_bytes`` bytes of text, each block an automaton that is broadcast and
scanned in a pass of its own, so neither driver nor worker holds more than a
block. A usual benchmark is one block.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no window; an item with null id can hit words but is not
listed; items with equal ids count once; empty tables give no rows or no hits;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Word bytes keep their lower-cased value; every other ASCII byte becomes a blank.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows(text: bytes, width: int) -> set[str]:
    own = words(text)
    if not own:
        return set()
    return {b" ".join(own[i : i + width]).decode("utf-8", "surrogateescape") for i in range(max(1, len(own) - width + 1))}


def automaton(items: list[tuple[object, bytes]], width: int):
    """Patterns with blanks around them, each with its number of words and the ids that have it; None without patterns."""
    owners: dict[str, set] = {}
    for item_id, text in items:
        for w in windows(text, width):
            owners.setdefault(w, set()).update(() if item_id is None else (str(item_id),))
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(f" {w} ", (w.count(" ") + 1, tuple(sorted(ids))))
    found.make_automaton()
    return found


def scan(auto, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged ranges [first, last + 1) of hit words, and the ids of items that hit."""
    if auto is None or not own:
        return [], set()
    text = f" {b' '.join(own).decode('utf-8', 'surrogateescape')} "
    ranges: list[tuple[int, int]] = []
    ids: set[str] = set()
    seen = last = 0
    for end, (n, owners) in auto.iter(text):
        seen += text.count(" ", last, end + 1)  # blanks up to the one that closes the window
        last = end + 1
        stop = seen - 1
        start = stop - n
        while ranges and ranges[-1][1] >= start:
            start = min(start, ranges.pop()[0])
        ranges.append((start, stop))
        ids.update(owners)
    return ranges, ids


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size, streamed partition by partition."""
    held: list[tuple[object, bytes]] = []
    size = 0
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        if held and size + len(row.t) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield held


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``id_col``, n_words, n_hit, item_ids (sorted strings) and spans (offsets of code points [start, stop) in the original) of every document."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    between = f"_id {kind}, _text string, _hits array<long>, _items array<string>"
    final = f"_id {kind}, n_words long, n_hit long, item_ids array<string>, spans array<array<long>>"
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())

    def scanned(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton(sent.value, width)
            for batch in batches:
                for part in slices(batch, "_text"):
                    texts, none = utf8(part, "_text"), [None] * part.num_rows
                    first = part.num_columns == 2
                    before = none if first else part.column("_hits").to_pylist()
                    listed = none if first else part.column("_items").to_pylist()
                    n, ranges, ids = [], [], []
                    for text, had, has in zip(texts, before, listed, strict=True):
                        own = words(text)
                        r, i = scan(auto, own)
                        n.append(len(own))
                        ranges.append(merge([*r, *zip(had[::2], had[1::2], strict=True)]) if had else r)
                        ids.append(sorted(i.union(has or ())))
                    if last:
                        hit = [sum(b - a for a, b in r) for r in ranges]
                        spans = [original_spans(t, r) for t, r in zip(texts, ranges, strict=True)]
                        columns = {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "item_ids": pa.array(ids, strings), "spans": pa.array(spans, pa.list_(longs))}
                    else:
                        flat = [[x for ab in r for x in ab] for r in ranges]
                        columns = {"_text": part.column("_text"), "_hits": pa.array(flat, longs), "_items": pa.array(ids, strings)}
                    yield pa.RecordBatch.from_arrays([part.column("_id"), *columns.values()], ["_id", *columns])

        return run

    queue = blocks(items, item_id, item_text, block_bytes)
    block = next(queue)
    while block is not None:
        after = next(queue, None)
        out = out.mapInArrow(scanned(sc.broadcast(block), after is None), final if after is None else between)
        block = after
    return out.withColumnRenamed("_id", id_col)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all their columns as they were."""
    sc = docs.sparkSession.sparkContext
    for block in blocks(items, item_id, item_text, block_bytes):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            auto = automaton(sent.value, width)
            for batch in batches:
                for part in slices(batch, text_col):
                    yield part.filter(pa.array([not scan(auto, words(t))[0] for t in utf8(part, text_col)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def original_spans(text: bytes, pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges of words as offsets of code points in the text as it was."""
    if not pairs:
        return []
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "surrogateescape"))]
    return [[at[a][0], at[b - 1][1]] for a, b in pairs]

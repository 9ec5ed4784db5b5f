"""Ranked lexical search over a two-level quantised index.

The index is cut by documents: a row is a block of documents (a slice of about
BLOCK_BYTES of text) with the postings of all its terms, so building moves no
posting through a shuffle and a search reads it where it lies. Level one holds
for every posting its impact, rounded up to a byte; level two the exact counts
that the impact came from, in columns of their own.

A search takes the items in blocks of bounded size. One scan of level one gives
every document an upper bound for every item (bytes times weights, as products
of matrices) and a lower one (a byte is less than a step too high). A task
keeps the k largest lower bounds of each item and lets go what can't reach
them; over all tasks the k-th lower bound is then known, and every document
whose upper bound reaches it is scored again from level two in integers. No
document of the k best can be missing: its bound is its score at least.

A document's score is the sum, over the item's terms with repeats, of
w * ((10**9 * tf) div (1000 * tf + 8 * m)), with m = 25 + (75 * n * N) div L and
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Defined results: a null or wordless text has no terms, counts nowhere and is
never found; a null or wordless item finds nothing; equal item rows count once,
items that share an id but not a text are ranked each for itself under that id;
repeated documents are ranked each, and a null document id comes before others
of its score; items or documents without rows give no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Numbers, cut, remove_cuts, slices, utf8
from .decontaminate import words

BLOCK_BYTES = 4 << 20
#: Documents of a block, which bounds its table of documents x items, and blocks of a file, which bounds what a reader holds.
DOCUMENTS, FILE_BLOCKS = 1 << 13, 4
#: A step of the byte scale: impacts are under a million.
STEP = 3_922
#: Items, and bytes of their text, in a block of the query set.
ITEMS, ITEM_BYTES = 256, 128 << 10
#: Cells of a dense table that is held at a time.
CELLS = 1 << 21


@dataclass
class Index:
    """Blocks of postings, the number of documents with terms, and that of their terms with repeats."""

    blocks: DataFrame
    documents: int
    terms: int


@dataclass
class Questions:
    """A block of items: their ids, their distinct terms, and how often (terms x items) each has which."""

    ids: list
    terms: list[bytes]
    times: np.ndarray


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 25 + (75 * n.astype(np.int64) * documents) // max(1, terms)


def inverted(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, the distinct ones, where the postings of each end, and the postings' texts and counts."""
    numbers = Numbers()
    n = np.zeros(len(texts), np.int32)
    keys = []
    for slot, text in enumerate(texts):
        own = words(text)
        n[slot] = len(own)
        keys.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) << 16 | slot)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    tfs = np.diff(starts, append=len(keys)).astype(np.int32)
    ends = np.cumsum(np.bincount(keys[starts] >> 16, minlength=len(numbers))).astype(np.int32)
    return n, list(numbers), ends, (keys[starts] & 0xFFFF).astype(np.uint16), tfs


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs``, in the shared folder."""
    kind, arrow = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for whole in slices(batch, "_text", BLOCK_BYTES):
                for at in range(0, whole.num_rows, DOCUMENTS):
                    part = whole.slice(at, DOCUMENTS)
                    n, terms, ends, slots, tfs = inverted(utf8(part, "_text"))
                    values = {
                        "block": pa.array([block], pa.int64()),
                        "documents": pa.array([np.count_nonzero(n)], pa.int64()),
                        "words": pa.array([n.sum(dtype=np.int64)], pa.int64()),
                        "ids": pa.ListArray.from_arrays([0, part.num_rows], part.column("_id").cast(arrow)),
                        "terms": pa.ListArray.from_arrays([0, len(terms)], pa.array(terms, pa.binary())),
                        "n": pa.array([n.tobytes()], pa.binary()),
                        "ends": pa.array([ends.tobytes()], pa.binary()),
                        "slots": pa.array([slots.tobytes()], pa.binary()),
                        "tfs": pa.array([tfs.tobytes()], pa.binary()),
                    }
                    yield pa.RecordBatch.from_arrays(list(values.values()), list(values))
                    block += 1

    schema = f"block long, documents long, words long, ids array<{kind}>, terms array<binary>, n binary, ends binary, slots binary, tfs binary"
    exact = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema), "postings", per_file=FILE_BLOCKS)
    total = exact.agg(F.sum("documents"), F.sum("words")).first()
    documents, terms = total[0] or 0, total[1] or 0

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                m = lengths(_numbers(row, "n", np.int32), documents, terms)
                tfs = _numbers(row, "tfs", np.int32).astype(np.int64)
                level = -(-impact(tfs, m[_numbers(row, "slots", np.uint16)]) // STEP)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([level.astype(np.uint8).tobytes()], pa.binary())], [*row.schema.names, "levels"])

    index = cut(exact.mapInArrow(levels, f"{schema}, levels binary"), "index", per_file=FILE_BLOCKS)
    remove_cuts(exact)
    return Index(index, documents, terms)


def _numbers(row: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return np.frombuffer(row.column(column)[0].as_buffer(), kind)


def questions(items: DataFrame, item_id: str, item_text: str) -> Iterator[Questions]:
    """The distinct items with a term, in blocks of bounded size, streamed to the driver."""
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("t")).distinct()
    ids, counts, held = [], [], 0
    for row in rows.toLocalIterator():
        own = Counter(words(bytes(row.t)))
        if not own:
            continue
        if ids and (len(ids) == ITEMS or held + len(row.t) > ITEM_BYTES):
            yield _block(ids, counts)
            ids, counts, held = [], [], 0
        ids.append(row.i)
        counts.append(own)
        held += len(row.t)
    if ids:
        yield _block(ids, counts)


def _block(ids: list, counts: list[Counter]) -> Questions:
    numbers = Numbers()
    cells = [(numbers[term], i, n) for i, own in enumerate(counts) for term, n in own.items()]
    times = np.zeros((len(numbers), len(ids)), np.int64)
    for t, i, n in cells:
        times[t, i] = n
    return Questions(ids, list(numbers), times)


def _places(row: pa.RecordBatch, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the wanted terms a block has, and where their postings start and end."""
    at = pc.index_in(wanted, value_set=row.column("terms")[0].values)
    present = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    at = at.drop_null().to_numpy()
    ends = _numbers(row, "ends", np.int32)
    return present, np.where(at > 0, ends[at - 1], 0), ends[at]


def _dense(starts: np.ndarray, ends: np.ndarray, slots: np.ndarray, values: np.ndarray, rows: int, kind) -> np.ndarray:
    """Values of the postings in a table of slots x terms."""
    n = ends - starts
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = np.zeros((rows, len(starts)), kind)
    out[slots[at], np.repeat(np.arange(len(starts)), n)] = values[at]
    return out


def _frequencies(index: Index, asked: Questions) -> np.ndarray:
    """Documents that hold each of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(asked.terms, pa.binary()), np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                present, starts, ends = _places(batch.slice(i, 1), wanted)
                total[present] += ends - starts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "df"])

    df = np.zeros(len(asked.terms), np.int64)
    for row in index.blocks.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return df


def bounds(index: Index, asked: Questions, weights: np.ndarray, k: int) -> DataFrame:
    """(item, block, slot, upper, lower) of the documents whose upper bound reaches the k-th lower one of their task so far."""
    sent = index.blocks.sparkSession.sparkContext.broadcast((asked.terms, weights.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w = sent.value
        wanted, best = pa.array(terms, pa.binary()), np.zeros((k, w.shape[1]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                present, starts, ends = _places(row, wanted)
                slots, levels = _numbers(row, "slots", np.uint16), _numbers(row, "levels", np.uint8)
                n = len(row.column("ids")[0].values)
                high, low = np.zeros((n, w.shape[1])), np.zeros((n, w.shape[1]))
                width = max(1, CELLS // max(1, n))
                for at in range(0, len(present), width):
                    own = slice(at, at + width)
                    table = _dense(starts[own], ends[own], slots, levels, n, np.float64)
                    high += table @ w[present[own]]
                    low += np.maximum(table - 1, 0) @ w[present[own]]
                best = np.partition(np.concatenate([best, low]), -k, axis=0)[-k:]
                slot, item = np.nonzero((high >= best[0]) & (high > 0))
                found = [item.astype(np.int32), np.full(len(item), row.column("block")[0].as_py()), slot.astype(np.int32)]
                found += [(x[slot, item] * STEP).astype(np.int64) for x in (high, low)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["item", "block", "slot", "upper", "lower"])

    read = index.blocks.select("block", "ids", "terms", "ends", "slots", "levels")
    return read.mapInArrow(run, "item int, block long, slot int, upper long, lower long")


def _rescored(index: Index, asked: Questions, weights: np.ndarray, wanted: DataFrame, id_col: str, item_type) -> DataFrame:
    """(item, item_id, id_col, score) of the wanted (block, [(item, slot)])."""
    sent = index.blocks.sparkSession.sparkContext.broadcast((asked.ids, asked.terms, weights))
    arrow, documents, terms_in_all = to_arrow_type(item_type), index.documents, index.terms
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, w = sent.value
        asked_terms = pa.array(terms, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                pairs = row.column("pairs")[0].values
                item, slot = (pairs.field(c).to_numpy() for c in ("item", "slot"))
                present, starts, ends = _places(row, asked_terms)
                slots, tfs = _numbers(row, "slots", np.uint16), _numbers(row, "tfs", np.int32)
                m = lengths(_numbers(row, "n", np.int32), documents, terms_in_all)
                score = np.zeros(len(item), np.int64)
                width = max(1, CELLS // len(m))
                for at in range(0, len(present), width):
                    own = slice(at, at + width)
                    tf = _dense(starts[own], ends[own], slots, tfs, len(m), np.int32)
                    for question in np.unique(item):
                        mine = np.flatnonzero(item == question)
                        having = np.flatnonzero(w[present[own], question])
                        counts = tf[np.ix_(slot[mine], having)].astype(np.int64)
                        score[mine] += impact(counts, m[slot[mine], None]) @ w[present[own]][having, question]
                found = [pa.array(item), pa.array([ids[x] for x in item.tolist()], arrow), row.column("ids")[0].values.take(pa.array(slot)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(found, ["item", "item_id", "_id", "score"])

    read = index.blocks.select("block", "ids", "terms", "n", "ends", "slots", "tfs").join(wanted, "block")
    return read.mapInArrow(run, f"item int, item_id {item_type.simpleString()}, _id {kind}, score long").withColumnRenamed("_id", id_col)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, rank, ``id_col`` and score of the ``k`` highest-scoring documents of every item, ties by ascending id."""
    item_type, out = items.schema[item_id].dataType, None
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    for asked in questions(items, item_id, item_text):
        df = _frequencies(index, asked)
        weights = asked.times * np.array([weight(index.documents, int(x)) for x in df], np.int64)[:, None]
        near = cut(bounds(index, asked, weights, k), "bounds")
        by_lower = Window.partitionBy("item").orderBy(F.desc("lower"))
        kth = near.withColumn("r", F.row_number().over(by_lower)).where(F.col("r") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("least"))
        reach = near.join(kth, "item").where("upper >= least")
        wanted = cut(reach.groupBy("block").agg(F.collect_list(F.struct("item", "slot")).alias("pairs")), "wanted")
        remove_cuts(near)
        # written block by block: only candidates, and no two blocks of items are in work, or sent to the tasks, at a time
        scored = cut(_rescored(index, asked, weights, wanted, id_col, item_type).where("score > 0"), "scored")
        remove_cuts(wanted)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc(id_col)))).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("item_id").alias(item_id), "rank", id_col, "score")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return items.sparkSession.createDataFrame([], f"{item_id} {item_type.simpleString()}, rank int, {id_col} {kind}, score long")
    return out

"""Exact Jaccard links inside crowds of texts that may be alike.

A crowd is whatever a coarse search has joined: its texts need not be alike,
but texts that are should be in one crowd. All of a crowd's texts are compared,
so no link is lost to the search's thinning.

Most crowds are small and are compared in one piece. A large one is cut into
blocks of texts of like size, and pairs of blocks are dealt over tasks: only
those whose sizes allow SIMILARITY, so a task holds two blocks and never the
crowd. Before that its texts are compared with one centre; those alike to it
are one component already and are not compared with each other, which leaves a
family around a centre linear. What remains is quadratic in the texts of a
crowd that are not alike to its centre.

Comparing is exact: shingles that two texts of a block pair share are columns
of a 0/1 table, and its product with itself counts what each pair has in
common. Links are thinned only after that, to as many as connect what they did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_cuts, slices, utf8

SIMILARITY = 0.8
#: Texts, and shingles of theirs, in a block.
TEXTS, SHINGLES = 256, 1 << 20
#: Cells of a table that is held at a time.
CELLS = 1 << 21
SALTS = 16

Shingles = Callable[[bytes], np.ndarray]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets in ascending order; texts without shingles are alike."""
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(x) + len(y) - shared)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a < b, of nodes under ``n``) join all that the links join and no more: links to the least nodes first."""
    label, left, kept = np.arange(n), np.arange(len(a)), []
    while len(left):
        x, y = label[a[left]], label[b[left]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        left, low, high = left[apart], low[apart], high[apart]
        order = np.lexsort((b[left], a[left], low, high))
        node, first = np.unique(high[order], return_index=True)
        kept.append(left[order[first]])
        up = np.arange(n)
        up[node] = low[order[first]]
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]
    return np.concatenate(kept) if kept else left


def alike(sets: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a < b) of sets with SIMILARITY or more: among all if ``left`` is their number, else of one of the first ``left`` and one of the rest."""
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1 if len(flat) else fresh
    owner, column = owner[often], column[often]
    fresh = np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else fresh[:0]
    column = np.cumsum(fresh) - 1
    rows = slice(0, left)
    others = rows if left == len(sets) else slice(left, len(sets))
    shared = np.zeros((left, others.stop - others.start), np.float32)
    width = max(1, CELLS // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[i:j], column[i:j] - at] = 1
        shared += table[rows] @ table[others].T
    union = n[rows, None] + n[None, others] - shared
    # counts under 2**24 are exact in these floats
    near = np.divide(shared, union, out=np.ones(union.shape), where=union > 0, dtype=np.float64) >= SIMILARITY
    a, b = np.nonzero(near)
    b = b + others.start
    return a[a < b], b[a < b]


def _compared(rows: DataFrame, shingles: Shingles) -> DataFrame:
    """(a, b) of the texts that are alike and meet under one (crowd, low, high), from (crowd, low, high, side, t, _text)."""

    def settle(texts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        texts.sort(key=lambda x: x[0])
        sides = [x[0] for x in texts]
        left = len(texts) if sides[0] == sides[-1] else sides.index(sides[-1])
        t = np.array([x[1] for x in texts], np.int64)
        a, b = alike([shingles(x[2]) for x in texts], left) if left < len(texts) or sides[0] == 0 else (t[:0], t[:0])
        kept = forest(a, b, len(texts))
        return pa.RecordBatch.from_arrays([pa.array(t[a[kept]]), pa.array(t[b[kept]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part in slices(batch, "_text"):
                keys = zip(*(part.column(c).to_pylist() for c in ("crowd", "low", "high")), strict=True)
                for key, side, t, text in zip(keys, part.column("side").to_pylist(), part.column("t").to_pylist(), utf8(part, "_text"), strict=True):
                    if key != now:
                        if len(held) > 1:
                            yield settle(held)
                        now, held = key, []
                    held.append((side, t, text))
        if len(held) > 1:
            yield settle(held)

    return rows.repartition("crowd", "low", "high").sortWithinPartitions("crowd", "low", "high").mapInArrow(run, "a long, b long")


def _centred(members: DataFrame, centres: DataFrame, shingles: Shingles) -> DataFrame:
    """(a, b): texts of ``members`` that are alike to their crowd's centre b, from (crowd, t, _text) and (crowd, centre, _centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for part in slices(batch, "_text"):
                right = []
                for centre, x, y in zip(part.column("centre").to_pylist(), utf8(part, "_text"), utf8(part, "_centre"), strict=True):
                    if centre != last:
                        last, own = centre, shingles(y)
                    right.append(jaccard(shingles(x), own) >= SIMILARITY)
                yield pa.RecordBatch.from_arrays([part.column("t"), part.column("centre")], ["a", "b"]).filter(pa.array(right, pa.bool_()))

    salted = centres.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = members.withColumn("_s", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["crowd", "_s"]).where("t != centre")
    return both.select("t", "centre", "_text", "_centre").mapInArrow(run, "a long, b long")


def links_within(crowds: DataFrame, texts: DataFrame, shingles: Shingles) -> DataFrame:
    """(a, b): enough links of SIMILARITY or more to join what all such links inside crowds join; a cut.

    ``crowds`` has (t, crowd, n, degree): a text, its crowd, the number of its shingles, and how many links the search found it;
    ``texts`` has (t, _text). A text is in one crowd.
    """
    sizes = crowds.groupBy("crowd").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.max_by("t", F.struct("degree", "t")).alias("centre"))
    large = cut(sizes.where((F.col("members") > TEXTS) | (F.col("shingles") > SHINGLES)).select("crowd", "centre"), "large")
    named = crowds.join(large, "crowd", "left")
    # no hash tables of texts: what a crowd brings grows with the input
    held = cut(named.join(texts.hint("merge"), "t").select("crowd", "centre", "t", "n", "_text"), "crowds")
    small = held.where("centre is null").select("crowd", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).alias("side"), "t", "_text")
    if not large.limit(1).count():
        found = cut(_compared(small, shingles), "alike")
        remove_cuts(large, held)
        return found
    crowded = held.where("centre is not null")
    centres = crowded.where("t = centre").select("crowd", "centre", F.col("_text").alias("_centre"))
    stars = cut(_centred(crowded.select("crowd", "t", "_text"), centres, shingles), "stars")
    # part 0 is one component: the centre and what is alike to it
    part = crowded.select("crowd", "centre", "t", "n").join(stars.select(F.col("a").alias("t"), F.lit(0).alias("near")), "t", "left")
    part = part.select("crowd", "t", F.when(F.expr("t = centre"), 0).otherwise(F.coalesce("near", F.lit(1))).alias("part"), F.when(F.col("n") > 0, F.floor(F.log("n") / -F.log(F.lit(SIMILARITY)))).otherwise(-1).cast("int").alias("k"))
    part = cut(part, "parts")
    room = F.greatest(F.lit(1), F.least(F.lit(TEXTS), F.floor(F.lit(SHINGLES) * F.pow(F.lit(SIMILARITY), F.col("k") + 1))))
    shape = cut(part.groupBy("crowd", "part", "k").agg(F.ceil(F.count("*") / F.first(room)).cast("int").alias("blocks")), "shape")
    mine = part.join(shape, ["crowd", "part", "k"]).select("crowd", "t", "part", "k", F.pmod(F.xxhash64("t"), F.col("blocks")).alias("block"))
    other = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p in (0, 1) for d in (-1, 0, 1)]))
    theirs = shape.select("crowd", F.col("part").alias("their_part"), F.col("k").alias("their_k"), "blocks")
    dealt = mine.withColumn("o", other).where("part + o.p > 0").select("crowd", "t", "part", "k", "block", F.col("o.p").alias("their_part"), F.expr("k + o.d").alias("their_k")).join(theirs, ["crowd", "their_part", "their_k"])
    dealt = dealt.withColumn("their_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    code = "cast({0}part as bigint) * 1099511627776 + (cast({0}k as bigint) + 1) * 4294967296 + {0}block"
    dealt = dealt.withColumn("x", F.expr(code.format(""))).withColumn("y", F.expr(code.format("their_")))
    dealt = dealt.select("crowd", "t", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), F.expr("case when x = y then 0 when x < y then 1 else 2 end").alias("side"))
    blocks = dealt.join(crowded.select("t", "_text").hint("merge"), "t").select("crowd", "low", "high", "side", "t", "_text")
    found = cut(_compared(small, shingles).union(_compared(blocks, shingles)).union(stars), "alike")
    remove_cuts(large, held, stars, part, shape)
    return found

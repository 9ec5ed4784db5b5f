"""Divergence of every source of a language from the others, and the terms that tell it apart.

A (lang, source) group and a lang have integer chances p of every kept term,
p = 1 + (10**9 * (count + 1)) div (N + V). The value of group s against t is
the sum over all V kept terms of (p - q)**2 div q, p being s's and q being t's:
nearly all of it from terms that neither has, at pair-of-groups cost for each.

So it is split by how many groups hold a term. A heavy term (in more than
LIGHT groups) goes through dense numpy tiles: chances of a run of terms in two
tiles of groups, all pairs at once. A light term starts from the chances p0 of
a count of nought on both sides, alike for every term, and is corrected:

    f(p, q) = f(p0, q0) + [f(p, q0) - f(p0, q0)] + [f(p0, q) - f(p0, q0)]
              + [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

The first is times the number of light terms; the next two are nought unless
that group has the term, so they come from each group's histogram of counts;
the last only from postings of both, at most LIGHT * (LIGHT - 1) a term. All
of it is integers, so the parts add up exactly.

Counts are summed per slice, then by (lang, source, term), then by (lang,
term): no task holds a group, and a hot source or term arrives as partial sums.
The groups of a language are broadcast: their pairs are the result, so they
are the square root of what the caller asked for.

Defined results: null text, lang or source is ''; repeated rows count each;
a group without kept terms has chances of nought for all; a lang without kept
terms gives 0 for every pair; a lang of one source has no pairs; an empty table
gives no rows; other columns are ignored whatever their names. Ids are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove_cuts, slices, utf8

#: Only letters and what is not ASCII stay; A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Groups that a light term is in at most; groups to the side of a tile; cells of a dense table held at a time.
LIGHT, TILE, CELLS = 6, 128, 1 << 20
#: Tiles of sums of a language that a task holds before it passes them on.
HELD = 64
SCALE = 1_000_000_000


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, df): occurrences of a term in a group, and its documents; a null term for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                n, df = {}, {}
                for text, *key in zip(utf8(part, "_text"), part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
                    own = text.translate(LETTERS).split()
                    group = tuple(key)
                    n.setdefault(group, Counter()).update(own)
                    df.setdefault(group, Counter()).update(set(own))
                rows = [(*group, None, 0, 0) for group in n] + [(*group, term, k, df[group][term]) for group in n for term, k in n[group].items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["lang", "source", "term", "n", "df"])

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "_text"), (lang_col, "lang"), (source_col, "source"))]
    found = docs.select(*columns).mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).withColumn("term", F.col("term").cast("string"))


def chance(count: str, total: str, terms: str) -> Column:
    """1 + (10**9 * (count + 1)) div (total + terms), by decimals where the product passes a long."""
    short = f"1 + ({SCALE} * ({count} + 1)) div ({total} + {terms})"
    return F.expr(f"case when {count} < 9000000000 then {short} else 1 + cast((cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} + {terms} as decimal(19,0)) as long) end")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = 3, top: int = 200, light: int = LIGHT, tile: int = TILE, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the lang, part ``term`` the ``top`` terms over their share in the lang.

    ``light``, ``tile`` and ``held`` (see LIGHT, TILE, HELD) change how the work is split, not the result.
    """
    found = cut(counts(docs, text_col, lang_col, source_col), "counts")
    per_term = found.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("in_lang"), F.count("*").alias("held"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = cut(per_term.where(F.col("df") >= least_documents).select("lang", "term", "in_lang", "held", "postings"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("total_in_lang"), F.sum((F.col("held") <= light).cast("long")).alias("light"))
    own = kept.select("lang", F.explode("postings").alias("x")).select("lang", "x.*").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "total_in_lang", "light")])
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, chance("0L", "total", "terms")).otherwise(1)), "groups")
    remove_cuts(found)

    pairs = _ranked(pair_values(kept, groups, light, tile, held), "pair")
    each = kept.select("lang", "term", "in_lang", F.explode("postings").alias("x")).select("lang", "term", "in_lang", "x.source", "x.n").join(groups, ["lang", "source"])
    each = each.withColumn("p", chance("n", "total", "terms")).withColumn("q", chance("in_lang", "total_in_lang", "terms")).where("p > q")
    terms = _ranked(each.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value")), "term", top)
    return pairs.union(terms)


def _ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = values.withColumn("rank", F.row_number().over(by_value))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _chances(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    if len(n) and n.max() >= 9_000_000_000:
        return np.array([1 + SCALE * (int(a) + 1) // (int(b) + terms) for a, b in zip(n, total, strict=True)], np.int64)
    return 1 + SCALE * (n + 1) // (total + terms)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


class Sums:
    """Sums of pairs of groups of one language, in tiles of ``side`` x ``side``, of which it holds ``most``."""

    def __init__(self, sources: int, side: int, most: int):
        self.sources, self.side, self.most, self.tiles = sources, side, most, {}

    def tile(self, i: int, j: int) -> np.ndarray:
        if (i, j) not in self.tiles:
            self.tiles[i, j] = np.zeros((min(self.side, self.sources - i * self.side), min(self.side, self.sources - j * self.side)), np.int64)
        return self.tiles[i, j]

    def rows(self) -> Iterator[Rows]:
        """The sums so far as (s, t, sum), which are then forgotten."""
        for (i, j), tile in self.tiles.items():
            s, t = np.nonzero(tile)
            yield s + i * self.side, t + j * self.side, tile[s, t]
        self.tiles = {}

    def over(self) -> Iterator[Rows]:
        """The same where too many tiles are held."""
        if len(self.tiles) > self.most:
            yield from self.rows()


def dense(sums: Sums, term: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[Rows]:
    """Adds f of all pairs of groups over the terms numbered in ``term`` (ascending), each with the groups and chances of its postings."""
    side = sums.side
    cells = min(side, len(p0)) ** 2
    width, last = max(1, CELLS // max(1, cells)), int(term[-1]) + 1 if len(term) else 0
    mine = []
    for i in range(0, len(p0), side):
        own = np.flatnonzero(group // side == i // side)
        mine.append((term[own], group[own] - i, p[own], p0[i : i + side]))

    def table(i: int, at: int) -> np.ndarray:
        terms, column, chance, rest = mine[i]
        a, b = np.searchsorted(terms, [at, at + width])
        out = np.repeat(rest[None, :], min(width, last - at), axis=0)
        out[terms[a:b] - at, column[a:b]] = chance[a:b]
        return out

    for i in range(len(mine)):
        for j in range(len(mine)):
            for at in range(0, last, width):
                x = table(i, at)
                y = x if i == j else table(j, at)
                sums.tile(i, j)[...] += f(x[:, :, None], y[:, None, :]).sum(0)
            yield from sums.over()


def sparse(sums: Sums, starts: np.ndarray, held: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray, light: int) -> Iterator[Rows]:
    """Adds what pairs of postings of light terms change beyond what each changes alone; terms of ``held`` postings from ``starts`` on."""
    side = sums.side
    n = -(-len(p0) // side)
    for k in range(2, light + 1):
        first = starts[held == k]
        for a, b in ((a, b) for a in range(k) for b in range(k) if a != b):
            s, t = first + a, first + b
            ps, pt, s0, t0 = p[s], p[t], p0[group[s]], p0[group[t]]
            more, s, t = f(ps, pt) - f(ps, t0) - f(s0, pt) + f(s0, t0), group[s], group[t]
            key = s // side * n + t // side
            for x in np.unique(key):
                own = key == x
                np.add.at(sums.tile(int(x) // n, int(x) % n), (s[own] % side, t[own] % side), more[own])
                yield from sums.over()


def alone(sums: Sums, group: np.ndarray, p: np.ndarray, times: np.ndarray, p0: np.ndarray) -> Iterator[Rows]:
    """Adds what postings of light terms change against groups that lack the term: a group's chance p, as often as it has it."""
    side = sums.side
    for s in np.unique(group):
        own = np.flatnonzero(group == s)
        i, row = int(s) // side, int(s) % side
        for at in range(0, len(p0), side):
            q0, j = p0[at : at + side], at // side
            for few in range(0, len(own), CELLS // side):
                part = own[few : few + CELLS // side]
                ps, n = p[part][:, None], times[part][:, None]
                sums.tile(i, j)[row, :] += ((f(ps, q0[None, :]) - f(p0[s], q0)[None, :]) * n).sum(0)
                sums.tile(j, i)[:, row] += ((f(q0[None, :], ps) - f(q0, p0[s])[None, :]) * n).sum(0)
            yield from sums.over()


def pair_values(kept: DataFrame, groups: DataFrame, light: int, tile: int, held: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of groups of a language."""
    spark = kept.sparkSession
    listed: dict[str, list] = {}
    for row in groups.orderBy("lang", "source").collect():
        listed.setdefault(row.lang, []).append(row)
    known = {
        lang: ({x.source: i for i, x in enumerate(own)}, np.array([x.total for x in own], np.int64), np.array([x.p0 for x in own], np.int64), own[0].terms)
        for lang, own in listed.items()
    }
    sent = spark.sparkContext.broadcast(known)

    def batch_of(lang: str, rows: Rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows[0]), pa.string()), *map(pa.array, rows)], ["lang", "s", "t", "value"])

    def by_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: Sums(len(x[2]), tile, held) for lang, x in sent.value.items()}
        for batch in batches:
            for lang, part in _by_lang(batch):
                numbers, total, p0, terms = sent.value[lang]
                n = part.column("held").to_numpy()
                source = part.column("source").flatten().to_pylist()
                group = np.fromiter(map(numbers.__getitem__, source), np.int64, len(source))
                p = _chances(part.column("n").flatten().to_numpy(), total[group], terms)
                heavy = n > light
                own = np.repeat(heavy, n)
                term = np.repeat(np.arange(heavy.sum()), n[heavy])
                for rows in dense(sums[lang], term, group[own], p[own], p0):
                    yield batch_of(lang, rows)
                for rows in sparse(sums[lang], np.cumsum(n) - n, n, group, p, p0, light):
                    yield batch_of(lang, rows)
        for lang in sums:
            for rows in sums[lang].rows():
                yield batch_of(lang, rows)

    def by_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: Sums(len(x[2]), tile, held) for lang, x in sent.value.items()}
        for batch in batches:
            for lang, part in _by_lang(batch):
                numbers, total, p0, terms = sent.value[lang]
                group = np.array([numbers[x] for x in part.column("source").to_pylist()], np.int64)
                p = _chances(part.column("n").to_numpy(), total[group], terms)
                for rows in alone(sums[lang], group, p, part.column("times").to_numpy(), p0):
                    yield batch_of(lang, rows)
        for lang in sums:
            for rows in sums[lang].rows():
                yield batch_of(lang, rows)

    schema = "lang string, s long, t long, value long"
    postings = kept.select("lang", "held", F.col("postings.source").alias("source"), F.col("postings.n").alias("n"))
    histogram = kept.where(F.col("held") <= light).select("lang", F.explode("postings").alias("x")).select("lang", "x.*")
    histogram = histogram.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    parts = postings.mapInArrow(by_terms, schema).union(histogram.mapInArrow(by_counts, schema))
    summed = cut(parts.groupBy("lang", "s", "t").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")), "sums")

    def numbered(name: str) -> DataFrame:
        rows = [(lang, i, x.source, x.p0, x.light) for lang, own in listed.items() for i, x in enumerate(own)]
        return spark.createDataFrame(rows, f"lang string, {name} long, {name}_source string, {name}0 long, light long")

    pairs = numbered("s").join(F.broadcast(numbered("t").drop("light")), "lang").where("s != t").join(summed, ["lang", "s", "t"], "left")
    base = F.expr("((s0 - t0) * (s0 - t0)) div t0").cast("decimal(38,0)") * F.col("light")
    value = (F.coalesce(F.col("value"), F.lit(0).cast("decimal(38,0)")) + base).cast("long")
    return pairs.select("lang", F.col("s_source").alias("source"), F.col("t_source").alias("item"), value.alias("value"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language."""
    langs = batch.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        yield lang, batch.filter(pa.array([x == lang for x in langs]))

"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Every text gets counts, the counts a vector of transformed statistics, and
every (lang, source) group a minimum-covariance-determinant estimate. From
each of several starts (median and median deviation; mean and covariance; mean and
covariance of the half nearest to the median; and of ``DRAWN`` parts of the rows,
drawn by a hash of the vector) concentration steps keep the
``SHARE`` of rows that lie nearest and take mean and covariance of those, until
no determinant falls any more; of a group's starts, that of the least determinant
counts. A row is rejected if its Mahalanobis distance from the estimate passes
``CUTOFF``.

Distances come from a Cholesky factor spelt out as column expressions, so rows
are judged inside code generation. Quantiles are exact on a grid (``GRID`` cells
to a unit, or to a doubling of a distance): counts by cell, which are combined
before the shuffle, then a running sum over cells. So no quantile depends on how rows are
partitioned, and a group with a third of the rows sends a few rows per task.
Means and products are plain sums. Groups reach rows by a broadcast
if they are few (``MAX_GROUPS``), else by a shuffled join that Spark can split.

Defined results: null text has no words and fails the base rules; null lang
and null source are groups like any other; a group of any size has an estimate
of its own, in which ``FLOOR`` is added to each variance, so a group of one row, or of
equal rows, keeps them; repeated rows and ids keep their rows; empty tables give
none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove_cuts

#: White space that parts words, and characters that count as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Concentration steps at most, and the share of rows they keep.
MAX_STEPS, SHARE = 30, 0.75
#: Cells of a unit of a statistic, and of a doubling of a distance.
GRID = 1024
#: Parts of the rows that are starts, and how many parts there are in a draw.
DRAWN, PARTS = 5, 4
STARTS = 3 + DRAWN
#: Squared Mahalanobis distance beyond which a row is an outlier; far above the normal quantile, for skewed statistics.
CUTOFF = 60.0
MAX_GROUPS = 20_000
STATISTICS = ["s0", "s1", "s2", "s3"]


def counts(df: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = F.translate(text, BLANKS, " " * len(BLANKS))
    split = df.select(
        *keep,
        F.array_remove(F.split(blank, " "), "").alias("_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
    )
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    names = [c for c in split.columns if not c.startswith("_")]
    hashed = split.select(
        *names, n.cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_w")
    )
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    # windows in order of hash: equal ones are neighbours, their positions are those of repeated windows
    ordered = hashed.withColumn("_o", F.when(some, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_o", lambda x, k: (x["h"] == F.get("_o", k - 1)["h"]) | (x["h"] == F.get("_o", k + 1)["h"]))
    # null neighbours at the ends make the test null, which a filter takes as false only if the other side fails too
    at = F.array_sort(F.transform(again, lambda x: x["i"]))
    placed = ordered.withColumn("_at", at)
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))
    return placed.select(
        *[c for c in names if c not in ("word_chars", "n_symbols")], "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words")
    )


def statistics() -> list[Column]:
    """The transformed vector: length, word length, symbols and repetition, each on a scale where clean texts are compact."""
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("s0"),
        F.log((F.col("word_chars") + 1) / w).alias("s1"),
        F.sqrt(F.col("n_symbols") / w).alias("s2"),
        F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / w).alias("s3"),
    ]


#: Least variance of each statistic: what varies less is taken as this spread.
FLOOR = [0.25, 0.0025, 0.0025, 0.01]


def _factor(est: DataFrame, keys: list[str]) -> DataFrame:
    """The Cholesky factor of each group's covariance, computed once a group."""
    d = len(STATISTICS)
    out = est
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] * 1e-3))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*keys, *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Adds _d2 from columns m*, l*: forward substitution."""
    d = len(STATISTICS)
    for i, s in enumerate(STATISTICS):
        top = F.col(s) - F.col(f"m{i}")
        for k in range(i):
            top = top - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", top / F.col(f"l{i}{i}"))
    return df.withColumn("_d2", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, d)), F.col("_z0") * F.col("_z0"))).drop(*[f"_z{i}" for i in range(d)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = len(STATISTICS)
    sums = [F.count("*").alias("n")] + [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)]
    sums += [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"_c{i}{j}") for i in range(d) for j in range(i, d)]
    out = rows.groupBy(*keys).agg(*sums)
    return out.select(*keys, "n", *[f"m{i}" for i in range(d)], *[(F.col(f"_c{i}{j}") + (FLOOR[i] if i == j else 0)).alias(f"c{i}{j}") for i in range(d) for j in range(i, d)])


def _attach(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(est) if few else est, "_g")


def _quantile(cells: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``keys`` and the least _cell that covers the share of a group's rows."""
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    upto, whole = Window.partitionBy(*keys).orderBy("_cell"), Window.partitionBy(*keys)
    placed = counts.withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole)})
    return placed.where(F.col("_to") >= F.ceil(F.lit(share) * F.col("_all"))).groupBy(*keys).agg(F.min("_cell").alias("_cell"))


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """_g and the median of each value on the grid, as columns name0, name1, ..."""
    cells = rows.select("_g", F.posexplode(F.array(*[F.round(v * GRID).cast("long") for v in values])).alias("_k", "_cell"))
    found = _quantile(cells, ["_g", "_k"], 0.5)
    return found.groupBy("_g").agg(*[F.max(F.when(F.col("_k") == i, F.col("_cell") / GRID)).alias(f"{name}{i}") for i in range(len(values))])


def _distance_cell(d2: Column) -> Column:
    """The cell of a squared distance: GRID of them for each doubling."""
    return F.ceil(F.log2(F.greatest(d2, F.lit(1e-9))) * GRID).cast("long")


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Centre and Cholesky factor of every start of every group; _g is the group, then the start's number."""
    d = len(STATISTICS)
    middle = _medians(vectors, [F.col(s) for s in STATISTICS], "m")
    off = _medians(_attach(vectors, middle, few), [F.abs(F.col(s) - F.col(f"m{i}")) for i, s in enumerate(STATISTICS)], "a")
    spread = middle.join(off, "_g").select(
        "_g", *[f"m{i}" for i in range(d)],
        *[(F.lit(0.0) if i != j else F.pow(F.col(f"a{i}") * 1.4826, 2) + FLOOR[i]).alias(f"c{i}{j}") for i in range(d) for j in range(i, d)],
    )
    spread = cut(_factor(spread, ["_g"]), "start")
    near = _distance(_attach(vectors, spread, few)).withColumn("_cell", _distance_cell(F.col("_d2")))
    half = _quantile(near.select("_g", "_cell"), ["_g"], 0.5).withColumnRenamed("_cell", "_limit")
    inner = _attach(near, half, few).where("_cell <= _limit").select("_g", *STATISTICS)
    each = [spread, _factor(_moments(vectors, ["_g"]), ["_g"]), _factor(_moments(inner, ["_g"]), ["_g"])]
    # a row is in one part of each draw; DRAWN parts of as many draws as they take
    for k in range(DRAWN):
        draw = F.pmod(F.xxhash64(*STATISTICS, F.lit(k // PARTS)), F.lit(PARTS)) == k % PARTS
        each.append(_factor(_moments(vectors.where(draw), ["_g"]), ["_g"]))
    out = each[0].withColumn("_start", F.lit(0))
    for k, x in enumerate(each[1:], 1):
        out = out.unionByName(x.withColumn("_start", F.lit(k)))
    return out.withColumn("_g", F.concat("_g", F.lit(" "), F.col("_start").cast("string"))).drop("_start")


def _determinant() -> Column:
    """Twice the log of a factor's diagonal: the log of the determinant."""
    return sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(1, len(STATISTICS))), F.log(F.col("l00")) * 2)


def estimates(vectors: DataFrame, few: bool) -> DataFrame:
    """One row a group (column _g): centre m* and Cholesky factor l* of its minimum-covariance-determinant estimate, and _det, the log of its determinant."""
    each = vectors.withColumn("_g", F.explode(F.array(*[F.concat("_g", F.lit(f" {k}")) for k in range(STARTS)])))
    factor = cut(_starts(vectors, few).withColumn("_det", F.lit(float("inf"))), "estimate")
    for _ in range(MAX_STEPS):
        near = _distance(_attach(each, factor.drop("_det"), few)).withColumn("_cell", _distance_cell(F.col("_d2")))
        limit = _quantile(near.select("_g", "_cell"), ["_g"], SHARE).withColumnRenamed("_cell", "_limit")
        kept = _attach(near, limit, few).where("_cell <= _limit").select("_g", *STATISTICS)
        after = _factor(_moments(kept, ["_g"]), ["_g"]).withColumn("_det", _determinant())
        # a start that doesn't fall any more stays where it is
        columns = [c for c in factor.columns if c != "_g"]
        new, old = F.struct(*[F.col(f"n.{c}") for c in columns]), F.struct(*[F.col(f"o.{c}") for c in columns])
        falls = F.col("n._det") < F.col("o._det") - 1e-6
        step = factor.alias("o").join(after.alias("n"), "_g").select("_g", F.when(falls, new).otherwise(old).alias("x"), falls.alias("_moved"))
        step = cut(step.select("_g", "x.*", "_moved"), "estimate")
        remove_cuts(factor)
        moved = step.where("_moved").limit(1).count()
        folder, factor = step.folder, step.drop("_moved")
        factor.folder = folder
        if not moved:
            break
    group = F.regexp_replace("_g", " [0-9]+$", "")
    best = factor.groupBy(group.alias("_g")).agg(F.min(F.struct("_det", *[c for c in factor.columns if c not in ("_g", "_det")])).alias("x"))
    return best.select("_g", "x.*")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``id_col``, the counts, base_failed, kept and distance (null where the base rules fail) of every row."""
    group = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    counted = cut(counts(df, [F.col(id_col).alias("id"), group.alias("grp")], text_col), "counts")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    few = counted.where(~failed).select("grp").distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    vectors = counted.withColumn("base_failed", failed).withColumnRenamed("grp", "_g").select("*", *statistics())
    fit = cut(vectors.where(~F.col("base_failed")).select("_g", *STATISTICS), "vectors")
    factor = cut(estimates(fit, few).drop("_det"), "factor")
    remove_cuts(fit)
    judged = _distance(vectors.join(F.broadcast(factor) if few else factor, "_g", "left"))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("_d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.when(~F.col("base_failed"), F.col("_d2")).alias("distance"),
    )

"""Connected components of a link table, in rounds of joins and partial sums.

Alternates two contractions until nothing moves: every node hands its larger
neighbours to the least node it knows, then its smaller ones. The number of
rounds grows with the logarithm of the number of nodes. Links are kept as
(a, b) with a > b, so a hub is the ``b`` of many rows; joins on ``b`` carry a
salt from ``a``, hence no task gets a whole hub. Every round is written to
the shared folder and deleted after the next; nothing is collected but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_cuts

SALTS = 16
MAX_ROUNDS = 60


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_least(links: DataFrame, on: str, least: DataFrame) -> DataFrame:
    """``links`` with column m: the least smaller neighbour of column ``on``, null for a root."""
    other = "a" if on == "b" else "b"
    salted = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("_s", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted.withColumnRenamed("n", on), [on, "_s"], "left").drop("_s")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link with another; root: the least node it reaches.

    ``links`` has columns a and b of one ordered type. Links of a node to itself and null ends are
    ignored; repeated links count once; no links give no rows. Raises if MAX_ROUNDS don't suffice.
    """
    now = cut(_oriented(links.select("a", "b").dropna()), "links")
    if not now.limit(1).count():
        return _named(now)
    for _ in range(MAX_ROUNDS):
        least = now.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        # larger neighbours of b go to b's least neighbour
        large = _oriented(_with_least(now, "b", least).select("a", F.coalesce("m", "b").alias("b")))
        # smaller neighbours of a, and a itself, go to a's least one
        large = cut(large, "links")
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = _with_least(large, "a", least)
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = cut(_oriented(small), "links")
        settled = _same(now, after)
        remove_cuts(now, large)
        now = after
        if settled:
            return _named(now)
    raise RuntimeError("components did not settle")


def _named(links: DataFrame) -> DataFrame:
    """The links as nodes and roots, still a cut."""
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.folder = links.folder
    return out


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two link tables are equal, by count and an order-free digest."""
    both = [df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for df in (x, y)]
    return both[0] == both[1]

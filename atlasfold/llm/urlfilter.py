"""URL filters: a cascade of Bloom filters gives exact membership without joins, in DataFrame functions only.

Over a known universe of keys, level 1 holds the listed keys; level 2 holds
the unlisted keys that level 1 lets through, level 3 the listed keys that
level 2 lets through, and so on until a level lets nothing through. A key is
listed exactly if the first level that refuses it has an even number. The universe here is
complete: every host of the corpus. So every answer is exact, with no false
positive left.

Each level is an array of 64-bit words made by a grouped bit_or, which
combines before the shuffle, and is read as a scalar subquery: a constant of
the plan, not a join. A level's size follows the number of its keys, at
``BITS_PER_KEY``. More than ``MAX_KEYS`` listed keys are dealt by a hash to
shards of about that many, each with levels of its own, so that no array is
over some 24 MB; a key asks its own shard. Which keys of the universe are listed
is found by grouping both, so building takes no join either.

Rules (host suffix and path prefix) come first; the longest that fits wins.
Urls without a rule get the cascade's verdict on their host.

Defined results: a null url or one without :// has empty host and path, fits
no rule and, the empty host never being listed, is allowed; null page ids and repeated
rows keep their rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BITS_PER_KEY, HASHES, MAX_LEVELS = 12, 3, 40
#: Listed keys of a shard on average: 12 bits each, some 24 MB an array.
MAX_KEYS = 1 << 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, upper, upper.lower()), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    rule, verdict = F, F
    for i, (what, h, p) in enumerate(sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = rule.when(fits, F.lit(h + p))
        verdict = verdict.when(fits, F.lit(what))
    return rule, verdict


def _slots(key: Column, level: int, bits: Column) -> list[Column]:
    """The bit numbers of a key at a level, by hashes of the key and a salt."""
    return [F.pmod(F.xxhash64(key, F.lit(HASHES * level + i)), bits) for i in range(HASHES)]


def _words(n: int) -> int:
    return max(2, -(-n * BITS_PER_KEY // 64))


def _filter(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row, one array of ``words`` longs: the level's bits."""
    bits = F.lit(words * 64).cast("long")
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("slot"))
    word = F.floor(F.col("slot") / 64).cast("int")
    set_ = slots.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))).alias("v"))
    # words that no key sets are zero
    filled = set_.unionByName(keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("v"))).groupBy("w").agg(F.bit_or("v").alias("v"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))


def _passes(key: Column, level: int, words: int, bits: Column) -> Column:
    n = F.lit(words * 64).cast("long")
    hit = [F.call_function("getbit", F.get(bits, F.floor(s / 64).cast("int")), F.pmod(s, F.lit(64)).cast("int")) == 1 for s in _slots(key, level, n)]
    return hit[0] & hit[1] & hit[2]


class Cascade:
    """Levels of bit arrays over a list and the complete universe of keys; ``listed`` is a column expression."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """Both with a column ``key``; keys of ``listed`` outside the universe are no harm, nulls are ignored."""
        both = universe.select("key", F.lit(False).alias("own")).union(listed.select("key", F.lit(True)))
        keys = cut(both.where("key is not null").groupBy("key").agg(F.max("own").alias("own")), "keys")
        self.n_shards = max(1, -(-keys.where("own").count() // MAX_KEYS))
        self.shards = [self._levels(keys.where(self._shard(F.col("key")) == s)) for s in range(self.n_shards)]

    def _shard(self, key: Column) -> Column:
        # a salt that no level uses
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.n_shards))

    @staticmethod
    def _levels(keys: DataFrame) -> list[tuple[int, DataFrame]]:
        levels: list[tuple[int, DataFrame]] = []
        ours, others = keys.where("own").select("key"), keys.where("not own").select("key")
        while n := ours.count():
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade did not settle")
            level, words = len(levels) + 1, _words(n)
            levels.append((words, cut(_filter(ours, level, words), "level")))
            through = others.where(_passes(F.col("key"), level, words, levels[-1][1].scalar()))
            ours, others = cut(through, "through"), ours
        return levels

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed: refused first by an even level, or by none of an odd number."""
        found = F
        for s, levels in enumerate(self.shards):
            answer = F.lit(len(levels) % 2 == 1)
            for level in range(len(levels), 0, -1):
                words, bits = levels[level - 1]
                answer = F.when(_passes(key, level, words, bits.scalar()), answer).otherwise(F.lit(level % 2 == 0))
            found = found.when(self._shard(key) == s, answer)
        return F.coalesce(found, F.lit(False))


def verdicts(pages: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule and verdict of every row.

    ``listed`` (column ``key``: hosts to block where no rule fits) defaults to the hosts of which
    the rules block more urls than they allow.
    """
    host, path = parts(F.col(url_col))
    cols = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    seen = cols.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_by_rule"))
    by_host = seen.where("host != ''").groupBy(F.col("host").alias("key")).agg(
        F.sum(F.when(F.col("_by_rule") == "block", 1).when(F.col("_by_rule") == "allow", -1).otherwise(0)).alias("n")
    )
    if listed is None:
        by_host = cut(by_host, "hosts")
        listed = by_host.where("n > 0")
    cascade = Cascade(by_host.select("key"), listed.select("key"))
    blocked = cascade.listed(F.col("host")) & (F.col("host") != "")
    return seen.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    )

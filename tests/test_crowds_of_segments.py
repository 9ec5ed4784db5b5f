"""First matches among crowds of segments: the same as by all pairs, for a number of pairs that follows the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasfold.operators import linemap, lines

SEG = "graph_id long, seg_id long, x0 double, y0 double, x1 double, y1 double, c0 double, c1 double"


def crowd(n, spread, seed=3):
    g = np.random.default_rng(seed)
    return [(int(i % 2), int(i), *map(float, g.normal(0, spread, 4)), 0.002, 0.003) for i in range(n)]


def by_all_pairs(new, master, later):
    def first(n):
        for m in sorted(master, key=lambda m: m[1]):
            if m[0] != n[0] or (later and m[1] <= n[1]):
                continue
            p, d = np.array(m[2:4]), np.array(m[4:6]) - np.array(m[2:4])
            a, b = np.array(n[2:4]), np.array(n[4:6])
            t = [float(d @ (e - p) / (d @ d)) for e in (a, b)]
            own = [(m[6] if x < 0 else m[7] if x > 1 else (1 - x) * m[6] + x * m[7]) + n[6 + i] for i, x in enumerate(t)]
            chi = [float(((p + x * d - e) ** 2).sum() / c) for x, e, c in zip(t, (a, b), own, strict=True)]
            apart = max(t) < 0 or min(t) > 1
            if not apart and max(chi) < 50 and abs(d @ (b - a)) / np.hypot(*d) / np.hypot(*(b - a)) > 0.5:
                return m[1]
        return None

    return {(n[0], n[1]): f for n in new if (f := first(n)) is not None}


@pytest.mark.parametrize("later", [False, True])
def test_first_matches_equal_all_pairs(spark, monkeypatch, later):
    monkeypatch.setattr(lines, "FIRST", 3)  # so that there are rounds
    monkeypatch.setattr(lines, "GROWTH", 2)
    rows = crowd(160, 1.0)
    new, master = (rows, rows) if later else (rows[:70], rows[70:])
    df = [spark.createDataFrame(x, SEG) for x in (new, master)]
    if later:
        wide = [x.select("*", *[F.col(f"c{e}").alias(f"c{e}{k}") for e in (0, 1) for k in ("xx", "yy")], F.lit(0.0).alias("c0xy"), F.lit(0.0).alias("c1xy")) for x in df]
        got = linemap.match(*wide, ["graph_id"], 1.2, later=True).collect()
    else:
        got = lines.match(*df, ["graph_id"], 1.2).collect()
    assert len(got) > 20 and {(r.graph_id, r.new_id): r.master_id for r in got} == by_all_pairs(new, master, later)
    assert not lines.match(df[0].limit(0), df[1], ["graph_id"], 1.2).count() and not lines.match(df[0], df[1].limit(0), ["graph_id"], 1.2).count()


def test_pairs_of_a_crowd_follow_its_size(spark):
    """Of 3,000 segments that all match each other, all pairs would be 2,250,000, met in a cell or more each."""
    same = spark.createDataFrame([(0, i, 0.1, 0.1, 0.3, 0.2, 0.002, 0.003) for i in range(3000)], SEG)
    tried = []

    def test(pairs):
        tried.append(pairs.count())
        return pairs.withColumns({"t1": F.lit(0.0), "t2": F.lit(1.0), "ok": F.lit(True)})

    got = lines.first_matches(same.where("seg_id % 2 = 1"), same.where("seg_id % 2 = 0"), ["graph_id"], 1.2, ["c0", "c1"], test)
    assert got.where("master_id = 0").count() == 1500 and sum(tried) <= 1500 * lines.FIRST * 4

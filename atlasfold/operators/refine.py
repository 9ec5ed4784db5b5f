"""Poses refined under any registered residuals, loops included: damped Gauss-Newton steps by distributed conjugate gradients.

Loop closures break the band that a chain has, so the normal equations are kept
as a table of 3x3 blocks (graph_id, i, j) and never as one graph's matrix. A
product with a vector is a join on j and a sum by i; a graph's steps and
residual norms are sums by graph. All graphs advance together, every round of
a loop is one written table. Graphs of up to DIRECT poses are spared that: their
systems are bounded, so each is solved whole where it is summed. The same
gradients are taken inside a task, without rounds of Spark, for graphs of up to
WHOLE blocks, many of them at once.

The preconditioner cuts trajectories into stretches of ``stretch`` poses and
solves the chain's own blocks of each exactly; it is positive definite because
every residual adds its whole diagonal to it. Odometry is nearly all of a
graph, so few rounds are left for the loops. A task holds some stretches, or
graphs, together, or one graph of at most DIRECT poses or WHOLE blocks.

Defined results: poses that no residual mentions, and the first pose of every
graph, stay as they are; residual rows with an unknown pose are left out; null
or missing weights are 1; a graph without residuals keeps its poses at cost 0;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import wrap
from ..functions.registry import REGISTRY, Residual, evaluate, values
from ..snapshot import cut, remove
from .solve import _reduced, together

POSE = ("x", "y", "th")
BLOCK = [f"a{k}" for k in range(9)]
SLOPE = ["g0", "g1", "g2"]
#: Poses of a graph whose system is solved in one piece: 768 unknowns, some five megabytes.
DIRECT = 256
#: Blocks of a graph whose gradients are taken in one task: some 20 megabytes, and the vectors.
WHOLE = 1 << 18


def three(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(3)]


def _at_poses(residual: Residual, rows: DataFrame, poses: DataFrame) -> DataFrame:
    """A residual's rows with the poses they are about: graph_id, i, j, the data columns, weight, and both poses."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    second = F.col("j") if residual.poses == 2 else F.col("i")
    own = rows.select("graph_id", F.col("i").cast("long").alias("i"), second.cast("long").alias("j"), weight.cast("double").alias("_weight"), *[F.col(k).cast("double").alias(f"_{k}") for k in residual.columns])
    for end, mark in (("i", "0"), ("j", "1"))[: residual.poses]:
        own = own.join(poses.select("graph_id", F.col("pose_id").cast("long").alias(end), *[F.col(k).alias(f"{k}{mark}") for k in POSE]), ["graph_id", end])
    return own


def _arrays(residual: Residual, frame: pd.DataFrame) -> tuple:
    first = frame[[f"{k}0" for k in POSE]].to_numpy(float)
    second = frame[[f"{k}1" for k in POSE]].to_numpy(float) if residual.poses == 2 else None
    return first, second, {k: frame[f"_{k}"].to_numpy(float) for k in residual.columns}


def normal_equations(poses: DataFrame, terms: Mapping[str, DataFrame], registry: Mapping[str, Residual] = REGISTRY) -> DataFrame:
    """Blocks (graph_id, i, j, a0..a8) of the sum of J'J, row by row, in both directions; those with i = j carry the gradient J'r and the cost."""
    parts = None
    for name, rows in terms.items():
        residual = registry[name]

        def run(frames: Iterator[pd.DataFrame], residual: Residual = residual) -> Iterator[pd.DataFrame]:
            for frame in frames:
                w = frame["_weight"].to_numpy(float)
                r, slopes = evaluate(residual, *_arrays(residual, frame))
                j = slopes.reshape(len(r), residual.poses, 3, -1)
                ends = [frame["i"].to_numpy(), frame["j"].to_numpy()][: residual.poses]
                out = []
                for p, at in enumerate(ends):
                    for q, to in enumerate(ends):
                        block = np.einsum("mkn,mln,n->nkl", j[:, p], j[:, q], w).reshape(-1, 9)
                        slope = np.einsum("mkn,mn,n->nk", j[:, p], r, w) if p == q else np.zeros((len(w), 3))
                        cost = (r * r).sum(0) * w / 2 if p == q == 0 else np.zeros(len(w))
                        own = pd.DataFrame(np.column_stack([block, slope, cost]), columns=[*BLOCK, *SLOPE, "cost"])
                        own.insert(0, "graph_id", frame["graph_id"].to_numpy())
                        own.insert(1, "i", at)
                        own.insert(2, "j", to)
                        out.append(own)
                yield pd.concat(out).groupby(["graph_id", "i", "j"], as_index=False).sum()

        found = _at_poses(residual, rows, poses).mapInPandas(run, f"graph_id long, i long, j long, {', '.join(f'{k} double' for k in [*BLOCK, *SLOPE, 'cost'])}")
        parts = found if parts is None else parts.unionByName(found)
    return parts.groupBy("graph_id", "i", "j").agg(*[F.sum(k).alias(k) for k in [*BLOCK, *SLOPE, "cost"]])


def costs(poses: DataFrame, terms: Mapping[str, DataFrame], registry: Mapping[str, Residual] = REGISTRY) -> DataFrame:
    """(graph_id, cost): half the weighted sum of squares."""
    parts = None
    for name, rows in terms.items():
        residual = registry[name]

        def run(frames: Iterator[pd.DataFrame], residual: Residual = residual) -> Iterator[pd.DataFrame]:
            for frame in frames:
                r = values(residual, *_arrays(residual, frame))
                yield pd.DataFrame({"graph_id": frame["graph_id"], "cost": (r * r).sum(0) * frame["_weight"].to_numpy(float) / 2}).groupby("graph_id", as_index=False).sum()

        found = _at_poses(residual, rows, poses).mapInPandas(run, "graph_id long, cost double")
        parts = found if parts is None else parts.unionByName(found)
    return parts.groupBy("graph_id").agg(F.sum("cost").alias("cost"))


def _times(block: list, vector: list) -> list[Column]:
    """A 3x3 block by a vector, as columns."""
    return [sum((F.col(block[3 * k + m]) * F.col(vector[m]) for m in range(1, 3)), F.col(block[3 * k]) * F.col(vector[0])) for k in range(3)]


def _inner(x: list, y: list) -> Column:
    return F.col(x[0]) * F.col(y[0]) + F.col(x[1]) * F.col(y[1]) + F.col(x[2]) * F.col(y[2])


def _preconditioned(state: DataFrame) -> DataFrame:
    """Fills z0..z2: every stretch's chain solved for its r0..r2, many stretches at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, ["graph_id", "stretch"]):
            at = lambda names, t=table: np.column_stack([t.column(k).to_numpy() for k in names])
            keys = at(["graph_id", "stretch", "pose_id"])
            place = _places((keys[1:, :2] == keys[:-1, :2]).all(1) & (np.diff(keys[:, 2]) == 1))
            z = _reduced(at(BLOCK).reshape(-1, 3, 3), at([f"u{k}" for k in range(9)]).reshape(-1, 3, 3), at(three("r"))[..., None], place)[..., 0]
            for k, name in enumerate(three("z")):
                table = table.set_column(table.column_names.index(name), name, pa.array(z[:, k]))
            yield from table.to_batches(10_000)

    return state.repartition("graph_id", "stretch").sortWithinPartitions("graph_id", "stretch", "pose_id").mapInArrow(run, state.schema)


def _places(joined: np.ndarray) -> np.ndarray:
    """Of each row in its chain, from 0; ``joined``: whether a row goes on from the one before it, from the second row on."""
    starts = np.flatnonzero(np.append(True, ~joined))
    return np.arange(len(joined) + 1) - np.repeat(starts, np.diff(np.append(starts, len(joined) + 1)))


def gradients_together(system: DataFrame, tolerance: float, most: int) -> DataFrame:
    """What ``conjugate_gradients`` gives, of graphs of bounded size: all steps of some graphs are taken in their task, a graph's whole chain as its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, ["graph_id"]):
            g, i, j = (table.column(k).to_numpy() for k in ("graph_id", "i", "j"))
            blocks = np.column_stack([table.column(k).to_numpy() for k in BLOCK]).reshape(-1, 3, 3)
            right = -np.column_stack([table.column(k).to_numpy() for k in SLOPE])
            # rows are in order of graph, i and j, and each pose has one with i = j
            own = np.flatnonzero(i == j)
            rank = np.cumsum(np.append(0, np.diff(g) != 0))
            low, span = i.min(), np.int64(i.max()) - i.min() + 1
            key = rank[own] * span + (i[own] - low)
            first, second = (np.searchsorted(key, rank * span + (k - low)) for k in (i, j))
            graph, pose = rank[own], i[own]
            starts = np.flatnonzero(np.append(True, np.diff(graph) != 0))
            total = lambda x, y, starts=starts: np.add.reduceat((x * y).sum(1), starts)
            rows = np.flatnonzero(np.append(True, np.diff(first) != 0))
            times = lambda x, b=blocks, to=second, rows=rows: np.add.reduceat(np.einsum("nkl,nl->nk", b, x[to]), rows)
            diag, up = blocks[own], np.zeros((len(own), 3, 3))
            above = np.flatnonzero(j == i + 1)
            up[first[above]] = blocks[above]
            place = _places((np.diff(graph) == 0) & (np.diff(pose) == 1))
            r = right[own]
            s, p, start, rho = np.zeros_like(r), np.zeros_like(r), total(r, r), np.zeros(len(starts))
            for _ in range(max(most, 3 * int(np.bincount(graph).max()))):  # as many as unknowns end it but for rounding
                going = total(r, r) > tolerance**2 * start
                if not going.any():
                    break
                z = _reduced(diag, up, r[..., None], place)[..., 0]
                now = total(r, z)
                p = z + np.divide(now, rho, out=np.zeros_like(rho), where=rho > 0)[graph][:, None] * p
                q = times(p)
                bend = total(p, q)
                alpha = np.divide(now, bend, out=np.zeros_like(rho), where=going & (bend > 0))[graph][:, None]
                s, r, rho = s + alpha * p, r - alpha * q, now
            yield from pa.table([pa.array(g[own]), pa.array(pose), *(pa.array(x) for x in s.T)], ["graph_id", "pose_id", *three("s")]).to_batches(10_000)

    parts = int(system.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = system.select("graph_id", "i", "j", *BLOCK, *SLOPE).repartition(parts, "graph_id").sortWithinPartitions("graph_id", "i", "j")
    return rows.mapInArrow(run, "graph_id long, pose_id long, s0 double, s1 double, s2 double")


def direct_steps(system: DataFrame) -> DataFrame:
    """What ``conjugate_gradients`` gives, from each graph's whole system: for graphs of bounded size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(frame["i"].to_numpy())
        i, j = (np.searchsorted(ids, frame[k].to_numpy()) for k in ("i", "j"))
        whole = np.zeros((len(ids), 3, len(ids), 3))
        whole[i, :, j, :] = frame[BLOCK].to_numpy(float).reshape(-1, 3, 3)
        own = i == j
        right = np.zeros((len(ids), 3))
        right[i[own]] = -frame.loc[own, SLOPE].to_numpy(float)
        step = np.linalg.solve(whole.reshape(right.size, right.size), right.ravel()).reshape(-1, 3)
        return pd.DataFrame({"graph_id": frame["graph_id"].iloc[0], "pose_id": ids, "s0": step[:, 0], "s1": step[:, 1], "s2": step[:, 2]})

    return system.groupBy("graph_id").applyInPandas(run, "graph_id long, pose_id long, s0 double, s1 double, s2 double")


def steps(system: DataFrame, stretch: int, tolerance: float, direct: int) -> tuple[DataFrame, list[DataFrame]]:
    """The step of every graph, small ones directly and the others by gradients, and the cuts it reads."""
    sizes = cut(system.where("i = j").groupBy("graph_id").agg((F.count("*") <= direct).alias("small")), "sizes")
    held = [sizes]
    out = direct_steps(system.join(sizes.where("small"), "graph_id", "left_semi"))
    if sizes.where("not small").limit(1).count():
        held.append(conjugate_gradients(system.join(sizes.where("not small"), "graph_id", "left_semi"), stretch, tolerance))
        out = out.union(held[-1])
    return out, held


def conjugate_gradients(system: DataFrame, stretch: int = 128, tolerance: float = 1e-10, most: int = 200, whole: int = WHOLE) -> DataFrame:
    """(graph_id, pose_id, s0, s1, s2) with blocks * s = -gradient, to a relative residual of ``tolerance`` in every graph; a cut.

    ``system`` is a table of blocks as ``normal_equations`` gives it, positive definite. Graphs of more than ``whole``
    blocks advance in rounds of Spark.
    """
    sizes = cut(system.groupBy("graph_id").agg((F.count("*") <= whole).alias("small")), "sizes")
    out = gradients_together(system.join(sizes.where("small"), "graph_id", "left_semi"), tolerance, most)
    held = [sizes]
    if sizes.where("not small").limit(1).count():
        held.append(gradients_in_rounds(system.join(sizes.where("not small"), "graph_id", "left_semi"), stretch, tolerance, most))
        out = out.union(held[-1])
    out = cut(out, "step")
    remove(*held)
    return out


def gradients_in_rounds(system: DataFrame, stretch: int, tolerance: float, most: int) -> DataFrame:
    """The same of graphs of any size: every step of all graphs is a round of joins and sums; a cut."""
    own = system.where("i = j").select("graph_id", F.col("i").alias("pose_id"), F.floor(F.col("i") / stretch).alias("stretch"), *BLOCK, *SLOPE)
    above = system.where("j = i + 1").select("graph_id", F.col("i").alias("pose_id"), *[F.col(a).alias(f"u{k}") for k, a in enumerate(BLOCK)])
    away = cut(system.where("i != j").select("graph_id", "i", "j", *BLOCK), "blocks")
    nought = {k: F.lit(0.0) for k in [*three("s"), *three("p"), *three("z")]}
    state = own.join(above, ["graph_id", "pose_id"], "left").fillna(0.0, [f"u{k}" for k in range(9)])
    state = state.withColumns(nought | {r: -F.col(g) for r, g in zip(three("r"), SLOPE, strict=True)}).drop(*SLOPE).withColumn("rho", F.lit(0.0))
    state = cut(_preconditioned(state), "gradients")
    start = cut(state.groupBy("graph_id").agg(F.sum(_inner(three("r"), three("r"))).alias("start")), "start")
    for k in range(most):
        now = state.groupBy("graph_id").agg(F.sum(_inner(three("r"), three("z"))).alias("now"), F.sum(_inner(three("r"), three("r"))).alias("left"))
        # further steps do no harm: whether all are there is asked now and then
        if k % 3 == 0 and not now.join(start, "graph_id").where(F.col("left") > tolerance**2 * F.col("start")).limit(1).count():
            break
        beta = F.when(F.col("rho") > 0, F.col("now") / F.col("rho")).otherwise(0.0)
        going = state.join(now.drop("left"), "graph_id").withColumns({p: F.col(z) + beta * F.col(p) for p, z in zip(three("p"), three("z"), strict=True)})
        ends = going.select("graph_id", F.col("pose_id").alias("j"), *three("p"))
        far = away.join(ends, ["graph_id", "j"]).groupBy("graph_id", F.col("i").alias("pose_id")).agg(*[F.sum(x).alias(f"f{k}") for k, x in enumerate(_times(BLOCK, three("p")))])
        going = going.join(far, ["graph_id", "pose_id"], "left").fillna(0.0, three("f"))
        going = going.withColumns({q: x + F.col(f) for q, x, f in zip(three("q"), _times(BLOCK, three("p")), three("f"), strict=True)})
        bend = going.groupBy("graph_id").agg(F.sum(_inner(three("p"), three("q"))).alias("bend"))
        going = going.join(bend, "graph_id").withColumn("alpha", F.when(F.col("bend") > 0, F.col("now") / F.col("bend")).otherwise(0.0))
        steps = {s: F.col(s) + F.col("alpha") * F.col(p) for s, p in zip(three("s"), three("p"), strict=True)}
        steps |= {r: F.col(r) - F.col("alpha") * F.col(q) for r, q in zip(three("r"), three("q"), strict=True)}
        going = going.withColumns(steps).withColumn("rho", F.col("now")).select(*state.columns)
        after = cut(_preconditioned(going), "gradients")
        remove(state)
        state = after
    out = cut(state.select("graph_id", "pose_id", *three("s")), "step")
    remove(state, away, start)
    return out


def refine(poses: DataFrame, terms: Mapping[str, DataFrame], rounds: int = 8, settled: float = 1e-5, stretch: int = 128, tolerance: float = 1e-3, direct: int = DIRECT, registry: Mapping[str, Residual] = REGISTRY) -> DataFrame:
    """(graph_id, pose_id, x, y, th, cost_before, cost_after): Levenberg-Marquardt over every graph at once, at most ``rounds`` steps.

    ``terms`` has a table for each residual of the registry that takes part: graph_id, i, j (where it is about two
    poses), its data columns, and maybe weight. A graph's step is taken only if it lowers its cost, so no cost rises.
    """
    now = cut(poses.select("graph_id", "pose_id", *POSE), "poses")
    fixed = now.groupBy("graph_id").agg(F.min("pose_id").cast("long").alias("fixed"))
    first = costs(now, terms, registry)
    status = cut(now.select("graph_id").distinct().join(first, "graph_id", "left").select("graph_id", F.coalesce("cost", F.lit(0.0)).alias("before"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.lit(1e-4).alias("damp"), F.lit(1.0).alias("gain")), "status")
    for _ in range(rounds):
        if not status.where((F.col("gain") > settled) & (F.col("damp") < 1e8) & (F.col("cost") > 0)).limit(1).count():
            break
        free = normal_equations(now, terms, registry).join(fixed, "graph_id").where("i != fixed and j != fixed").join(status.select("graph_id", "damp"), "graph_id")
        # alike along x and y, so that no choice of axes matters
        share = {"a0": (F.col("a0") + F.col("a4")) / 2, "a4": (F.col("a0") + F.col("a4")) / 2, "a8": F.col("a8")}
        damped = {a: F.when(F.col("i") == F.col("j"), F.col(a) + F.col("damp") * share[a] + 1e-9).otherwise(F.col(a)) for a in share}
        system = cut(free.withColumns(damped).select("graph_id", "i", "j", *BLOCK, *SLOPE), "system")
        step, held = steps(system, stretch, tolerance, direct)
        moved = now.join(step.withColumnRenamed("pose_id", "_p"), (now["graph_id"] == step["graph_id"]) & (now["pose_id"] == F.col("_p")), "left").drop(step["graph_id"], "_p").fillna(0.0, three("s"))
        tried = cut(moved.select("graph_id", "pose_id", *POSE, *[(F.col(k) + F.col(s)).alias(f"new_{k}") for k, s in zip(POSE, three("s"), strict=True)]), "tried")
        trial = tried.select("graph_id", "pose_id", "new_x", "new_y", "new_th").toDF("graph_id", "pose_id", *POSE)
        seen = status.join(costs(trial, terms, registry).withColumnRenamed("cost", "new"), "graph_id", "left").withColumn("better", F.coalesce(F.col("new") < F.col("cost"), F.lit(False)))
        after = cut(seen.select("graph_id", "before", F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"), F.when(F.col("better"), F.greatest(F.col("damp") / 5, F.lit(1e-12))).otherwise(F.col("damp") * 10).alias("damp"), F.when(F.col("better"), (F.col("cost") - F.col("new")) / F.col("cost")).when(F.col("new").isNull(), 0.0).otherwise(1.0).alias("gain"), "better"), "status")
        taken = tried.join(after.select("graph_id", "better"), "graph_id")
        then = cut(taken.select("graph_id", "pose_id", *[F.when(F.col("better"), F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in POSE]), "poses")
        remove(system, *held, tried, now, status)
        now, status = then, after.drop("better")
        status.folder = after.folder
        fixed = now.groupBy("graph_id").agg(F.min("pose_id").cast("long").alias("fixed"))
    return now.withColumn("th", wrap("th")).join(status.select("graph_id", F.col("before").alias("cost_before"), F.col("cost").alias("cost_after")), "graph_id")

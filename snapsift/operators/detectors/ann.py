"""Approximate nearest neighbours: random projection blocks, then neighbours of neighbours.

Each table projects the points onto a few random directions and splits them, by the projections,
into blocks of bounded size; a point's first neighbours are the nearest of its blocks. Each round then
tries the neighbours of a point's neighbours, where being a neighbour counts both ways, and keeps
the nearest. So a point meets at most ``tables`` blocks and ``(2 near)**2`` candidates a round,
whatever the number of points; the graph is marked as approximate and carries the counts.

Distances are exact, so every distance in the graph is right and none is smaller than the exact
graph's at the same rank. Use the exact graph where a missed neighbour matters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.models import stack
from ...functions.runtime import settle, store

#: Points that ask at one hub and are compared there in one group.
ASKING = 256
#: Edges whose hubs, or points, share a group.
EDGES_PER_GROUP = 2_000


@dataclass(frozen=True)
class Approximation:
    """How hard to look: random tables, points of a block, rounds, and neighbours tried per point and direction."""

    tables: int = 4
    block_rows: int = 256
    directions: int = 8
    rounds: int = 2
    near: int = 20
    seed: int = 42

    def most_candidates(self) -> int:
        """Bound on the points that one point is compared with: blocks hold at most twice ``block_rows``."""
        return self.tables * 2 * self.block_rows + self.rounds * (2 * self.near) ** 2


def project(points: DataFrame, directions: int, seed: int) -> DataFrame:
    """``points`` with ``key``: their features along random directions."""

    def along(batches):
        for pdf in batches:
            x = stack(pdf["features"])
            rng = np.random.Generator(np.random.PCG64([seed, x.shape[1]]))
            pdf["key"] = list(x @ rng.normal(size=(x.shape[1], directions)))
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(along, f"{kinds}, key array<double>")


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``, summed feature by feature, so the same from either side."""
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        gap = a[:, None] - b[None, :]
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return total if metric == "manhattan" else np.sqrt(total)


def _edges(lists: DataFrame, near: int) -> DataFrame:
    """``(dataset, point, other)``: the ``near`` nearest of each point, and the nearest that count it among theirs."""
    forward = lists.select("dataset", "point", F.inline("nn").alias("distance", "id", "other")).filter("other <> point")
    forward = forward.groupBy("dataset", "point", "other").agg(F.min("distance").alias("distance"))  # copies are one point
    closest = lambda key: F.row_number().over(W.partitionBy("dataset", key).orderBy("distance", "point", "other"))
    forward = settle(forward.withColumn("_r", closest("point")).filter(F.col("_r") <= near).drop("_r"))
    back = forward.withColumn("_r", closest("other")).filter(F.col("_r") <= near)
    return forward.select("dataset", "point", "other").union(back.select("dataset", "other", "point")).distinct()


def runs(*keys: np.ndarray) -> list[np.ndarray]:
    """Positions of each run of equal keys, in sorted rows."""
    change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.split(np.arange(len(keys[0])), np.flatnonzero(change) + 1)


def meetings(edges: DataFrame, points: DataFrame) -> DataFrame:
    """``(dataset, hub, part, point, asks, offered, features)``: the points that meet at a neighbour they share.

    A point asks at its own neighbours, and a hub offers its neighbours to all that ask. These are at most
    ``2 near``; a hub that many ask is dealt into parts of about ``ASKING``, each with all that is offered.
    """
    roles = edges.select("dataset", F.col("other").alias("hub"), "point", F.lit(True).alias("asks"), F.lit(False).alias("offered")).union(
        edges.select("dataset", F.col("point").alias("hub"), "other", F.lit(False), F.lit(True)))
    roles = roles.groupBy("dataset", "hub", "point").agg(F.max("asks").alias("asks"), F.max("offered").alias("offered"))
    asking = edges.groupBy("dataset", F.col("other").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("_parts"))
    own = F.pmod(F.hash("point"), F.col("_parts"))
    dealt = roles.join(asking, ["dataset", "hub"]).withColumn("_own", own).select(
        "dataset", "hub", "point", "asks", "offered", "_own",
        F.explode(F.when(F.col("offered"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array("_own"))).alias("part"))
    dealt = dealt.withColumn("asks", F.col("asks") & (F.col("part") == F.col("_own"))).drop("_own")
    return dealt.join(points.select("dataset", "point", "features"), ["dataset", "point"])


def refine(points: DataFrame, lists: DataFrame, keep: int, metric: str, near: int, merge) -> tuple[DataFrame, DataFrame]:
    """Lists after one round, and ``(dataset, point, n)`` candidates tried.

    Features move once per edge, not per pair: pairs are compared where their points meet, and a point
    gets the numbers and distances of what each of its neighbours has offered.
    """
    edges = settle(_edges(lists, near))

    rooms = F.lit(1 + edges.count() // EDGES_PER_GROUP)  # several hubs, or points, share a group

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hub", "part", "point"])
        x, points_, asks, offered = stack(pdf["features"]), pdf["point"].to_numpy(), pdf["asks"].to_numpy(bool), pdf["offered"].to_numpy(bool)
        who, candidates, far = [], [], []
        for rows in runs(pdf["hub"].to_numpy(), pdf["part"].to_numpy()):
            here, there = rows[asks[rows]], rows[offered[rows]]
            if len(there):
                who.append(points_[here])
                candidates += [points_[there]] * len(here)
                far += list(distances(x[here], x[there], metric))
        return pd.DataFrame({
            "dataset": pdf["dataset"].iloc[0], "point": np.concatenate([np.empty(0, np.int64), *who]), "candidate": candidates, "distance": far,
        })

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", kind="stable")
        points_, lists_, far_ = pdf["point"].to_numpy(), pdf["candidate"].to_numpy(), pdf["distance"].to_numpy()
        tried_ = pdf["distance"].notna().to_numpy()
        out = []
        for rows in runs(points_):
            tried, known = rows[tried_[rows]], rows[~tried_[rows]]
            if len(tried) == 0:
                continue
            candidates, first = np.unique(np.concatenate(lists_[tried]), return_index=True)
            far = np.concatenate(far_[tried])[first]
            new = ~np.isin(candidates, np.concatenate([points_[rows[:1]], *lists_[known]]).astype(np.int64))
            candidates, far = candidates[new], far[new]
            best = np.lexsort((candidates, far))[:keep]
            out.append((np.full(len(best), points_[rows[0]]), candidates[best], far[best], np.full(len(best), len(candidates))))
        columns = [np.concatenate([np.empty(0, kind), *c]) for kind, c in zip((np.int64, np.int64, float, np.int64), zip(*out) if out else [()] * 4)]
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], **dict(zip(("point", "candidate", "distance", "n"), columns))})

    schema = "dataset string, point long, candidate array<long>, distance array<double>"
    room = lambda *names: F.pmod(F.xxhash64(*names), rooms).alias("room")
    met = meetings(edges, points).groupBy("dataset", room("hub", "part")).applyInPandas(compare, schema)
    known = lists.select("dataset", "point", F.transform("nn", lambda x: x["point"]).alias("candidate"), F.lit(None).cast("array<double>").alias("distance"))
    # only the nearest of the candidates are stored, with their number
    best = store(met.union(known).groupBy("dataset", room("point")).applyInPandas(
        nearest, "dataset string, point long, candidate long, distance double, n long"))
    copies = points.select("dataset", F.col("point").alias("candidate"), "ids")
    entries = F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("id"), F.col("candidate").alias("point")))
    found = best.join(copies, ["dataset", "candidate"]).select("dataset", "point", entries.alias("nn"))
    return store(merge(lists.unionByName(found), keep)), best.groupBy("dataset", "point").agg(F.max("n").alias("n"))


def approximate_lists(points: DataFrame, keep: int, metric: str, how: Approximation) -> tuple[DataFrame, DataFrame]:
    """``(dataset, point, nn)`` and the candidates ``(dataset, point, n)`` of every point."""
    from . import neighbors

    wanted, keep = keep, max(keep, how.near + 1)
    tables, met = None, []
    for t in range(how.tables):
        keyed = project(points, how.directions, how.seed + t)
        blocks = neighbors.split_blocks(keyed, max(how.block_rows, 2 * keep), by="key").drop("key")
        own = store(neighbors._own_blocks(blocks, keep, metric))
        sizes = own.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"))
        met.append(own.select("dataset", "block", "point").join(sizes, ["dataset", "block"]).select("dataset", "point", "n"))
        lists = own.select("dataset", "point", neighbors._nn())
        tables = lists if tables is None else tables.unionByName(lists)
    merge = lambda both, k: neighbors.best_lists(both, k, distinct=True)
    lists = store(merge(tables, keep))
    for _ in range(how.rounds):
        lists, tried = refine(points, lists, keep, metric, how.near, merge)
        met.append(tried)
    counts = met[0]
    for more in met[1:]:
        counts = counts.unionByName(more)
    lists = lists.withColumn("nn", F.slice("nn", 1, wanted))
    return lists, settle(counts.groupBy("dataset", "point").agg(F.sum("n").alias("n")))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """``(dataset, rows, recall)`` of neighbour rows (dataset, rec_id, rank, neighbor, distance).

    A row counts if its distance is no larger than the exact graph's farthest: among equally far
    neighbours any is right.
    """
    limit = exact.groupBy("dataset", "rec_id").agg(F.max("distance").alias("_limit"), F.count(F.lit(1)).alias("_n"))
    hits = approximate.join(limit.select("dataset", "rec_id", "_limit"), ["dataset", "rec_id"]).filter(F.col("distance") <= F.col("_limit") + 1e-9)
    hits = hits.groupBy("dataset", "rec_id").agg(F.count(F.lit(1)).alias("_hit"))
    both = limit.join(hits, ["dataset", "rec_id"], "left")
    return both.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), (F.coalesce(F.sum("_hit"), F.lit(0)) / F.sum("_n")).alias("recall")
    )

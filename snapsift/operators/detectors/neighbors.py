"""Exact nearest neighbours without pairing every record with every other.

1. Records with identical features become one *point* that keeps its k + 1 smallest
   record ids, so a large group of copies costs one row.
2. Points are split into spatial *blocks* of bounded size: a k-d split learnt from a
   bounded sample of each part, repeated until the parts are small.
3. Every block finds neighbours inside itself; the k-th distance bounds the search.
4. Blocks are routed to blocks: a pair stays if the two bounding boxes are within the largest
   bound of the one's points. The boxes form a tree, walked one level per join.
5. Points move to units of sibling blocks, unless their own bound rules the unit out. A task
   searches a unit's near blocks first and narrows the bounds as it goes. Visits to a unit
   are cut into chunks, so one task sees bounded numbers of points and blocks.

Nothing is approximated: a point that cannot rule out a block visits it. ``approximate`` graphs
(``ann.py``) are an option of ``knn_points`` and ``knn_graph``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.models import stack
from ...functions.runtime import settle, spread, store
from ...functions.skew import BROADCAST_BYTES, skew_lookup
from . import ann

BLOCK_ROWS = 1024
FANOUT = 64
SAMPLE_ROWS = 2048
MAX_LEVELS = 6
#: Points that visit a unit together, in blocks, at least and at most; their neighbours are bounded too.
LEAST_VISITORS, MOST_VISITORS = 4, 16
VISITOR_NEIGHBOURS = 1 << 20
_SLICE = 256
#: Room for rounding when a box is ruled out.
SLACK = 1e-9

_LISTS = "distance array<double>, id array<long>, near array<long>"


def _nn():
    """Parallel arrays of distance, record id and point as one array of structs."""
    return F.transform(
        F.arrays_zip("distance", "id", "near"),
        lambda x: F.struct(x["distance"].alias("distance"), x["id"].alias("id"), x["near"].alias("point")),
    ).alias("nn")


@dataclass(frozen=True)
class Graph:
    """``points``: (dataset, point, features, copies, ids); ``nn``: (dataset, point, nn).

    ``nn`` holds the k + 1 nearest records of the point by (distance, id), its own copies
    included. ``members`` maps records to points. An approximate graph has ``candidates``, the
    number of points ``n`` that each (dataset, point) was compared with.
    """

    k: int
    points: DataFrame
    nn: DataFrame
    members: DataFrame
    candidates: DataFrame | None = None

    @property
    def exact(self) -> bool:
        return self.candidates is None


def collapse_copies(records: DataFrame, keep: int) -> DataFrame:
    """Distinct points with their number of copies and the ``keep`` smallest ids."""
    features = F.transform("features", lambda v: v + F.lit(0.0))
    rows = records.select("dataset", "rec_id", features.alias("features"))
    order = W.partitionBy("dataset", "features").orderBy("rec_id")
    least = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    ids = least.groupBy("dataset", "features").agg(
        F.array_sort(F.collect_list("rec_id")).alias("ids"), F.min("rec_id").alias("point")
    )
    copies = rows.groupBy("dataset", "features").agg(F.count(F.lit(1)).alias("copies"))
    return ids.join(copies, ["dataset", "features"])


# --- blocks -------------------------------------------------------------------------------


def split_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Heap of (dimension, threshold): median cuts along the widest dimension."""
    dims, cuts = np.zeros(2**depth - 1), np.zeros(2**depth - 1)
    parts = {0: x}
    for node in range(2**depth - 1):
        rows = parts.pop(node)
        if len(rows):
            dim = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut = float(np.median(rows[:, dim]))
            if not (rows[:, dim] > cut).any():
                below = rows[:, dim][rows[:, dim] < cut]
                cut = float(below.max()) if len(below) else cut
            dims[node], cuts[node] = dim, cut
            low = rows[:, dim] <= cut
            parts[2 * node + 1], parts[2 * node + 2] = rows[low], rows[~low]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = rows
    return dims, cuts


def leaf_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(int(math.log2(len(dims) + 1))):
        node = 2 * node + 1 + (x[rows, dims[node].astype(np.int64)] > cuts[node])
    return node - len(dims)


def split_blocks(points: DataFrame, block_rows: int, by: str = "features") -> DataFrame:
    """Give each point a ``block`` path, by splits of the array column ``by``.

    ``block`` is text, one step per level, so a prefix names the parent. The loop runs on
    the driver, once per level, reading one number each time.
    """
    current = settle(spread(points, ["dataset", "point"], points.count()).withColumn("block", F.lit("")))
    for _ in range(MAX_LEVELS):
        sizes = current.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"))
        sizes = settle(sizes)
        largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
        if (largest or 0) <= block_rows:
            break
        large = sizes.filter(F.col("n") > block_rows)
        rate = F.lit(float(SAMPLE_ROWS)) / F.col("_n")
        drawn = F.pmod(F.xxhash64("point", "block"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        located = skew_lookup(
            current, large.select("dataset", "block", F.col("n").alias("_n"), F.col("n").alias("_w")),
            ["dataset", "block"], "_w", total, "inner",
        )
        sample = located.filter(drawn < rate).select("dataset", "block", by, F.col("_n").alias("n"))

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = min(FANOUT, pdf["n"].iloc[0] / (0.75 * block_rows))
            depth = max(1, math.ceil(math.log2(parts)))
            dims, cuts = split_tree(stack(pdf[by]), depth)
            return pd.DataFrame({
                "dataset": [pdf["dataset"].iloc[0]], "block": [pdf["block"].iloc[0]],
                "n": [pdf["n"].iloc[0]], "dims": [dims], "cuts": [cuts],
            })

        trees = settle(sample.groupBy("dataset", "block").applyInPandas(
            learn, "dataset string, block string, n long, dims array<double>, cuts array<double>"
        ))
        placed = skew_lookup(current, trees, ["dataset", "block"], "n", total)

        def assign(batches):
            for pdf in batches:
                leaf = np.zeros(len(pdf), dtype=np.int64)
                split = pdf["dims"].notna().to_numpy()
                if split.any():
                    chosen = pdf[split]
                    for _, index in chosen.groupby(["dataset", "block"], sort=False).indices.items():
                        rows = chosen.iloc[index]
                        where = np.flatnonzero(split)[index]
                        first = rows.iloc[0]
                        leaf[where] = leaf_of(stack(rows[by]), np.asarray(first["dims"]), np.asarray(first["cuts"]))
                out = pdf.drop(columns=["dims", "cuts"])
                out["block"] = pdf["block"] + "." + pd.Series(leaf, index=pdf.index).astype(str)
                yield out

        current = settle(placed.mapInPandas(assign, current.schema))
    # parts that no split could shrink enough are cut by hash
    sizes = current.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes)
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) > 2 * block_rows:
        located = skew_lookup(
            current, sizes.select("dataset", "block", F.col("n").alias("_n"), F.col("n").alias("_w")),
            ["dataset", "block"], "_w", total, "inner",
        )
        pieces = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows)))
        current = settle(
            located.withColumn(
                "block", F.concat("block", F.lit("."), F.pmod(F.xxhash64("point"), pieces).cast("string"))
            ).drop("_n")
        )
    return current


# --- distances ----------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise distances by plain differences (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += np.abs(gap) if metric == "manhattan" else gap * gap
    return out if metric == "manhattan" else np.sqrt(out)


def nearest_lists(
    q: np.ndarray, x: np.ndarray, ids: list, points: np.ndarray, keep: int, metric: str,
    bound: np.ndarray | None = None,
) -> tuple[list, list, list]:
    """For each query the ``keep`` nearest records of a block: distances, ids, points.

    ``x`` is sorted by point, and a point is its least id, so a stable sort by distance
    breaks ties by id.
    """
    single = all(len(i) == 1 for i in ids)
    far, near_ids, near_points = [], [], []
    for start in range(0, len(q), _SLICE):
        d = distances(q[start : start + _SLICE], x, metric)
        m = min(keep, d.shape[1]) - 1
        limit = np.partition(d, m, axis=1)[:, m]
        if bound is not None:
            limit = np.minimum(limit, bound[start : start + _SLICE])
        rows, cols = np.nonzero(d <= limit[:, None])
        dist = d[rows, cols]
        order = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        edges = np.searchsorted(rows, np.arange(len(d) + 1))
        for i in range(len(d)):
            span = slice(edges[i], min(edges[i + 1], edges[i] + keep))
            near, gap = cols[span], dist[span]
            if single:
                far.append(gap), near_ids.append(points[near]), near_points.append(points[near])
                continue
            # points with copies count once per kept id
            found = sorted((s, int(r), int(points[c])) for s, c in zip(gap, near) for r in ids[c])[:keep]
            far.append([f[0] for f in found])
            near_ids.append([f[1] for f in found])
            near_points.append([f[2] for f in found])
    return far, near_ids, near_points


def _own_blocks(blocks: DataFrame, keep: int, metric: str) -> DataFrame:
    """Neighbours inside the own block, and the k-th distance as search bound.

    One row of each block also carries the block's box and the largest bound of its points.
    """
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        x = stack(pdf["features"])
        far, ids, near = nearest_lists(x, x, list(pdf["ids"]), pdf["point"].to_numpy(), keep, metric)
        full = [f[-1] if len(f) == keep else math.inf for f in far]
        once = [None] * (len(pdf) - 1)
        return pd.DataFrame({
            "dataset": pdf["dataset"].to_numpy(), "block": pdf["block"].to_numpy(), "point": pdf["point"].to_numpy(),
            "features": pdf["features"].to_numpy(), "ids": pdf["ids"].to_numpy(), "bound": full, "distance": far, "id": ids, "near": near,
            "lo": [x.min(axis=0), *once], "hi": [x.max(axis=0), *once], "reach": [max(full), *once],
        })

    schema = (
        "dataset string, block string, point long, features array<double>, ids array<long>, bound double, "
        f"{_LISTS}, lo array<double>, hi array<double>, reach double"
    )
    sizes = blocks.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"))
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    return spread(blocks, ["dataset", "block"], rows or 0, groups).groupBy("dataset", "block").applyInPandas(search, schema)


# --- walking the boxes -----------------------------------------------------------------------


def _hulls(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around the boxes (lo, hi) of each group; there is a row per block, not per point."""
    sides = boxes.select(*keys, F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "side")).groupBy(*keys, "pos").agg(
        F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi")
    )
    whole = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return sides.groupBy(*keys).agg(whole.alias("_box")).select(*keys, F.col("_box.lo").alias("lo"), F.col("_box.hi").alias("hi"))


def _box_levels(blocks: DataFrame) -> list[DataFrame]:
    """Per level ``(dataset, node, children)``: boxes of the children of each node."""
    depth = blocks.agg(F.max(F.size(F.split("block", r"\.")))).first()[0] - 1
    levels = []
    for level in range(1, depth + 1):
        child = F.array_join(F.slice(F.split("block", r"\."), 1, level + 1), ".")
        node = F.array_join(F.slice(F.split("child", r"\."), 1, level), ".")
        hulls = _hulls(blocks.withColumn("child", child), ["dataset", "child"]).withColumn("node", node)
        levels.append(hulls.groupBy("dataset", "node").agg(F.collect_list(F.struct("child", "lo", "hi")).alias("children")))
    return levels


def _small_side(level: DataFrame) -> DataFrame:
    """The boxes of one level, settled; broadcast when their measured size allows it.

    The first levels have few nodes that many blocks share, so they are small; deeper
    ones may be large, but each of their nodes has few blocks.
    """
    level = settle(level)
    sides = F.size("children") * F.size(F.get("children", F.lit(0))["lo"])
    measured = level.agg(F.sum(sides.cast("long"))).first()[0] or 0
    return F.broadcast(level) if measured * 24 <= BROADCAST_BYTES else level


def _gap(low, high, lo, hi, metric: str):
    """Least distance between the box (low, high) and the box (lo, hi)."""
    apart = F.zip_with(
        F.zip_with(lo, high, lambda a, b: a - b), F.zip_with(low, hi, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))
    )
    if metric == "manhattan":
        return F.aggregate(apart, F.lit(0.0), lambda a, g: a + g)
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, g: a + g * g))


def _within(gap, bound):
    return gap <= bound * (1 + SLACK) + SLACK * SLACK


def route_blocks(blocks: DataFrame, metric: str) -> DataFrame:
    """``(dataset, block, target)``: the other blocks in which some point of a block may have neighbours.

    One row per pair of blocks, none per point. One join per tree level; a node has at most FANOUT
    children, unless a part was cut by hash.
    """
    walk = blocks.select("dataset", "block", "lo", "hi", "reach", F.lit("").alias("node"))
    for level in _box_levels(blocks):
        near = F.filter("children", lambda c: _within(_gap(F.col("lo"), F.col("hi"), c["lo"], c["hi"], metric), F.col("reach")))
        walk = walk.join(_small_side(level), ["dataset", "node"]).select(
            "dataset", "block", "lo", "hi", "reach", F.explode(F.transform(near, lambda c: c["child"])).alias("node")
        )
    return walk.filter(F.col("node") != F.col("block")).select("dataset", "block", F.col("node").alias("target"))


def _units(blocks: DataFrame) -> DataFrame:
    """``(dataset, block, unit, lo, hi)``: sibling blocks that are searched together, at most about FANOUT.

    Points move once per unit, not per block; while there are few blocks, units are small enough for
    every core.
    """
    spark = blocks.sparkSession
    parent = F.array_join(F.slice(F.split("block", r"\."), F.lit(1), F.greatest(F.size(F.split("block", r"\.")) - 1, F.lit(1))), ".")
    placed = blocks.select("dataset", "block", "lo", "hi", parent.alias("parent"))
    per = max(1, min(FANOUT, placed.count() // spark.sparkContext.defaultParallelism))
    family = placed.groupBy("dataset", "parent").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("block"), F.ceil(F.col("n") / F.lit(per)))
    return placed.join(family, ["dataset", "parent"]).select(
        "dataset", "block", F.concat("parent", F.lit("#"), part.cast("string")).alias("unit"), "lo", "hi"
    )


def visitors(total: int, cores: int, keep: int, block_rows: int) -> int:
    """Points of a chunk, when ``total`` points visit units.

    A unit's points are copied for each chunk of its visitors, so chunks are as large as memory and an even
    load of all cores allow.
    """
    most = min(MOST_VISITORS * block_rows, VISITOR_NEIGHBOURS // keep, total // (8 * cores))
    return max(LEAST_VISITORS * block_rows, most)


def _visit(routed: DataFrame, own: DataFrame, boxes: DataFrame, keep: int, metric: str, block_rows: int) -> DataFrame:
    """Search points in the units that hold a target of their block, in bounded chunks of points.

    A task takes the unit's blocks in the order of their distance from its points, and every block
    narrows the bounds for the next ones.
    """
    units = settle(_units(boxes))
    sizes = own.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"))
    targets = units.select("dataset", F.col("block").alias("target"), "unit")
    pairs = settle(routed.join(targets, ["dataset", "target"]).select("dataset", "block", "unit").distinct().join(sizes, ["dataset", "block"]))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    rows = visitors(total, own.sparkSession.sparkContext.defaultParallelism, keep, block_rows)
    sized = settle(pairs.groupBy("dataset", "unit").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(rows))).alias("chunks")))
    groups = sized.agg(F.sum("chunks")).first()[0] or 0
    hulls = _hulls(units, ["dataset", "unit"]).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    asked = settle(pairs.join(sized, ["dataset", "unit"]).join(hulls, ["dataset", "unit"]).select(
        "dataset", "block", "unit", F.pmod(F.xxhash64("block"), F.col("chunks")).alias("chunk"), "_lo", "_hi"))
    queries = own.select("dataset", "block", "point", "features", "bound").join(asked, ["dataset", "block"]).filter(
        _within(_gap(F.col("features"), F.col("features"), F.col("_lo"), F.col("_hi"), metric), F.col("bound"))
    )
    held = (
        own.select("dataset", "block", "point", "features", "ids").join(units.select("dataset", "block", "unit"), ["dataset", "block"])
        .join(sized, ["dataset", "unit"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    )

    held = held.toDF(*held.columns)  # both sides read the blocks, so one gets fresh column identities

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame()
        asked, bound, home = stack(q["features"]), q["bound"].to_numpy().copy(), q["block"].to_numpy()
        best = np.full((len(q), keep), math.inf)
        found: list[list] = [[] for _ in range(len(q))]
        parts = []
        for name, part in x.groupby("block", sort=True):
            part = part.sort_values("point")
            features = stack(part["features"])
            parts.append((float(distances(asked.mean(axis=0)[None], features.mean(axis=0)[None], metric)[0, 0]), name, part, features))
        for _, name, part, features in sorted(parts, key=lambda p: p[:2]):
            apart = np.maximum(np.maximum(features.min(axis=0) - asked, asked - features.max(axis=0)), 0.0)
            gap = apart.sum(axis=1) if metric == "manhattan" else np.sqrt((apart * apart).sum(axis=1))
            rows = np.flatnonzero((home != name) & (gap <= bound * (1 + SLACK) + SLACK * SLACK))
            if not len(rows):
                continue
            far, ids, near = nearest_lists(asked[rows], features, list(part["ids"]), part["point"].to_numpy(), keep, metric, bound[rows])
            padded = np.full((len(rows), keep), math.inf)
            for i, (row, lists) in enumerate(zip(rows.tolist(), zip(far, ids, near, strict=True), strict=True)):
                padded[i, :len(lists[0])] = lists[0]
                found[row].extend(zip(*lists, strict=True))
                if len(found[row]) > 4 * keep:
                    found[row] = sorted(found[row])[:keep]
            best[rows] = np.sort(np.concatenate([best[rows], padded], axis=1), axis=1)[:, :keep]
            bound[rows] = np.minimum(bound[rows], best[rows, -1])
        kept = [sorted(f)[:keep] for f in found]
        return pd.DataFrame({
            "dataset": q["dataset"].to_numpy(), "point": q["point"].to_numpy(),
            "distance": [[f[0] for f in k] for k in kept], "id": [[f[1] for f in k] for k in kept], "near": [[f[2] for f in k] for k in kept],
        })

    cols = ["dataset", "unit", "chunk"]
    return (
        spread(queries.select(*cols, "block", "point", "features", "bound"), cols, total, groups).groupBy(*cols)
        .cogroup(spread(held.select(*cols, "block", "point", "features", "ids"), cols, total, groups).groupBy(*cols))
        .applyInPandas(search, f"dataset string, point long, {_LISTS}")
    )


def best_lists(lists: DataFrame, keep: int, distinct: bool = False) -> DataFrame:
    """Merge ``(dataset, point, nn)`` rows of each point to its ``keep`` nearest by (distance, id).

    ``distinct`` when a neighbour may stand in several rows of a point.
    """
    flat = lists.select("dataset", "point", F.inline("nn").alias("distance", "id", "neighbor"))
    if distinct:
        flat = flat.groupBy("dataset", "point", "id").agg(F.min("distance").alias("distance"), F.first("neighbor").alias("neighbor"))
    order = W.partitionBy("dataset", "point").orderBy("distance", "id")
    best = flat.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    return best.groupBy("dataset", "point").agg(
        F.array_sort(F.collect_list(F.struct("distance", "id", F.col("neighbor").alias("point")))).alias("nn")
    )


def knn_points(
    records: DataFrame, k: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS, approximate: ann.Approximation | None = None
) -> Graph:
    """k-nearest-neighbour graph over distinct points; exact unless ``approximate`` is given."""
    keep = k + 1
    points = store(collapse_copies(records, keep))
    if approximate is not None:
        nn, candidates = ann.approximate_lists(points, keep, metric, approximate)
        return Graph(k, points, nn, records, candidates)
    blocks = split_blocks(points, max(block_rows, 2 * keep))
    own = store(_own_blocks(blocks, keep, metric))
    lists = own.select("dataset", "point", _nn())
    boxes = settle(own.filter(F.col("lo").isNotNull()).select("dataset", "block", "lo", "hi", "reach"))
    if boxes.groupBy("dataset").count().filter("count > 1").isEmpty():
        nn = lists
    else:
        routed = settle(route_blocks(boxes, metric))
        other = store(_visit(routed, own, boxes, keep, metric, block_rows).select("dataset", "point", _nn()).filter(F.size("nn") > 0))
        travelled = other.select("dataset", "point").distinct()
        # only points that found something in another block have lists to merge
        merged = best_lists(lists.join(travelled, ["dataset", "point"], "left_semi").unionByName(other), keep)
        nn = store(lists.join(travelled, ["dataset", "point"], "left_anti").unionByName(merged))
    return Graph(k, points, nn, records)


def point_neighbors(graph: Graph) -> DataFrame:
    """``(dataset, point, nn)`` with the k neighbours of any one record of the point.

    All copies see the same distances: one of the point's own entries is taken out (it
    always has one, at distance zero).
    """
    own = F.array_position(F.transform("nn", lambda x: x["point"]), F.col("point"))
    rest = F.when(
        own > 0, F.concat(F.slice("nn", F.lit(1), (own - 1).cast("int")), F.slice("nn", (own + 1).cast("int"), F.size("nn")))
    ).otherwise(F.col("nn"))
    return graph.nn.select("dataset", "point", F.slice(rest, 1, graph.k).alias("nn"))


def to_records(scores: DataFrame, graph: Graph, columns: list[str]) -> DataFrame:
    """Carry point-level columns to all records of the point.

    A point without copies is its only record, so only records of copy groups are looked
    up by their features.
    """
    alone = scores.select("dataset", F.col("point").alias("rec_id"), "point", *columns)
    groups = graph.points.filter(F.col("copies") > 1).select("dataset", "point", "features", "copies")
    total = groups.agg(F.sum("copies")).first()[0]
    if not total:
        return alone
    found = scores.join(groups, ["dataset", "point"]).select("dataset", "features", "copies", "point", *columns)
    rows = graph.members.select(
        "dataset", "rec_id", F.transform("features", lambda v: v + F.lit(0.0)).alias("features")
    )
    copied = skew_lookup(rows, found, ["dataset", "features"], "copies", total, "inner", measure=False)
    return alone.join(groups, ["dataset", "point"], "left_anti").select(
        "dataset", "rec_id", "point", *columns
    ).unionByName(copied.select("dataset", "rec_id", "point", *columns))


def knn_graph(
    records: DataFrame, k: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS, approximate: ann.Approximation | None = None
) -> DataFrame:
    """``(dataset, rec_id, rank, neighbor, distance)``: k nearest others, ties by id.

    An approximate graph says so: its rows also have ``exact`` = false.
    """
    graph = knn_points(records, k, metric, block_rows, approximate)
    rows = neighbor_rows(graph)
    return rows if graph.exact else rows.withColumn("exact", F.lit(False))


def neighbor_rows(graph: Graph) -> DataFrame:
    """``(dataset, rec_id, rank, neighbor, distance)`` of all records of a graph."""
    k = graph.k
    rows = to_records(graph.nn, graph, ["nn"])
    others = F.slice(F.filter("nn", lambda x: x["id"] != F.col("rec_id")), 1, k)
    return rows.select("dataset", "rec_id", F.posexplode(others).alias("_i", "x")).select(
        "dataset", "rec_id", (F.col("_i") + 1).cast("long").alias("rank"),
        F.col("x.id").alias("neighbor"), F.col("x.distance").alias("distance"),
    )


# --- detectors on the graph ----------------------------------------------------------------


def knn_setting(k: int, method: str) -> str:
    return f"KNN(method={method}, n_neighbors={k})"


def knn_scores(graph: Graph, settings: list[tuple[int, str]]) -> DataFrame:
    """Point scores as one array, one entry per ``(k, method)``."""
    def one(k, method):
        d = F.slice(F.transform("nn", lambda x: x["distance"]), 1, k)
        if method == "largest":
            return F.element_at(d, -1)
        if method == "mean":
            return F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d)
        middle = (F.get(d, F.floor((F.size(d) - 1) / 2).cast("int")) + F.get(d, F.floor(F.size(d) / 2).cast("int"))) / 2
        return middle
    scored = F.when(F.size("nn") > 0, F.array(*[one(*s) for s in settings]))
    return point_neighbors(graph).select("dataset", "point", scored.alias("scores"))


def lof_setting(k: int, metric: str) -> str:
    return f"LOF(metric={metric}, n_neighbors={k})"


def lof_scores(graph: Graph, ks: list[int]) -> DataFrame:
    """Point LOF as one array, one entry per k: two joins on the neighbour serve all."""
    near = store(point_neighbors(graph))
    ends = near.select(
        "dataset", "point",
        F.array(*[F.element_at(F.slice(F.transform("nn", lambda x: x["distance"]), 1, k), -1) for k in ks]).alias("kd"),
    )
    edges = near.select("dataset", "point", F.posexplode("nn").alias("_i", "x")).select(
        "dataset", "point", (F.col("_i") + 1).alias("rank"),
        F.col("x.point").alias("neighbor"), F.col("x.distance").alias("distance"),
    )
    def at(column, i):
        return F.get(F.col(column), F.lit(i))
    reach = edges.join(ends.withColumnRenamed("point", "neighbor"), ["dataset", "neighbor"])
    density = reach.groupBy("dataset", "point").agg(
        F.array(*[
            1.0 / (F.avg(F.when(F.col("rank") <= k, F.greatest(at("kd", i), F.col("distance")))) + 1e-10)
            for i, k in enumerate(ks)
        ]).alias("lrd")
    )
    density = settle(density)
    ratios = edges.join(density.select("dataset", F.col("point").alias("neighbor"), F.col("lrd").alias("other")), ["dataset", "neighbor"])
    means = ratios.groupBy("dataset", "point").agg(
        F.array(*[F.avg(F.when(F.col("rank") <= k, at("other", i))) for i, k in enumerate(ks)]).alias("other")
    )
    return means.join(density, ["dataset", "point"]).select(
        "dataset", "point", F.zip_with("other", "lrd", lambda a, b: a / b).alias("scores")
    )


def neighbor_vectors(graph: Graph) -> DataFrame:
    """``(dataset, point, features, vectors)``: neighbour vectors in rank order (k rows)."""
    edges = point_neighbors(graph).select("dataset", "point", F.posexplode("nn").alias("rank", "x")).select(
        "dataset", "point", "rank", F.col("x.point").alias("neighbor"), F.col("x.id").alias("id")
    )
    features = graph.points.select("dataset", F.col("point").alias("neighbor"), F.col("features").alias("vector"))
    gathered = edges.join(features, ["dataset", "neighbor"]).groupBy("dataset", "point").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor", "vector"))).alias("v")
    )
    return gathered.join(graph.points.select("dataset", "point", "features"), ["dataset", "point"]).select(
        "dataset", "point", "features", F.col("v.neighbor").alias("neighbors"), F.flatten("v.vector").alias("vectors")
    )


def abod_setting(k: int) -> str:
    return f"ABOD(n_neighbors={k})"


def angle_variances(p: np.ndarray, v: np.ndarray, ks: list[int]) -> np.ndarray:
    """Negative variance of the weighted angles between the first k neighbours, seen from p.

    ``p`` is (rows, d) and ``v`` (rows, neighbours, d). One product serves every k, of which
    prefixes are taken; neighbours at the place of p count for none.
    """
    gap = v - p[:, None, :]
    size = (gap * gap).sum(axis=2)
    apart = size > 0
    scale = np.where(apart, size, 1.0)
    angles = np.einsum("nid,njd->nij", gap, gap) / (scale[:, :, None] * scale[:, None, :])
    pairs = apart[:, :, None] & apart[:, None, :]
    out = np.zeros((len(p), len(ks)))
    for i, k in enumerate(ks):
        a, b = np.triu_indices(min(k, v.shape[1]), 1)
        use, angle = pairs[:, a, b], angles[:, a, b]
        n = np.maximum(use.sum(axis=1), 1)
        mean = np.where(use, angle, 0).sum(axis=1) / n
        out[:, i] = -np.where(use, (angle - mean[:, None]) ** 2, 0).sum(axis=1) / n
    return out


def by_neighbours(pdf: pd.DataFrame, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, points and neighbour vectors of rows with equally many neighbours and features."""
    width = pdf["features"].map(len).to_numpy()
    count = pdf["vectors"].map(len).to_numpy() // np.maximum(width, 1)
    for shape in sorted(set(zip(width.tolist(), count.tolist()))):
        alike = np.flatnonzero((width == shape[0]) & (count == shape[1]))
        for at in range(0, len(alike), rows):
            part = alike[at : at + rows]
            p = np.stack(pdf["features"].iloc[part].to_list())
            yield part, p, np.stack(pdf["vectors"].iloc[part].to_list()).reshape(len(part), shape[1], shape[0])


def abod_scores(graph: Graph, ks: list[int]) -> DataFrame:
    """Point scores: pairs of neighbours are formed inside numpy, never as rows."""
    def score(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), len(ks)))
            for part, p, v in by_neighbours(pdf):
                out[part] = angle_variances(p, v, ks)
            yield pd.DataFrame({"dataset": pdf["dataset"], "point": pdf["point"], "scores": list(out)})

    return neighbor_vectors(graph).mapInPandas(score, "dataset string, point long, scores array<double>")


def cof_setting(k: int) -> str:
    return f"COF(n_neighbors={k})"


def chain_distances(p: np.ndarray, v: np.ndarray, ks: list[int]) -> np.ndarray:
    """Average chaining distance from p through its first k neighbours, nearest to the set first.

    ``p`` is (rows, d) and ``v`` (rows, neighbours, d); a step of the chain is taken for all rows
    at once.
    """
    rows = np.arange(len(p))
    start = np.sqrt(((v - p[:, None, :]) ** 2).sum(axis=2))
    out = np.zeros((len(p), len(ks)))
    for column, wanted in enumerate(ks):
        k = min(wanted, v.shape[1])
        near, left = start[:, :k].copy(), np.ones((len(p), k), dtype=bool)
        for i in range(1, k + 1):
            # ties go to the neighbour of lower rank
            j = np.argmin(np.where(left, near, np.inf), axis=1)
            out[:, column] += 2 * (k + 1 - i) / (k * (k + 1)) * near[rows, j]
            left[rows, j] = False
            near = np.minimum(near, np.sqrt(((v[:, :k] - v[rows, j][:, None, :]) ** 2).sum(axis=2)))
    return out


def cof_scores(graph: Graph, ks: list[int]) -> DataFrame:
    def chains(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), len(ks)))
            for part, p, v in by_neighbours(pdf):
                out[part] = chain_distances(p, v, ks)
            yield pd.DataFrame({
                "dataset": pdf["dataset"], "point": pdf["point"], "neighbors": pdf["neighbors"], "ac": list(out),
            })

    schema = "dataset string, point long, neighbors array<long>, ac array<double>"
    chained = settle(neighbor_vectors(graph).mapInPandas(chains, schema))
    edges = chained.select("dataset", "point", F.posexplode("neighbors").alias("rank", "neighbor"))
    other = chained.select("dataset", F.col("point").alias("neighbor"), F.col("ac").alias("other"))
    sums = edges.join(other, ["dataset", "neighbor"]).groupBy("dataset", "point").agg(
        F.array(*[F.avg(F.when(F.col("rank") < k, F.get("other", F.lit(i)))) for i, k in enumerate(ks)]).alias("mean")
    )
    # a chain without length inside a group of copies is as dense as its neighbours
    ratio = lambda a, m: F.when(m > 0, a / m).otherwise(F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(1.0)))
    return sums.join(chained.select("dataset", "point", "ac"), ["dataset", "point"]).select(
        "dataset", "point", F.zip_with("ac", "mean", ratio).alias("scores")
    )


def explode_scores(scores: DataFrame, graph: Graph, names: list[str]) -> DataFrame:
    """Record-level ``(dataset, rec_id, algorithm, score)``."""
    labels = F.array(*[F.lit(n) for n in names])
    return to_records(scores, graph, ["scores"]).select(
        "dataset", "rec_id", F.posexplode("scores").alias("_i", "score")
    ).select("dataset", "rec_id", F.element_at(labels, F.col("_i") + 1).alias("algorithm"), "score")


def _one(scores: DataFrame, graph: Graph) -> DataFrame:
    return to_records(scores, graph, ["scores"]).select(
        "dataset", "rec_id", F.get("scores", F.lit(0)).alias("score")
    )


def score_knn(records: DataFrame, k: int = 5, method: str = "largest", graph: Graph | None = None) -> DataFrame:
    graph = graph or knn_points(records, k)
    return _one(knn_scores(graph, [(k, method)]), graph)


def score_lof(
    records: DataFrame, k: int = 20, metric: str = "minkowski", graph: Graph | None = None
) -> DataFrame:
    """Local outlier factor; minkowski is of order two, the same as euclidean."""
    graph = graph or knn_points(records, k, "manhattan" if metric == "manhattan" else "euclidean")
    return _one(lof_scores(graph, [k]), graph)


def score_abod(records: DataFrame, k: int = 10, graph: Graph | None = None) -> DataFrame:
    graph = graph or knn_points(records, k)
    return _one(abod_scores(graph, [k]), graph)


def score_cof(records: DataFrame, k: int = 20, graph: Graph | None = None) -> DataFrame:
    graph = graph or knn_points(records, k)
    return _one(cof_scores(graph, [k]), graph)

"""One-class support vector machine (Schölkopf et al. 2001), distributed form.

The kernel is approximated with landmarks (Nyström map). In the map's coordinates the dual is the point
of least norm among all weighted means of the records with weights of at most 1 / (nu n). It is
approached by fully corrective conditional gradients: each step adds the mean of the nu n records of
least projection (an atom) and takes the least point of the hull of all atoms so far. One distributed
sum per step serves all datasets and settings: counts, projections and coordinates by cells of the
projection, finest around the expected offset. It gives the atom, and the primal value at the cells'
limits, so each dataset and setting knows its duality gap; steps go on until all gaps are within the
tolerance (times the mean squared length of a record), or to the most.

Number of landmarks, most steps and tolerance are parameters. With the linear kernel there are at least
as many landmarks as features, so its map keeps every direction the landmarks span.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.models import feature_stats, fold_arrays, score_settings
from ...functions.runtime import settle
from ...functions.skew import skew_lookup
from .pca import standardise

LANDMARKS = 64
STEPS = 40
TOLERANCE = 1e-3
#: Limits of the cells on either side of the expected offset, by halves of the span.
HALVES = 14
KERNELS = ("linear", "poly", "rbf", "sigmoid")


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str) -> np.ndarray:
    """Kernel values with gamma = 1 / d, degree 3 and no offset."""
    gamma = 1.0 / max(1, a.shape[1])
    if kernel == "rbf":
        far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(far, 0))
    dot = a @ b.T
    return {"linear": lambda: dot, "poly": lambda: (gamma * dot) ** 3, "sigmoid": lambda: np.tanh(gamma * dot)}[kernel]()


def kernel_map(landmarks: np.ndarray, kernel: str) -> np.ndarray:
    """Square matrix that turns kernel values against the landmarks into coordinates."""
    values, vectors = np.linalg.eigh(kernel_matrix(landmarks, landmarks, kernel))
    kept = values > 1e-8 * max(1.0, float(np.abs(values).max()))
    scale = np.where(kept, 1.0 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
    return vectors * scale


def fit_landmarks(records: DataFrame, kernels: list[str], seed: int, landmarks: int = LANDMARKS) -> DataFrame:
    """Model row per dataset: statistics, a seeded set of landmarks and one map per kernel."""
    stats = feature_stats(records)
    total = stats.agg(F.sum("n")).first()[0] or 0
    wanted = F.greatest(F.lit(landmarks), F.size("mean") + 1 if "linear" in kernels else F.lit(0))
    located = skew_lookup(
        records.select("dataset", "rec_id", "features"),
        stats.select("dataset", F.col("n").alias("_n"), F.col("n").alias("_w"), wanted.alias("_want")), ["dataset"], "_w", total, "inner",
    )
    order = F.xxhash64("rec_id", F.lit(seed))
    rate = (F.col("_want") + 10 * F.sqrt("_want")) / F.col("_n")
    near = located.filter(F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate)
    rank = W.partitionBy("dataset").orderBy(order, "rec_id")
    chosen = near.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= F.col("_want"))
    marks = chosen.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("_r", "features"))).alias("m"))
    model = stats.join(marks.select("dataset", F.flatten("m.features").alias("marks")), "dataset")

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        mean, sd = np.asarray(row["mean"]), np.asarray(row["sd"])
        z = standardise(np.asarray(row["marks"]).reshape(-1, len(mean)), mean, sd)
        turned = np.concatenate([kernel_map(z, k).ravel() for k in kernels])
        return pd.DataFrame({
            "dataset": [row["dataset"]], "n": [row["n"]], "mean": [mean], "sd": [sd], "marks": [z.ravel()],
            "maps": [turned], "rows": [len(z)],
        })

    schema = (
        "dataset string, n long, mean array<double>, sd array<double>, marks array<double>, "
        "maps array<double>, rows int"
    )
    return settle(model.groupBy("dataset").applyInPandas(maps, schema))


def coordinates(x: np.ndarray, model: dict, kernels: list[str]) -> dict[str, np.ndarray]:
    z = standardise(x, model["mean"], model["sd"])
    m = int(model["rows"])
    marks = model["marks"].reshape(m, -1)
    return {
        k: kernel_matrix(z, marks, k) @ model["maps"][i * m * m : (i + 1) * m * m].reshape(m, m)
        for i, k in enumerate(kernels)
    }


def setting_name(nu: float, kernel: str) -> str:
    return f"OCSVM(kernel={kernel}, nu={nu})"


def least_point(atoms: np.ndarray, shares: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Shares (not negative, summing to 1) of the point of least norm in the hull of ``atoms``.

    Share moves from the atom of largest projection that has some to that of least projection.
    """
    gram = atoms @ atoms.T
    shares = shares.copy()
    for _ in range(rounds):
        slope = gram @ shares
        low = int(slope.argmin())
        held = np.flatnonzero(shares > 0)
        high = int(held[slope[held].argmax()])
        gap = slope[high] - slope[low]
        curve = gram[high, high] + gram[low, low] - 2 * gram[high, low]
        if gap <= 1e-12 * max(1.0, float(gram.max())) or curve <= 0:
            break
        move = min(shares[high], gap / curve)
        shares[high] -= move
        shares[low] += move
    return shares


def cell_limits(offset: float, span: float) -> np.ndarray:
    """Ascending limits of cells around an expected offset."""
    steps = span * 0.5 ** np.arange(HALVES)
    return np.concatenate([offset - steps, [offset], (offset + steps)[::-1]])


def next_step(weights: np.ndarray, limits: np.ndarray, sums: np.ndarray, nu: float, n: int) -> tuple[np.ndarray, float, float]:
    """New atom, offset for the next cells, and duality gap of ``weights``.

    ``sums`` has a row per cell: records, sum of projections, sum of coordinates.
    """
    wanted = nu * n
    count = np.concatenate([[0.0], np.cumsum(sums[:, 0])])
    cell = min(int(np.searchsorted(count, wanted, "left")) - 1, len(sums) - 1)
    cell = max(cell, 0)
    share = (wanted - count[cell]) / sums[cell, 0] if sums[cell, 0] else 0.0
    atom = (sums[:cell, 2:].sum(0) + share * sums[cell, 2:]) / wanted
    # primal value at every limit, for which the records below are known
    below, projected = count[1:-1], np.cumsum(sums[:-1, 1])
    primal = 0.5 * weights @ weights - limits + (limits * below - projected) / wanted
    gap = float(primal.min() + 0.5 * weights @ weights)
    offset = sums[cell, 1] / sums[cell, 0] if sums[cell, 0] else limits[min(cell, len(limits) - 1)]  # mean projection of the cell
    return atom, float(offset), max(gap, 0.0)


def _unpack(row: dict, settings: int) -> dict[str, np.ndarray]:
    """Arrays of one dataset's state, by setting."""
    state = {k: np.array(row[k], dtype=np.float64).reshape(settings, -1) for k in ("weights", "limits", "shares")}
    state["atoms"] = np.asarray(row["atoms"], dtype=np.float64).reshape(settings, -1, state["weights"].shape[1])
    for k in ("offset", "gap", "scale"):
        state[k] = np.array(row[k], dtype=np.float64)
    return state


_STATE = "atoms array<double>, shares array<double>, weights array<double>, offset array<double>, limits array<double>, gap array<double>, scale array<double>, taken int"


def fit_ocsvm(
    records: DataFrame, settings: list[tuple[float, str]], steps: int = STEPS, seed: int = 42,
    landmarks: int = LANDMARKS, tolerance: float = TOLERANCE, **limits
) -> DataFrame:
    """Models of many ``(nu, kernel)``, a row per dataset, with the duality gap of each setting."""
    kernels = sorted({k for _, k in settings})
    base = fit_landmarks(records, kernels, seed, landmarks)

    def means(x, model):
        phi = coordinates(x, model, kernels)
        return np.array([np.append(phi[k].sum(0), (phi[k] ** 2).sum()) for _, k in settings])

    def begin(batches):
        for pdf in batches:
            rows = []
            for n, m, total in zip(pdf["n"], pdf["rows"], pdf["total"]):
                mean = np.asarray(total).reshape(len(settings), m + 1) / n
                weights, scale = mean[:, :m], mean[:, m]
                offset = (weights**2).sum(1)
                span = np.sqrt(offset * scale) + 1e-12
                rows.append({
                    "atoms": weights.ravel(), "shares": np.ones(len(settings)), "weights": weights.ravel(), "offset": offset,
                    "limits": np.concatenate([cell_limits(o, s) for o, s in zip(offset, span)]), "gap": np.full(len(settings), np.inf), "scale": scale, "taken": 0,
                })
            yield pd.concat([pdf.drop(columns="total").reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    first = base.join(fold_arrays(records, base, means, **limits), "dataset")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    models = settle(first.select(*base.columns, "total").mapInPandas(begin, f"{kinds}, {_STATE}"))

    def cells(x, model):
        phi = coordinates(x, model, kernels)
        out = []
        for i, (_, kernel) in enumerate(settings):
            p = phi[kernel]
            projected = p @ model["weights"].reshape(len(settings), -1)[i]
            edges = model["limits"].reshape(len(settings), -1)[i]
            within = np.searchsorted(edges, projected, "left")  # cells end with their limit
            one = np.zeros((len(edges) + 1, len(p)))
            one[within, np.arange(len(p))] = 1.0
            out.append(one @ np.column_stack([np.ones(len(p)), projected, p]))
        return np.array(out)

    columns = models.columns

    def improve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                state, m, n = _unpack(row, len(settings)), int(row["rows"]), int(row["n"])
                sums = np.asarray(row["total"]).reshape(len(settings), -1, m + 2)
                atoms, shares = [], []
                for i, (nu, _) in enumerate(settings):
                    weights, edges = state["weights"][i], state["limits"][i]
                    atom, offset, gap = next_step(weights, edges, sums[i], nu, n)
                    every = np.vstack([state["atoms"][i], atom])
                    share = np.append(state["shares"][i], 0.0)
                    if gap > tolerance * state["scale"][i]:
                        share = least_point(every, share)
                    atoms.append(every)
                    shares.append(share)
                    state["gap"][i], state["weights"][i] = gap, share @ every
                    moved = abs(offset - state["offset"][i]) + float(np.linalg.norm(state["weights"][i] - weights)) * float(np.sqrt(state["scale"][i]))
                    state["offset"][i], state["limits"][i] = offset, cell_limits(offset, 4 * moved + 1e-9 * (1 + abs(offset)))
                rows.append({
                    "atoms": np.array(atoms).ravel(), "shares": np.array(shares).ravel(), "taken": row["taken"] + 1,
                    **{k: state[k].ravel() for k in ("weights", "offset", "limits", "gap", "scale")},
                })
            kept = [c for c in pdf.columns if c != "total" and (not rows or c not in rows[0])]
            yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(rows)], axis=1)[columns]

    for _ in range(steps):
        folded = fold_arrays(records, models.drop("atoms", "shares", "gap", "scale"), cells, **limits)
        models = settle(models.join(folded, "dataset").select(*columns, "total").mapInPandas(improve, models.schema))
        far = F.exists(F.zip_with("gap", "scale", lambda g, s: g > tolerance * s), lambda x: x)
        if models.filter(far).isEmpty():
            break
    return models


def ocsvm_gaps(models: DataFrame, settings: list[tuple[float, str]], tolerance: float = TOLERANCE) -> DataFrame:
    """``(dataset, algorithm, steps, objective, gap, converged)``: how far each model may be from the optimum.

    ``objective`` is the dual's; the primal's lies above it by ``gap``, and the optimum between them.
    """
    names = F.array(*[F.lit(setting_name(*s)) for s in settings])
    norms = F.transform(F.sequence(F.lit(0), F.lit(len(settings) - 1)), lambda i: F.aggregate(
        F.slice("weights", i * F.col("rows") + 1, F.col("rows")), F.lit(0.0), lambda t, w: t + w * w))
    rows = models.select("dataset", "taken", F.inline(F.arrays_zip(
        names.alias("algorithm"), norms.alias("norm"), F.col("gap"), F.col("scale"))))
    return rows.select(
        "dataset", "algorithm", F.col("taken").alias("steps"), (-F.col("norm") / 2).alias("objective"), "gap",
        (F.col("gap") <= tolerance * F.col("scale")).alias("converged"),
    )


def score_ocsvm_settings(
    records: DataFrame, settings: list[tuple[float, str]], steps: int = STEPS, seed: int = 42,
    landmarks: int = LANDMARKS, tolerance: float = TOLERANCE, **limits
) -> DataFrame:
    """Boundary scores of many ``(nu, kernel)``: offset minus projection."""
    models = fit_ocsvm(records, settings, steps, seed, landmarks, tolerance, **limits)
    open_ones = ocsvm_gaps(models, settings, tolerance).filter(~F.col("converged")).agg(F.count(F.lit(1)), F.max("gap")).first()
    if open_ones[0]:
        warnings.warn(f"{open_ones[0]} one-class models stopped after {steps} steps with gaps up to {open_ones[1]:.3g}", stacklevel=2)
    kernels = sorted({k for _, k in settings})

    def score(x, model):
        phi = coordinates(x, model, kernels)
        weights = model["weights"].reshape(len(settings), -1)
        return np.column_stack([model["offset"][i] - phi[k] @ weights[i] for i, (_, k) in enumerate(settings)])

    lean = models.select("dataset", "n", "mean", "sd", "marks", "maps", "rows", "weights", "offset")
    return score_settings(records, lean, score, [setting_name(*s) for s in settings], **limits)


def score_ocsvm(records: DataFrame, nu: float = 0.5, kernel: str = "rbf", steps: int = STEPS, **limits) -> DataFrame:
    scores = score_ocsvm_settings(records, [(nu, kernel)], steps, **limits)
    return scores.select("dataset", "rec_id", "score")

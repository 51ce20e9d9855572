"""Kernel classifiers on a precomputed kernel, and their cross-validation.

Up to MOST sequences the matrix is gathered: by the driver, which trains, and by
one task per (setting, repeat, fold) of a cross-validation. Larger ones are
trained in blocks, with the matrix left in Spark; cross-validation refuses them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.lineage import saved
from kmerloom.plans.ranks import by_quantile, hashed_order, running_sums

from . import metrics

#: Sequences beyond which a full kernel matrix isn't gathered.
MOST = 8_000


def solve_svc(k: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-4, alpha: np.ndarray | None = None, grad: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """C-SVC by sequential minimal optimisation with the maximal violating pair: alpha >= 0 and b of f(x) = sum alpha y k - b.

    Runs until no pair violates the optimality conditions by tol; an error where
    rounding stops it before. Starts from alpha, grad (of the dual), if given.
    """
    if not np.isfinite(k).all():
        raise ValueError("a kernel has finite values")
    n = len(y)
    alpha = np.zeros(n) if alpha is None else alpha.copy()
    grad = -np.ones(n) if grad is None else grad.copy()
    diag = np.diag(k)
    while n:
        up, low = _movable(alpha, y, c)
        if not up.any() or not low.any():
            break
        v = -y * grad
        i = int(np.where(up, v, -np.inf).argmax())
        j = int(np.where(low, v, np.inf).argmin())
        if v[i] - v[j] < tol:
            break
        curve = max(diag[i] + diag[j] - 2 * k[i, j], 1e-12)
        step = (v[i] - v[j]) / curve
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        held = alpha[i], alpha[j]
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        if held == (alpha[i], alpha[j]):
            raise ArithmeticError(f"no progress at a violation of {v[i] - v[j]:.3g}: is the kernel positive semidefinite?")
        grad += y * (k[:, i] - k[:, j]) * step
    return alpha, _offset(alpha, grad, y, c)


def _movable(alpha: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows may raise y * alpha, and which may lower it."""
    below, above = alpha < c, alpha > 0
    return np.where(y > 0, below, above), np.where(y > 0, above, below)


def _offset(alpha: np.ndarray, grad: np.ndarray, y: np.ndarray, c: float) -> float:
    v = -y * grad
    free = (alpha > 1e-12) & (alpha < c - 1e-12)
    if free.any():
        return -float(v[free].mean())
    up, low = _movable(alpha, y, c)
    hi, lo = (v[up].max() if up.any() else 0.0), (v[low].min() if low.any() else 0.0)
    return -float(hi + lo) / 2


def solve_in_blocks(kernel: DataFrame, ids: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-3, working: int = 1_000) -> tuple[np.ndarray, float]:
    """C-SVC over a kernel that isn't gathered: both triangles as rows (i, j, k), absent pairs 0, absent diagonals 1.

    Decomposition: the rows that violate most make a working set, whose part of
    the kernel is fetched and solved; the gradient of all rows then changes by
    one product of the kernel with the changed alphas, a join and a sum in
    Spark. The driver holds `working`^2 numbers and three per sequence.
    """
    spark = kernel.sparkSession
    own = spark.createDataFrame(pd.DataFrame({"i": ids, "j": ids, "k": np.ones(len(ids))}), "i long, j long, k double")
    diagonal = own.join(kernel.where("i = j").select("i"), "i", "left_anti")
    full = saved(kernel.select("i", "j", "k").unionByName(diagonal.select("i", "j", "k")))
    alpha, grad = np.zeros(len(ids)), -np.ones(len(ids))
    least = np.inf
    while len(ids):
        up, low = _movable(alpha, y, c)
        v = -y * grad
        if not up.any() or not low.any() or v[up].max() - v[low].min() < tol:
            break
        first = np.argsort(np.where(up, -v, np.inf), kind="stable")[: working // 2]
        last = np.argsort(np.where(low, v, np.inf), kind="stable")[: working // 2]
        on = np.unique(np.concatenate([first, last]))
        some = lambda name: F.broadcast(spark.createDataFrame(pd.DataFrame({name: ids[on]}), f"{name} long"))  # noqa: B023, E731
        part = full.join(some("i"), "i").join(some("j"), "j").select("i", "j", "k").toPandas()
        k = np.zeros((len(on), len(on)))
        k[np.searchsorted(ids[on], part["i"]), np.searchsorted(ids[on], part["j"])] = part["k"]
        new, _ = solve_svc(k, y[on], c, tol / 2, alpha[on], grad[on])
        change = y[on] * (new - alpha[on])
        moved = np.flatnonzero(change)
        if not len(moved):
            raise ArithmeticError("no progress: is the kernel positive semidefinite?")
        delta = spark.createDataFrame(pd.DataFrame({"j": ids[on][moved], "x": change[moved]}), "j long, x double")
        g = full.join(F.broadcast(delta), "j").groupBy("i").agg(F.sum(F.col("k") * F.col("x")).alias("g")).toPandas()
        at = np.searchsorted(ids, g["i"])
        grad[at] += y[at] * g["g"].to_numpy()
        alpha[on] = new
    return alpha, _offset(alpha, grad, y, c)


def solve_ascent(k: np.ndarray, y: np.ndarray, rounds: int = 1, seed: int = 0) -> np.ndarray:
    """Coordinate ascent without offset: each lambda in [0,1], 20 shuffled visits of every row a round."""
    n = len(y)
    lam = np.full(n, 0.5)
    order = np.random.default_rng(seed).permutation(np.arange(20 * n) % max(n, 1))
    signed = k * y[None, :]
    for _ in range(rounds):
        for j in order:
            lam[j] = min(1.0, max(0.0, 1 - y[j] * (signed[j] @ lam) + lam[j]))
    return lam


def objective(kernel: DataFrame, alphas: DataFrame) -> DataFrame:
    """The dual objective: sum |alpha| - half the quadratic form; kernel has both triangles, alphas are signed."""
    a = alphas.select(F.col("seq_id").alias("i"), F.col("alpha").alias("ai"))
    b = alphas.select(F.col("seq_id").alias("j"), F.col("alpha").alias("aj"))
    q = kernel.join(a, "i").join(b, "j").agg(F.coalesce(F.sum(F.col("ai") * F.col("aj") * F.col("k")), F.lit(0.0)).alias("q"))
    return alphas.agg(F.sum(F.abs("alpha")).alias("s")).crossJoin(q).select((F.col("s") - F.col("q") / 2).alias("objective"))


def classes(labels: DataFrame) -> DataFrame:
    """seq_id, label of the rows that have both; conflicting labels of an id: the highest."""
    return labels.select("seq_id", "label").dropna().groupBy("seq_id").agg(F.max("label").alias("label"))


def _ids(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = classes(labels).toPandas().sort_values("seq_id")
    return rows["seq_id"].to_numpy(), np.where(rows["label"].to_numpy() > 0, 1.0, -1.0)


def _part(kernel: DataFrame, labels: DataFrame) -> DataFrame:
    keep = classes(labels).select("seq_id")
    return kernel.join(keep.select(F.col("seq_id").alias("i")), "i", "left_semi").join(keep.select(F.col("seq_id").alias("j")), "j", "left_semi").select("i", "j", "k")


def gather(kernel: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids in order, y in {-1, 1} and the matrix, from the lower triangle; absent pairs are 0, absent diagonals 1."""
    n = classes(labels).count()
    if n > MOST:
        raise ValueError(f"{n} sequences: a kernel matrix of more than {MOST} isn't gathered")
    ids, y = _ids(labels)
    part = _part(kernel, labels).toPandas()
    k = np.eye(len(ids))
    a, b = np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"])
    k[a, b] = k[b, a] = part["k"]
    return ids, y, k


def train(kernel: DataFrame, labels: DataFrame, c: float = 1.0, solver: str = "svc", most: int = MOST) -> DataFrame:
    """seq_id, alpha (signed by class) of the support sequences.

    Up to `most` sequences the matrix is gathered and solved in one place; svc
    solves larger ones in blocks, with the matrix left in Spark.
    """
    if solver == "svc" and classes(labels).count() > most:
        ids, y = _ids(labels)
        low = _part(kernel, labels)
        alpha, _ = solve_in_blocks(low.unionByName(low.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k")), ids, y, c)
    else:
        ids, y, k = gather(kernel, labels)
        alpha = solve_svc(k, y, c)[0] if solver == "svc" else solve_ascent(k, y)
    return support(kernel.sparkSession.createDataFrame(pd.DataFrame({"seq_id": ids, "alpha": alpha * y}), "seq_id long, alpha double"))


#: Fixed value: weights beyond this make a support sequence.
LEAST_ALPHA = 1e-10


def support(alphas: DataFrame) -> DataFrame:
    """The sequences whose weight counts."""
    return alphas.where(F.abs("alpha") > LEAST_ALPHA)


def assign_folds(ids: DataFrame, n_folds: int, key: str = "seq_id", seed: str = "folds-1") -> DataFrame:
    """key, cv_set 1..n: balanced, by the order of a seeded hash."""
    if n_folds < 2:
        raise ValueError("at least two folds")
    slot, order = hashed_order(key, seed)
    d = ids.select(key).distinct().select(key, slot.alias("_slot"), order.alias("_order"), F.lit(1).alias("_one"))
    d = running_sums(d, "_slot", [F.col("_order"), F.col(key)], {"_place": "_one"})
    return d.select(key, (F.pmod(F.col("_place") + 1, F.lit(n_folds)) + 1).cast("int").alias("cv_set"))


def shifted_folds(folds: DataFrame, key: str = "seq_id") -> DataFrame:
    """A caller's folds, moved to begin with 1."""
    least = folds.agg(F.min("cv_set")).first()[0] or 1
    return folds.select(key, (F.col("cv_set") - (least - 1)).cast("int").alias("cv_set"))


def rotated(folds: np.ndarray, r: int) -> np.ndarray:
    """The folds of repeat r: the first r go to the end."""
    return np.roll(folds, -r)


def rotate_folds(folds: DataFrame, repeats: int, key: str = "seq_id", seed_slots: int = 64) -> DataFrame:
    """repeat, key, cv_set: repeat r gives the sequence of place p (in key order) the fold of place p + r, around the end."""
    n = folds.count()
    d = folds.select(F.col(key).alias("_id"), "cv_set").withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1))
    d = running_sums(by_quantile(d, "_id", "_g", seed_slots), "_slot", [F.col("_id")], {"_place": "_one"})
    d = saved(d.select("_id", "cv_set", "_place"))
    to = d.select(F.col("cv_set"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), "_place").withColumn("_place", F.pmod(F.col("_place") - F.col("repeat"), F.lit(max(n, 1))))
    return to.join(d.select("_id", "_place"), "_place").select("repeat", F.col("_id").alias(key), "cv_set")


def cross_validate(kernel: DataFrame, labels: DataFrame, settings: list[float], n_folds: int = 5, repeats: int = 1, folds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions (c, repeat, fold, seq_id, score, label), the table of settings (idx, c, auroc, auprc) and per-sequence means.

    A repeat r rotates the folds by r places in id order (the first by one, too);
    the cv_set of the means is the fold before any rotation.
    One task per setting, repeat and fold; each gets the matrix by broadcast,
    whose size gather() has checked.
    """
    spark = kernel.sparkSession
    ids, y, k = gather(kernel, labels)
    f = (shifted_folds(folds) if folds is not None else assign_folds(classes(labels), n_folds)).toPandas().set_index("seq_id")["cv_set"].reindex(ids).to_numpy()
    repeats = min(repeats, max(len(ids) - 1, 1))
    held = spark.sparkContext.broadcast((ids, y, k, f))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids, y, k, f = held.value
        out = []
        for idx, c, r, fold in df[["idx", "c", "r", "fold"]].itertuples(index=False):
            test = rotated(f, r) == fold
            if not test.any() or test.all():
                continue
            a, b = solve_svc(k[np.ix_(~test, ~test)], y[~test], c)
            s = k[np.ix_(test, ~test)] @ (a * y[~test]) - b
            out.append(pd.DataFrame({"idx": idx, "c": c, "r": r, "fold": fold, "seq_id": ids[test], "score": s, "label": (y[test] > 0).astype(int)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["idx", "c", "r", "fold", "seq_id", "score", "label"])

    grid = [(i, float(c), r, int(g)) for i, c in enumerate(settings) for r in range(1, repeats + 1) for g in sorted(set(f.tolist()))]
    if not grid:
        grid = [(0, 1.0, 1, 1)]
    plan = spark.createDataFrame(grid, "idx int, c double, r int, fold int")
    pred = saved(plan.repartition(len(grid), "idx", "r", "fold").groupBy("idx", "r", "fold").applyInPandas(run, "idx int, c double, r int, fold int, seq_id long, score double, label int"))
    by = pred.withColumn("g", F.concat_ws(":", "idx", "r", "fold"))
    table = metrics.auroc(by, "g").join(metrics.auprc(by, "g"), "g").join(by.select("g", "idx", "c").distinct(), "g")
    table = table.groupBy("idx", "c").agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))
    sets = spark.createDataFrame(pd.DataFrame({"seq_id": ids, "cv_set": f}), "seq_id long, cv_set int")
    means = pred.groupBy("idx", "seq_id").agg(F.avg("score").alias("cvpred_mean"), F.stddev_samp("score").alias("cvpred_sd"), F.max("label").alias("label")).join(sets, "seq_id")
    return pred, table, means.select("idx", "seq_id", "cvpred_mean", "cvpred_sd", "label", "cv_set")


def refit(kernel: DataFrame, labels: DataFrame, table: DataFrame) -> tuple[float, DataFrame]:
    """The setting with the highest auroc (the first on ties), and the support sequences of a model of all rows at it."""
    best = metrics.best_setting(table).first()
    c = 1.0 if best is None else float(best["c"])
    return c, train(kernel, labels, c)

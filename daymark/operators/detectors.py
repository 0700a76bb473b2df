"""Detectors behind one interface: ``fit(train)`` gives a model, ``model.score(rows)`` adds a ``score`` column.

Training and scoring stay distributed. What leaves the executors is bounded by the model, never by the data:
class counts, coefficients, trees of fixed size, or a capped node set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions.hashing import digest
from daymark.operators import forest
from daymark.operators.features import active_columns, clip
from daymark.operators.sampling import cap_keeping_positives, negative_rows, negative_users
from daymark.operators.sequences import context_windows
from daymark.schema import BASE_COLUMNS, COUNT_COLUMNS, DEV_COLUMNS


def assemble(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Vector column ``features`` in the given column order."""
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def feature_group(name: str, columns: Sequence[str]) -> list[str]:
    """Columns of an ablation variant: ``counts``, ``base``, ``base_dev``, ``memory`` or ``both``."""
    memory = [c for c in columns if c.startswith(("mem_", "host_"))]
    groups = {
        "counts": COUNT_COLUMNS,
        "base": BASE_COLUMNS,
        "base_dev": BASE_COLUMNS + DEV_COLUMNS,
        "memory": memory,
        "both": BASE_COLUMNS + DEV_COLUMNS + memory,
    }
    wanted = groups[name]
    absent = [c for c in wanted if c not in columns]
    if absent or not wanted:
        raise ValueError(f"feature group {name} needs columns {absent or 'of the memory operator'}")
    return wanted


@dataclass
class Scaler:
    """Standardises base columns with training statistics and clips; other columns are clipped only.

    The statistics are a few numbers per column, so they are kept as literals: scaling needs no join.
    """

    columns: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    bound: float = 8.0

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], scale_all: bool = False) -> Scaler:
        scaled = [c for c in columns if scale_all or c not in DEV_COLUMNS]
        aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(scaled)]
        aggs += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(scaled)]
        row = train.agg(*aggs).first()
        mean = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(scaled)}
        std = {c: float(row[f"s{i}"]) if (row[f"s{i}"] or 0.0) > 1e-12 else 1.0 for i, c in enumerate(scaled)}
        return Scaler(list(columns), mean, std)

    def column(self, name: str):
        x = F.col(name).cast("double")
        if name in self.mean:
            x = (x - F.lit(self.mean[name])) / F.lit(self.std[name])
        return clip(x, self.bound)

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: self.column(c) for c in self.columns})

    def vectors(self) -> Column:
        """The values of ``apply`` as one vector column ``features``.

        They are scaled by numpy, many rows at once; a projection of 42 such columns costs the JVM several times as much.
        """
        mean = np.array([self.mean.get(c, 0.0) for c in self.columns])
        std = np.array([self.std.get(c, 1.0) for c in self.columns])
        width, bound = len(self.columns), self.bound

        @F.arrow_udf("array<double>")
        def scaled(rows: pa.Array) -> pa.Array:
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)  # a null comes as NaN
            x = (x - mean) / std
            x = np.where(np.isnan(x), bound, np.clip(x, -bound, bound))  # as in ``clip``, where null and NaN are above all numbers
            return pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))

        lists = scaled(F.array(*[F.col(c).cast("double") for c in self.columns]))
        return array_to_vector(lists).alias("features", metadata={"ml_attr": {"num_attrs": width}})


def class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    return int(row["neg"]), int(row["pos"])


def balanced_weights(train: DataFrame, neg: int, pos: int) -> DataFrame:
    """Weight n / (2 n_class)."""
    n = neg + pos
    w = F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * neg))
    extra = F.col("extra_weight") if "extra_weight" in train.columns else F.lit(1.0)
    return train.withColumn("weight", w * extra)


@dataclass
class Fitted:
    """A fitted detector: ``score`` adds one column and drops nothing."""

    add_score: Callable[[DataFrame], DataFrame]
    details: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        return self.add_score(rows)


def constant(value: float) -> Fitted:
    """For training sets with a single class."""
    return Fitted(lambda rows: rows.withColumn("score", F.lit(float(value))), {"constant": value})


def _probability(model, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    drop = ["features", "rawPrediction", "probability", "prediction"]

    def add(rows: DataFrame) -> DataFrame:
        scored = model.transform(prepare(rows)).withColumn("score", vector_to_array("probability")[1])
        return scored.select(*rows.columns, "score") if not set(drop) & set(rows.columns) else scored

    return add


def parts_wanted(rows: DataFrame, n_rows: int, per_task: int, most: int | None) -> int:
    wanted = math.ceil(n_rows / per_task)
    if most is not None:
        wanted = min(wanted, max(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / most)))
    return max(1, wanted)


def spread(rows: DataFrame, n_rows: int, per_task: int = 20_000, most: int | None = None) -> DataFrame:
    """Training rows in even partitions: iterative fits read them many times, so one shuffle pays off.

    The number of partitions follows the number of rows, since every iteration pays for each of them. With ``most``, partitions grow to
    so many rows before there are more than four a core; not for fits that depend on the partitions.
    """
    return rows.repartition(parts_wanted(rows, n_rows, per_task, most))


def gathered(rows: DataFrame, n_rows: int, per_task: int = 20_000, most: int | None = None) -> DataFrame:
    """``spread`` for rows that are kept afterwards. Many rows stay where they are read, in no more partitions than wanted: a shuffle would hold a
    second copy of them on disk, until the driver collects its garbage. Few rows are shuffled, so that one task does not read the whole table."""
    wanted = parts_wanted(rows, n_rows, per_task, most)
    return spread(rows, n_rows, per_task, most) if wanted < rows.sparkSession.sparkContext.defaultParallelism else rows.coalesce(wanted)


def _columns(train: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else active_columns(train)


class ForestDetector:
    """Random forest whose trees are each balanced over their own bootstrap (see ``forest``)."""

    def __init__(self, trees: int = 300, depth: int = 12, columns: Sequence[str] | None = None, seed: int = 0, bins: int = 32):
        self.trees, self.depth, self.columns, self.seed, self.bins = trees, depth, columns, seed, bins

    def fit(self, train: DataFrame) -> Fitted:
        neg, pos = class_counts(train)
        if not neg or not pos:
            return constant(0.0)
        cols = _columns(train, self.columns)
        edges = forest.bin_edges(train, cols, neg + pos, self.bins, self.seed)
        cores = train.sparkSession.sparkContext.defaultParallelism
        table = forest.blocks(train, cols, edges, max(1, min(math.ceil((neg + pos) / self.per_task), max(4 * cores, math.ceil((neg + pos) / self.most)))))
        grown, importance = forest.grow(
            table, len(cols), self.bins, self.trees, self.depth, self.seed, neg + pos, forest.UNIT if "extra_weight" in train.columns else 1)
        score = forest.scorer(grown, edges, self.depth)
        values = F.array(*[F.col(c).cast("double") for c in cols])
        return Fitted(lambda rows: rows.withColumn("score", score(values)), {"trees": grown, "importances": dict(zip(cols, importance.tolist()))})

    #: Training rows of a part, and so many before there are more parts than four a core: every part sends counts of every tree.
    per_task, most = 5_000, 200_000


class LogisticDetector:
    """Balanced logistic regression on scaled features."""

    def __init__(self, columns: Sequence[str] | None = None, reg: float = 1e-4, max_iter: int = 100):
        self.columns, self.reg, self.max_iter = columns, reg, max_iter

    def fit(self, train: DataFrame) -> Fitted:
        neg, pos = class_counts(train)
        if not neg or not pos:
            return constant(0.0)
        cols = _columns(train, self.columns)
        scaler = Scaler.fit(train, cols)
        rows = gathered(balanced_weights(train, neg, pos).select(scaler.vectors(), "label", "weight"), neg + pos, most=250_000)
        rows.persist(StorageLevel.MEMORY_AND_DISK)  # the estimator evaluates its input several times
        try:
            model = LogisticRegression(weightCol="weight", regParam=self.reg, maxIter=self.max_iter, tol=1e-4).fit(rows)
        finally:
            rows.unpersist()
        weights = dict(zip(cols, model.coefficients.toArray().tolist()))
        return Fitted(linear_score(scaler, weights, float(model.intercept)),
                      {"weights": weights, "intercept": float(model.intercept), "scaler": scaler})


def linear_score(scaler: Scaler, weights: dict[str, float], intercept: float) -> Callable[[DataFrame], DataFrame]:
    """Sigmoid of a linear model as a plain column expression, so scoring stays in generated code."""
    logit = F.lit(intercept)
    for c, w in weights.items():
        if w:
            logit = logit + scaler.column(c) * F.lit(w)
    return lambda rows: rows.withColumn("score", 1.0 / (1.0 + F.exp(-logit)))


class PerceptronDetector:
    """Feed-forward network. The estimator takes no weights, so positives are repeated, at most 100 times."""

    def __init__(self, hidden: Sequence[int] = (128, 64), max_weight: int = 100, columns: Sequence[str] | None = None,
                 max_iter: int = 100, seed: int = 0):
        self.hidden, self.max_weight, self.columns, self.max_iter, self.seed = hidden, max_weight, columns, max_iter, seed

    def fit(self, train: DataFrame) -> Fitted:
        neg, pos = class_counts(train)
        if not neg or not pos:
            return constant(0.0)
        cols = _columns(train, self.columns)
        scaler = Scaler.fit(train, cols)
        copies = max(1, min(round(neg / pos), self.max_weight))
        rows = assemble(scaler.apply(train), cols).select("features", "label")
        times = F.when(F.col("label") == 1, copies).otherwise(1)
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
        net = MultilayerPerceptronClassifier(layers=[len(cols), *self.hidden, 2], maxIter=self.max_iter, seed=self.seed)
        return Fitted(_probability(net.fit(spread(rows, neg + pos * copies)), lambda r: assemble(scaler.apply(r), cols)), {"copies": copies})


class ReconstructionDetector:
    """Squared residual after projecting on the main components of users without any positive day."""

    def __init__(self, components: int = 8, columns: Sequence[str] | None = None):
        self.components, self.columns = components, columns

    def fit(self, train: DataFrame) -> Fitted:
        quiet = negative_users(train)
        cols = _columns(train, self.columns)
        scaler = Scaler.fit(quiet, cols, scale_all=True)
        model = PCA(k=min(self.components, len(cols)), inputCol="features", outputCol="pc").fit(
            assemble(scaler.apply(quiet), cols).select("features")
        )
        basis = model.pc.toArray()

        @F.pandas_udf("double")
        def residual(xs: pd.Series) -> pd.Series:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, len(cols)))
            rest = x - (x @ basis) @ basis.T
            return pd.Series((rest * rest).mean(axis=1))

        values = F.array(*[scaler.column(c) for c in cols])
        return Fitted(lambda rows: rows.withColumn("score", residual(values)))


# ---- isolation forest -----------------------------------------------------------------------------


def _path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree as rows (feature, threshold, left, right, path length at a leaf)."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _path_norm(len(idx))])
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = me
        if depth >= limit or len(idx) <= 1:
            continue
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[idx, f] <= cut
        nodes[me][0], nodes[me][1] = f, cut
        stack.append((idx[~left], depth + 1, me, True))
        stack.append((idx[left], depth + 1, me, False))
    return [tuple(n) for n in nodes]


class IsolationDetector:
    """Isolation forest: every tree grows in its own task from a hash-drawn sample of about 256 rows."""

    def __init__(self, trees: int = 200, sample: int = 256, columns: Sequence[str] | None = None, seed: int = 0,
                 negatives_only: bool = True):
        self.trees, self.sample, self.columns, self.seed, self.negatives_only = trees, sample, columns, seed, negatives_only

    def fit(self, train: DataFrame) -> Fitted:
        cols = _columns(train, self.columns)
        rows = negative_rows(train) if self.negatives_only else train
        scaler = Scaler.fit(rows, cols, scale_all=True)
        n = rows.count()
        draws = max(1, math.ceil(self.trees * self.sample / max(n, 1)))
        p = min(1.0, self.trees * self.sample / (max(n, 1) * draws))
        # Each row gets ``draws`` chances; a chance that hits picks one tree.
        u = lambda j: F.pmod(F.xxhash64(F.lit(self.seed), j, "user", "day"), F.lit(1 << 30)) / float(1 << 30)
        picks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), u), lambda x: x < p)
        trees = F.array_distinct(F.transform(picks, lambda x: F.floor(x / p * self.trees).cast("int")))
        x = F.array(*[scaler.column(c) for c in cols])
        sampled = rows.select(F.explode(trees).alias("tree"), "user", "day", x.alias("x"))
        limit, seed = math.ceil(math.log2(self.sample)), self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            data = np.stack(pdf.sort_values(["user", "day"])["x"].to_numpy())
            nodes = _grow(data, limit, np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
            out.insert(0, "node", range(len(out)))
            out.insert(0, "tree", tree)
            return out

        schema = "tree int, node int, feature int, threshold double, left int, right int, path double"
        grown = sampled.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").toPandas()
        forest = [tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
                  for _, g in grown.groupby("tree", sort=True)]
        shared = train.sparkSession.sparkContext.broadcast(forest)
        norm = _path_norm(self.sample)

        @F.pandas_udf("double")
        def anomaly(xs: pd.Series) -> pd.Series:
            data = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, len(cols)))
            total = np.zeros(len(data))
            rows_at = np.arange(len(data))
            for feature, threshold, left, right, path in shared.value:
                at = np.zeros(len(data), dtype=np.int64)
                for _ in range(limit + 1):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = data[rows_at, np.where(inner, f, 0)] <= threshold[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += path[at]
            return pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / norm))

        return Fitted(lambda r: r.withColumn("score", anomaly(x)), {"trees": len(forest)})


# ---- one-class boundary ---------------------------------------------------------------------------


class OneClassDetector:
    """One-class boundary in random Fourier features of the RBF kernel, fitted by full gradients.

    A step is one pass in which every partition sums its own gradient, so no training cap is needed.
    """

    def __init__(self, nu: float = 0.05, width: int = 256, steps: int = 25, columns: Sequence[str] | None = None,
                 seed: int = 0):
        self.nu, self.width, self.steps, self.columns, self.seed = nu, width, steps, columns, seed

    def fit(self, train: DataFrame) -> Fitted:
        cols = _columns(train, self.columns)
        rows = negative_rows(train)
        scaler = Scaler.fit(rows, cols, scale_all=True)
        x = F.array(*[scaler.column(c) for c in cols])
        var = rows.agg(F.avg(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)).alias("v")).first()["v"] or 1.0
        rng = np.random.default_rng(self.seed)
        gamma = 1.0 / max(var, 1e-9)
        freq = rng.normal(size=(len(cols), self.width)) * math.sqrt(2.0 * gamma)
        phase = rng.uniform(0, 2 * math.pi, self.width)
        lift = lambda data: math.sqrt(2.0 / self.width) * np.cos(data @ freq + phase)
        n = rows.count()
        data = spread(rows.select(x.alias("x")), n).persist()
        w, rho = np.zeros(self.width), 0.0
        for step in range(self.steps):
            def gradient(batches, w=w, rho=rho):
                hits, total = 0.0, np.zeros(self.width)
                for pdf in batches:
                    if len(pdf):
                        z = lift(np.stack(pdf["x"].to_numpy()))
                        inside = (z @ w) < rho if step else np.ones(len(z), dtype=bool)
                        hits += inside.sum()
                        total += z[inside].sum(axis=0)
                yield pd.DataFrame({"i": np.arange(self.width + 1), "g": np.append(total, hits)})

            sums = data.mapInPandas(gradient, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))
            g = np.zeros(self.width + 1)
            for r in sums.collect():
                g[r["i"]] = r["g"]
            rate = 1.0 / (step + 1.0)
            if step == 0:
                w = g[:-1] / max(n, 1)
                rho = float(w @ w) * (1 - self.nu)
                continue
            w = w - rate * (w - g[:-1] / (self.nu * max(n, 1)))
            rho = rho - rate * (g[-1] / (self.nu * max(n, 1)) - 1.0) * 0.1 * max(float(w @ w), 1e-9)
        data.unpersist()

        @F.pandas_udf("double")
        def distance(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            return pd.Series(-(lift(np.stack(xs.to_numpy())) @ w))

        return Fitted(lambda r: r.withColumn("score", distance(x)), {"rho": rho})


# ---- neighbours and context -----------------------------------------------------------------------


class Nodes:
    """Points among which exact nearest neighbours are looked up; ``names`` are sorted.

    Points are cut into groups. The k-th smallest of the groups' least distances bounds the k-th smallest distance, so only the groups within
    it are looked at point by point.
    """

    GROUP, ROWS = 32, 64

    def __init__(self, names: Sequence[str], points: np.ndarray):
        self.places: dict[str, tuple[int, int]] = {}
        for i, name in enumerate(names):
            self.places[name] = (self.places.get(name, (i, i))[0], i + 1)
        self.points, self.groups = points, -(-len(points) // self.GROUP)
        spare = self.groups * self.GROUP - len(points)
        self.turned = np.vstack([points, np.zeros((spare, points.shape[1]))]).T.copy()
        self.norms = np.append((points**2).sum(axis=1), np.full(spare, np.inf))
        self.kinds = np.unique(points, axis=0, return_inverse=True)[1].ravel()  # equal points have equal numbers

    @classmethod
    def of(cls, state: dict) -> Nodes:
        """Nodes again from their ``__dict__``, which is what a broadcast carries."""
        found = cls.__new__(cls)
        found.__dict__.update(state)
        return found

    def nearest(self, x: np.ndarray, names: Sequence[str], k: int) -> np.ndarray:
        """Places of the ``k`` nearest points of every row of ``x``, without those of its own name."""
        take, out = min(k, len(self.points)), []
        space = np.empty((self.ROWS, len(self.norms)))
        for lo in range(0, len(x), self.ROWS):
            part = x[lo:lo + self.ROWS]
            dist = np.matmul(part, self.turned, out=space[: len(part)])
            dist *= -2.0
            dist += self.norms
            for i, name in enumerate(names[lo:lo + self.ROWS]):
                if name in self.places:
                    dist[i, slice(*self.places[name])] = np.inf
            if self.groups < take or not np.isfinite(part).all():
                out.append(np.argpartition(dist[:, : len(self.points)], take - 1, axis=1)[:, :take])
                continue
            least = dist.reshape(len(part), self.GROUP, self.groups).min(axis=1)
            bound = np.partition(least, take - 1, axis=1)[:, take - 1]
            row, group = np.nonzero(least <= bound[:, None])
            at = (group[:, None] + np.arange(self.GROUP) * self.groups).ravel()
            row = np.repeat(row, self.GROUP)
            value = dist[row, at]
            near = value <= bound[row]
            row, at, value = row[near], at[near], value[near]
            order = np.lexsort((at, value, row))
            at, value = at[order], value[order]
            starts = np.searchsorted(row[order], np.arange(len(part) + 1))
            found = at[starts[:-1, None] + np.arange(take)]
            last = value[starts[:-1] + take - 1]
            for i in np.flatnonzero((starts[1:] - starts[:-1] > take)):
                rest = slice(starts[i], starts[i + 1])
                tied = at[rest][value[rest] == last[i]]
                if np.isinf(last[i]) or len(np.unique(self.kinds[tied])) > 1:  # different points at the same distance
                    found[i] = np.argpartition(dist[i, : len(self.points)], take - 1)[:take]
            out.append(found)
        return np.concatenate(out)


class NeighbourDetector:
    """Logistic model on a row's features and the mean of its k nearest training rows.

    As in the published method the graph's training nodes are capped, keeping positives. The capped node set is
    the only thing sent to the tasks; each row then finds its exact neighbours locally, without any pair shuffle.
    """

    def __init__(self, k: int = 8, max_nodes: int = 25_000, columns: Sequence[str] | None = None, seed: int = 0):
        self.k, self.max_nodes, self.columns, self.seed = k, max_nodes, columns, seed

    def fit(self, train: DataFrame) -> Fitted:
        cols = _columns(train, self.columns)
        scaler = Scaler.fit(train, cols)
        key = F.concat_ws("@", "user", "day")
        keyed = train.withColumn("_key", key).withColumn("_one", F.lit(1))
        nodes = cap_keeping_positives(keyed, F.col("_key"), self.max_nodes, self.seed, by=("_one",))
        matrix = nodes.select("_key", F.array(*[scaler.column(c) for c in cols]).alias("x")).orderBy("_key").toPandas()
        points = np.stack(matrix["x"].to_numpy())
        shared = train.sparkSession.sparkContext.broadcast(vars(Nodes(matrix["_key"].tolist(), points)))
        k = self.k

        @F.pandas_udf("array<double>")
        def neighbour_mean(xs: pd.Series, keys: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            nodes, x = Nodes.of(shared.value), np.stack(xs.to_numpy())
            return pd.Series(nodes.points[nodes.nearest(x, keys.tolist(), k)].mean(axis=1).tolist())

        names = [f"nb_{c}" for c in cols]

        def widen(rows: DataFrame) -> DataFrame:
            x = F.array(*[scaler.column(c) for c in cols])
            with_mean = rows.withColumn("_nb", neighbour_mean(x, key))
            return with_mean.select(*rows.columns, *[F.get("_nb", F.lit(i)).alias(n) for i, n in enumerate(names)])

        wide = widen(train).persist()
        inner = LogisticDetector(columns=[*cols, *names]).fit(wide)
        wide.unpersist()
        return Fitted(lambda rows: inner.score(widen(rows)).select(*rows.columns, "score"), inner.details)


class ContextDetector:
    """Logistic model on the last, mean and largest value of each feature over the user's last 8 days.

    Windows need the user's earlier days, so rows to score must come with their history.
    """

    def __init__(self, length: int = 8, columns: Sequence[str] | None = None):
        self.length, self.columns = length, columns

    def widen(self, rows: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
        out = context_windows(rows, cols, self.length)
        extra = {}
        for i, c in enumerate(cols):
            values = F.transform("context", lambda v: F.get(v, F.lit(i)))
            extra[f"avg_{c}"] = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / self.length
            extra[f"top_{c}"] = F.array_max(values)
        return out.withColumns(extra).drop("context", "n_context"), list(extra)

    def fit(self, train: DataFrame) -> Fitted:
        cols = _columns(train, self.columns)
        wide, extra = self.widen(train, cols)
        inner = LogisticDetector(columns=[*cols, *extra]).fit(wide)
        return Fitted(lambda rows: inner.score(self.widen(rows, cols)[0]).select(*rows.columns, "score"), inner.details)


# ---- adaptation -----------------------------------------------------------------------------------


def domain_weights(source: DataFrame, target: DataFrame, columns: Sequence[str], bound: float = 10.0) -> DataFrame:
    """Source rows with ``extra_weight``: clipped odds of looking like the target. Target labels are not read."""
    both = source.select(*columns, F.lit(0).alias("label")).unionByName(target.select(*columns, F.lit(1).alias("label")))
    judge = LogisticDetector(columns=columns).fit(both)
    scored = judge.score(source).withColumnRenamed("score", "_p")
    odds = F.col("_p") / (1.0 - F.col("_p") + 1e-9)
    return scored.withColumn("extra_weight", F.greatest(F.least(odds, F.lit(bound)), F.lit(1.0 / bound))).drop("_p")


def adapted(detector, source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> Fitted:
    """Fit ``detector`` on the source re-weighted towards an unlabelled target."""
    return detector.fit(domain_weights(source, target.drop("label"), _columns(source, columns)))


DETECTORS = {
    "random_forest": ForestDetector,
    "logistic_regression": LogisticDetector,
    "isolation_forest": IsolationDetector,
    "ocsvm": OneClassDetector,
    "perceptron": PerceptronDetector,
    "reconstruction": ReconstructionDetector,
    "neighbours": NeighbourDetector,
    "context": ContextDetector,
}

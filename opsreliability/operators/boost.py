"""Boosted trees that stop by their validation loss.

Features are binned once: categories become their smoothed training mean, numbers are cut at training quantiles,
and a row's bins are one short byte string.  A tree is grown level by level; a pass over the rows adds up
gradients by (open node, feature, bin) inside each task, and only these sums, at most
2 ** depth * features * bins rows, reach the driver.  Of two sisters only the one with fewer rows is added up;
the other has what is left of their parent, and leaves take their values from the split that made them.
The margins of a pass are those written last plus
the few trees grown since, so the ensemble is never evaluated as a whole.  The first pass of a tree also
brings the loss of the trees before it: growing ends once ``patience`` trees have not lowered the loss
on the validation rows, and the trees up to the lowest loss remain.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreliability.session import materialise

#: Rows of the training mean that a category's own mean is drawn towards.
SMOOTH = 20
_TRAIN, _VALID = -1, -2
#: Rows that a task takes at a time.
CHUNK = 1 << 16


def walk(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Node that each row of bins ends in.  Columns of a tree: feature (-1: leaf), last bin that goes
    left, left, right, value."""
    inner = tree[:, 0] >= 0
    own = np.arange(len(tree))
    feature = np.where(inner, tree[:, 0], 0).astype(np.intp)
    cut = np.where(inner, np.floor(tree[:, 1]), 255).astype(np.int16)
    after = np.where(inner[:, None], tree[:, 2:4], own[:, None]).astype(np.intp).ravel()
    at = np.zeros(len(bins), dtype=np.intp)
    flat, start = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
    level = own[:1]
    while inner[level].any():
        at = after.take(2 * at + (flat.take(start + feature.take(at)) > cut.take(at)))
        level = np.unique(after[np.concatenate([2 * level, 2 * level + 1])])
    return at


def add_trees(trees: Sequence[np.ndarray], bins: np.ndarray) -> np.ndarray:
    return sum((t[walk(t, bins), 4] for t in trees), np.zeros(len(bins)))


@dataclass
class BoostedTrees:
    categories: list[str]
    numbers: list[str]
    encodings: dict[str, DataFrame]
    cuts: list[np.ndarray]
    prior: float
    trees: list[np.ndarray] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    @property
    def rate(self) -> float:
        return 1 / (1 + np.exp(-self.prior))

    def encoded(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns to keep and ``_f0``, ``_f1``, ...: categories as training means, then numbers, as doubles."""
        d = df.select(*keep, *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(self.categories)],
                      *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(self.numbers)])
        for i, c in enumerate(self.categories):
            table = self.encodings[c].select(F.col("key").alias(f"_c{i}"), F.col("mean").alias(f"_m{i}"))
            d = d.join(table, f"_c{i}", "left")
        values = [f"_m{i}" for i in range(len(self.categories))] + [f"_n{i}" for i in range(len(self.numbers))]
        return d.select(*keep, *[F.col(v).alias(f"_f{j}") for j, v in enumerate(values)])

    def bins(self, features) -> np.ndarray:
        """Bin numbers of rows from 1, in ascending order; 0 for what is missing or unseen."""
        x = np.array([[np.nan if v is None else v for v in row] for row in features], dtype=float)
        return self.bins_of_columns(x.reshape(-1, len(self.cuts)).T)

    def bins_of_columns(self, features: Sequence[np.ndarray]) -> np.ndarray:
        """The same from one array for each feature; what is missing is NaN."""
        out = np.empty((len(features[0]), len(self.cuts)), dtype=np.uint8)
        for j, (c, x) in enumerate(zip(self.cuts, features)):
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x))
        return out

    def predict(self, df: DataFrame, name: str = "p", keep: Sequence[str] | None = None) -> DataFrame:
        """Probability of the positive class beside the columns to keep."""
        keep = list(df.columns if keep is None else keep)
        local = BoostedTrees([], [], {}, self.cuts, self.prior, self.trees)

        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for x in parts:
                bins = local.bins_of_columns([c.to_numpy(float) for c in x])
                yield pd.Series(1 / (1 + np.exp(-(local.prior + add_trees(local.trees, bins)))))

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        columns = [f"_f{j}" for j in range(len(self.cuts))]
        d = self.encoded(df, keep)
        return d.withColumn(name, F.pandas_udf(run, "double")(*columns)).drop(*columns)

    def save(self, spark: SparkSession, path: str) -> None:
        """Tables of nodes, cuts, encodings and history under ``path``."""
        nodes = [(t, n, *map(float, row)) for t, tree in enumerate(self.trees) for n, row in enumerate(tree)]
        spark.createDataFrame(nodes, "tree int, node int, feature double, cut double, lo double, hi double, "
                                     "value double").write.parquet(f"{path}/nodes")
        spark.createDataFrame([(j, list(map(float, c))) for j, c in enumerate(self.cuts)],
                              "feature int, cuts array<double>").write.parquet(f"{path}/cuts")
        spark.createDataFrame([(self.categories, self.numbers, float(self.prior))],
                              "categories array<string>, numbers array<string>, prior double"
                              ).write.parquet(f"{path}/head")
        spark.createDataFrame(self.history, "trees int, train_loss double, valid_loss double"
                              ).write.parquet(f"{path}/history")
        for c, table in self.encodings.items():
            table.write.parquet(f"{path}/encoding_{c}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        """Nodes and cuts are bounded by the model; encodings stay tables."""
        head = spark.read.parquet(f"{path}/head").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        cuts = sorted(spark.read.parquet(f"{path}/cuts").collect())
        history = spark.read.parquet(f"{path}/history").orderBy("trees").collect()
        return cls(list(head.categories), list(head.numbers),
                   {c: spark.read.parquet(f"{path}/encoding_{c}") for c in head.categories},
                   [np.array(r.cuts) for r in cuts], head.prior,
                   [g[["feature", "cut", "lo", "hi", "value"]].to_numpy() for _, g in nodes.groupby("tree")],
                   [r.asDict() for r in history])


def run_typed(run):
    """``run`` with the annotations by which Spark knows an iterator of series."""
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


STATE = "x binary, y double, valid boolean, m double"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """``CHUNK`` rows at a time, or what is left."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(x: pa.ChunkedArray, width: int) -> np.ndarray:
    """Byte strings of equal length as rows of numbers, without a copy."""
    x = x.chunk(0)
    start = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
    return np.frombuffer(x.buffers()[2], np.uint8)[start:start + len(x) * width].reshape(-1, width)


def _sums(x: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(g, h, rows) by (slot, feature, bin).  Two features are counted at a time, by their pairs of bins."""
    out = np.zeros((3, slots, x.shape[1], bins))
    columns, base = np.ascontiguousarray(x.T), slot * (bins * bins)
    for f in range(0, x.shape[1], 2):
        other = columns[f + 1] if f + 1 < x.shape[1] else 0
        cell = base + columns[f].astype(np.intp) * bins + other
        for i, v in enumerate((g, h, None)):
            both = np.bincount(cell, weights=v, minlength=slots * bins * bins).reshape(slots, bins, bins)
            out[i, :, f] = both.sum(axis=2)
            if f + 1 < x.shape[1]:
                out[i, :, f + 1] = both.sum(axis=1)
    return out


def _passed(state: DataFrame, recent: list[np.ndarray], tree: np.ndarray | None, nodes: list[int],
            width: int, bins: int, weight: float) -> dict[int, tuple[float, float, float]]:
    """Sums (gradient, hessian, rows) by cell of these nodes, and the losses where no tree is begun yet."""
    place = np.full(1 if tree is None else len(tree), -1)
    place[nodes] = range(len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(nodes), width, bins))
        loss = {_TRAIN: np.zeros(3), _VALID: np.zeros(3)}
        for b in _chunks(batches):
            x, y, m = _matrix(b["x"], width), b["y"].to_numpy(), b["m"].to_numpy()
            valid = b["valid"].to_numpy()
            if tree is None:
                m, w = m + add_trees(recent, x), np.where(y == 1, weight, 1.0)
                each = w * np.logaddexp(0, np.where(y > 0, -m, m))
                for kind, rows in ((_TRAIN, ~valid), (_VALID, valid)):
                    loss[kind] += [each[rows].sum(), w[rows].sum(), rows.sum()]
                live, slot = np.flatnonzero(~valid), np.zeros(len(x), np.intp)
                m = m[live]
            else:
                slot = place[walk(tree, x)]
                live = np.flatnonzero(~valid & (slot >= 0))
                m = m[live] + add_trees(recent, x[live])
            y, p = y[live], 1 / (1 + np.exp(-m))
            w = np.where(y == 1, weight, 1.0)
            sums += _sums(x[live], slot[live], w * (y - p), w * p * (1 - p), len(nodes), bins)
        sums = sums.reshape(3, -1)
        cells = np.flatnonzero(sums[2])
        found = [sums[i, cells] for i in range(3)]
        if tree is None:
            cells = np.concatenate([cells, list(loss)])
            found = [np.concatenate([v, [x[i] for x in loss.values()]]) for i, v in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *map(pa.array, found)], ["cell", "g", "h", "n"])

    total = (state.mapInArrow(run, "cell int, g double, h double, n double")
             .groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]))
    return {r["cell"]: (r["g"], r["h"], r["n"]) for r in total.collect()}


def _tables(got: dict, nodes: int, width: int, bins: int) -> np.ndarray:
    """What ``_passed`` found, by (node, kind, feature, bin)."""
    out = np.zeros((3, nodes * width * bins))
    cells = [c for c in got if c >= 0]
    if cells:
        out[:, cells] = np.array([got[c] for c in cells]).T
    return out.reshape(3, nodes, width, bins).swapaxes(0, 1)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, min_rows: int,
               l2: float) -> tuple[float, int, int] | None:
    """(gain, feature, last bin that goes left) of sums by (feature, bin); None if nothing is gained."""
    left = [np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n)]
    whole = [a[0].sum() for a in (g, h, n)]
    right = [t - a for t, a in zip(whole, left)]
    worth = lambda a, b: a * a / (b + l2)
    gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(whole[0], whole[1])
    gain[(left[2] < min_rows) | (right[2] < min_rows)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-9 else None


def _grown(state: DataFrame, recent: list[np.ndarray], first: dict, width: int, bins: int, depth: int,
           min_rows: int, step: float, l2: float, weight: float) -> np.ndarray:
    """One tree; ``first`` has the sums of its root."""
    root = _tables(first, 1, width, bins)[0]
    leaf = lambda g, h: [-1, 0, -1, -1, step * g / (h + l2)]
    tree, level = [leaf(*root[:2, 0].sum(axis=1))], {0: root}
    for d in range(depth):
        pairs = []
        for node, cells in level.items():
            split = best_split(*cells, min_rows, l2)
            if split:
                _, f, b = split
                left, right = cells[:, f, :b + 1].sum(axis=1), cells[:, f, b + 1:].sum(axis=1)
                tree[node][:4] = [f, b, len(tree), len(tree) + 1]
                if max(left[2], right[2]) >= 2 * min_rows:  # else neither can be split
                    pairs.append((len(tree) + (left[2] > right[2]), len(tree) + (left[2] <= right[2]), cells))
                tree += [leaf(*left[:2]), leaf(*right[:2])]
        if not pairs or d + 1 == depth:
            break
        small = [p[0] for p in pairs]
        got = _tables(_passed(state, recent, np.array(tree, dtype=float), small, width, bins, weight), len(small),
                      width, bins)
        level = {}
        for (few, many, parent), cells in zip(pairs, got):
            rest = parent - cells
            rest[:2, rest[2] <= 0] = 0
            rest[1] = np.maximum(rest[1], 0)
            level |= {few: cells, many: rest}
        level = dict(sorted(level.items()))
    return np.array(tree, dtype=float)


def fit_stopped(train: DataFrame, valid: DataFrame, categories: Sequence[str], numbers: Sequence[str],
                label: str, max_trees: int = 400, patience: int = 10, depth: int = 5, step: float = 0.1,
                min_rows: int = 20, weight: float = 1.0, l2: float = 1.0, bins: int = 64,
                rewrite: int = 8) -> BoostedTrees:
    """Trees up to the lowest validation loss; ``max_trees`` is a bound that the loss should never let it reach.

    Rows without a label take no part.  ``weight`` is the weight of positive rows.  Missing numbers and unseen
    categories have a bin of their own, below all others.  Without validation rows all ``max_trees`` are grown.
    ``rewrite`` trees are evaluated at most beside the margins written last.
    """
    train, valid = (d.where(F.col(label).isNotNull()) for d in (train, valid))
    weigh = F.when(F.col(label) == 1, float(weight)).otherwise(1.0)
    mean = train.agg((F.sum(F.col(label) * weigh) / F.sum(weigh)).alias("m")).first()["m"]
    mean = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
    encodings = {}
    for c in categories:
        one = train.groupBy(F.col(c).cast("string").alias("key")).agg(
            ((F.sum(F.col(label).cast("double")) + SMOOTH * mean) / (F.count("*") + SMOOTH)).alias("mean"))
        encodings[c] = materialise(one.where("key IS NOT NULL"), f"boost-{c}")
    width = len(categories) + len(numbers)
    model = BoostedTrees(list(categories), list(numbers), encodings, [np.zeros(0)] * width,
                         float(np.log(mean / (1 - mean))))
    flat = model.encoded(train, [])
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    model.cuts = [np.unique(c) for c in flat.approxQuantile(flat.columns, shares, 0.002)]
    local = BoostedTrees([], [], {}, model.cuts, model.prior)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = local.bins_of_columns([b[f"_f{j}"].to_numpy(zero_copy_only=False).astype(float) for j in range(width)])
            rows = pa.py_buffer(x.tobytes())
            ends = pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(x), [None, ends, rows]), b["_y"], b["_valid"],
                 pa.array(np.full(len(x), local.prior))], ["x", "y", "valid", "m"])

    rows = (train.select("*", F.lit(False).alias("_valid")).select(label, "_valid", *categories, *numbers)
            .unionByName(valid.select("*", F.lit(True).alias("_valid")).select(label, "_valid", *categories, *numbers)))
    rows = model.encoded(rows.withColumn("_y", F.col(label).cast("double")), ["_y", "_valid"])
    state = materialise(rows.mapInArrow(binned, STATE), "boost-rows")

    def moved(trees: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _chunks(batches):
                m = b["m"].to_numpy() + add_trees(trees, _matrix(b["x"], width))
                yield from b.set_column(b.schema.get_field_index("m"), "m", pa.array(m)).to_batches()
        return run

    recent: list[np.ndarray] = []
    best, best_loss = 0, np.inf
    while True:
        first = _passed(state, recent, None, [0], width, bins, float(weight))
        per_row = {k: first[k][0] / first[k][1] if first.get(k, (0, 0))[1] else float("nan") for k in (_TRAIN, _VALID)}
        model.history.append({"trees": len(model.trees), "train_loss": float(per_row[_TRAIN]),
                              "valid_loss": float(per_row[_VALID])})
        if per_row[_VALID] < best_loss:
            best, best_loss = len(model.trees), per_row[_VALID]
        if len(model.trees) >= max_trees or (best_loss < np.inf and len(model.trees) - best >= patience):
            break
        tree = _grown(state, recent, first, width, bins, depth, min_rows, step, l2, float(weight))
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) >= rewrite:
            state = materialise(state.mapInArrow(moved(recent), STATE), "boost-rows")
            recent = []
    if best_loss < np.inf:
        model.trees = model.trees[:best]
    return model


def loss_curve(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """Loss by number of trees."""
    return spark.createDataFrame(model.history, "trees int, train_loss double, valid_loss double")

"""Boosted regression trees of several expanding training windows, grown together.

A backtest fits one model per origin, and their training rows overlap almost wholly.  Here a row is stored
once with the windows it serves: window k trains on it from ``first`` on and validates on it from ``seen`` to
``first`` - 1.  A pass over the rows adds up residuals by (window, open node, feature, bin) for all windows at
once, and only these sums, at most windows * 2 ** depth * features * bins rows, reach the driver.  A
window stops growing once ``patience`` trees have not lowered the squared error on the days it holds out,
and keeps the trees up to the lowest.  Residuals are added up as integers, so the sums do not depend on how
the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreliability.operators.boost import BoostedTrees, add_trees, best_split, run_typed, walk
from opsreliability.session import materialise

#: Steps that one unit of the largest residual is divided into.
UNITS = 2.0 ** 30


@dataclass
class WindowModels:
    features: list[str]
    ends: list[date]
    cuts: list[np.ndarray]
    trees: list[list[np.ndarray]]     # by window
    history: list[list[float]]        # by window: held-out squared error by number of trees
    train_ends: list[date]            # by window: last day that its trees see

    def predict(self, df: DataFrame, end: str, name: str) -> DataFrame:
        """``df`` with the prediction of the window that ends on the day in column ``end``; NULL for other days."""
        local, trees, bins = list(self.trees), self.trees, BoostedTrees([], [], {}, self.cuts, 0.0)

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, window in parts:
                b, k, out = bins.bins(x), window.to_numpy(), np.full(len(x), np.nan)
                for w in np.unique(k[k >= 0]):
                    out[k == w] = add_trees(local[w], b[k == w])
                yield pd.Series(out)

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        window = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in self.ends]), F.col(end)), F.lit(0)) - 1
        score = F.pandas_udf(run, "double")(_array(self.features), window.cast("int"))
        return df.withColumn(name, F.nanvl(score, F.lit(None).cast("double")))


def _array(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


def _sums(state: DataFrame, recent: dict[int, list], growing: dict[int, tuple], width: int, bins: int,
          scale: float) -> tuple[dict[int, np.ndarray], dict[int, tuple[float, int]]]:
    """By window: sums (residual, rows) by (open node, feature, bin), and held-out error where no tree is begun."""
    start, total = {}, 0
    for k, (_, nodes) in growing.items():
        start[k] = total
        total += len(nodes) * width * bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, total), dtype=np.int64)
        held = {k: [0.0, 0] for k in growing}
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b.x), dtype=np.uint8).reshape(-1, width)
            m = np.frombuffer(b"".join(b.m), dtype=np.float64).reshape(len(x), -1)
            y, seen, first = b.y.to_numpy(), b.seen.to_numpy(), b["first"].to_numpy()
            for k, (tree, nodes) in growing.items():
                if tree is None:
                    v = (seen <= k) & (first > k)
                    e = y[v] - m[v, k] - add_trees(recent[k], x[v])
                    held[k] = [held[k][0] + int(np.rint(e * e * scale).sum()), held[k][1] + len(e)]
                t = np.flatnonzero(first <= k)
                place = np.full(1 if tree is None else len(tree), -1)
                place[nodes] = np.arange(len(nodes))
                slot = place[np.zeros(len(t), np.int64) if tree is None else walk(tree, x[t])]
                t, slot = t[slot >= 0], slot[slot >= 0]
                if not len(t):
                    continue
                e = np.rint((y[t] - m[t, k] - add_trees(recent[k], x[t])) * scale).astype(np.int64)
                cell = start[k] + (slot[:, None] * width + np.arange(width)) * bins + x[t]
                np.add.at(sums[0], cell, e[:, None])
                sums[1] += np.bincount(cell.ravel(), minlength=total)
        cells = np.flatnonzero(sums[1])
        rows = pd.DataFrame({"cell": cells, "r": sums[0, cells], "n": sums[1, cells]})
        loss = pd.DataFrame([(-1 - k, int(v[0]), int(v[1])) for k, v in held.items()], columns=["cell", "r", "n"])
        yield pd.concat([rows, loss]).astype("int64")

    got = (state.mapInPandas(run, "cell long, r long, n long").groupBy("cell")
           .agg(F.sum("r").alias("r"), F.sum("n").alias("n")).toArrow())
    cell, r, n = (got.column(c).to_numpy() for c in ("cell", "r", "n"))
    flat = np.zeros((2, total))
    flat[0, cell[cell >= 0]] = r[cell >= 0] / scale
    flat[1, cell[cell >= 0]] = n[cell >= 0]
    loss = {int(-1 - c): (a / scale, int(b)) for c, a, b in zip(cell, r, n) if c < 0}
    out = {}
    for k, (_, nodes) in growing.items():
        size = len(nodes) * width * bins
        out[k] = flat[:, start[k]:start[k] + size].reshape(2, len(nodes), width, bins)
    return out, loss


def _split_level(tree: list, nodes: list[int], sums: np.ndarray, min_rows: int, step: float, l2: float) -> list[int]:
    """Split the open nodes of a level in place; the new nodes."""
    following = []
    for node, (r, n) in zip(nodes, sums.transpose(1, 0, 2, 3)):
        tree[node][4] = step * r[0].sum() / max(n[0].sum() + l2, 1e-12)
        split = best_split(r, n, n, min_rows, l2)
        if split:
            _, f, b = split
            left, rows = r[f, :b + 1].sum(), n[f, :b + 1].sum()
            right, others = r[f].sum() - left, n[f].sum() - rows
            tree[node][:4] = [f, b, len(tree), len(tree) + 1]
            following += [len(tree), len(tree) + 1]
            tree += [[-1, 0, -1, -1, step * left / (rows + l2)], [-1, 0, -1, -1, step * right / (others + l2)]]
    return following


def window_cuts(rows: DataFrame, features: Sequence[str], bins: int = 64) -> list[np.ndarray]:
    """Bin edges: approximate quantiles of the training rows."""
    flat = rows.select(*[F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(features)])
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    return [np.unique(c) for c in flat.approxQuantile(flat.columns, shares, 0.002)]


def fit_windows(rows: DataFrame, features: Sequence[str], label: str, day: str, ends: Sequence[date],
                hold: int = 28, max_trees: int = 300, patience: int = 10, depth: int = 4, step: float = 0.1,
                min_rows: int = 10, l2: float = 1.0, bins: int = 64, rewrite: int = 4,
                cuts: list[np.ndarray] | None = None) -> WindowModels:
    """One model for each day in ``ends``, from the rows up to that day.

    The ``hold`` days up to the last row of a window tell when to stop; the trees see the days before.  Rows
    without a label take no part.  Missing features have a bin of their own, below all others.  Bin edges come from
    the rows that the first window trains on, so no model has seen later days.  A window without training rows
    predicts 0.
    """
    ends, width = sorted(ends), len(features)
    rows = rows.where(F.col(label).isNotNull() & F.col(day).isNotNull() & (F.col(day) <= F.lit(ends[-1])))
    lasts = rows.agg(*[F.max(F.when(F.col(day) <= F.lit(e), F.col(day))).alias(f"d{k}") for k, e in enumerate(ends)])
    train_ends = [(d or e) - timedelta(days=hold) for d, e in zip(lasts.first(), ends)]
    cuts = cuts or window_cuts(rows.where(F.col(day) <= F.lit(train_ends[0])), features, bins)
    coder = BoostedTrees([], [], {}, cuts, 0.0)

    def binned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([r.tobytes() for r in coder.bins(x)], dtype=object)

    later = lambda days: F.size(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: d < F.col(day)))
    state = materialise(rows.select(
        F.pandas_udf(run_typed(binned), "binary")(_array(features)).alias("x"),
        F.col(label).cast("double").alias("y"), later(ends).alias("seen"),
        later(train_ends).alias("first"),
        F.lit(np.zeros(len(ends)).tobytes()).alias("m")), "window-rows")
    largest = state.agg(F.max(F.abs("y")).alias("v")).first()["v"] or 1.0
    # a power of two; large residuals are squared as well
    scale = UNITS / 2.0 ** np.ceil(np.log2(max(largest, 1.0) * max(largest, 1.0)))

    def moved(new: dict[int, list]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.frombuffer(b"".join(b.x), dtype=np.uint8).reshape(-1, width)
                    m = np.frombuffer(b"".join(b.m), dtype=np.float64).reshape(len(x), -1).copy()
                    for k, trees in new.items():
                        m[:, k] += add_trees(trees, x)
                    yield b.assign(m=[r.tobytes() for r in m])
        return run

    models = WindowModels(list(features), ends, cuts, [[] for _ in ends], [[] for _ in ends], train_ends)
    best = [(0, np.inf)] * len(ends)
    recent: dict[int, list] = {k: [] for k in range(len(ends))}
    growing = set(recent)
    while growing:
        got, held = _sums(state, recent, {k: (None, [0]) for k in sorted(growing)}, width, len_bins(cuts), scale)
        for k in sorted(growing):
            error, n = held.get(k, (0.0, 0))
            models.history[k].append(float(error / n) if n else float("nan"))
            if n and error / n < best[k][1]:
                best[k] = (len(models.trees[k]), error / n)
            waited = best[k][1] < np.inf and len(models.trees[k]) - best[k][0] >= patience
            if waited or len(models.trees[k]) >= max_trees or not got[k][1].any():
                growing.discard(k)
        trees = {k: [[-1, 0, -1, -1, 0.0]] for k in sorted(growing)}
        level = {k: [0] for k in trees}
        for d in range(depth):
            if d:
                got, _ = _sums(state, recent, {k: (np.array(trees[k]), level[k]) for k in level}, width,
                               len_bins(cuts), scale)
            level = {k: _split_level(trees[k], level[k], got[k], min_rows, step, l2) for k in level}
            level = {k: v for k, v in level.items() if v}
            if not level:
                break
        for k, tree in trees.items():
            models.trees[k].append(np.array(tree, dtype=float))
            recent[k].append(models.trees[k][-1])
        if growing and max(len(v) for v in recent.values()) >= rewrite:
            state = materialise(state.mapInPandas(moved({k: recent[k] for k in growing}), state.schema), "window-rows")
            recent = {k: [] for k in recent}
    for k, (n, error) in enumerate(best):
        if error < np.inf:
            models.trees[k] = models.trees[k][:n]
    return models


def len_bins(cuts: Sequence[np.ndarray]) -> int:
    """Bins of the feature with most: one for missing values and one more than edges."""
    return max((len(c) for c in cuts), default=0) + 2

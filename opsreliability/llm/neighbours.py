"""Nearest vectors by cosine from randomly rotated one-bit codes.

* **Codes.**  Vectors are brought to length one, moved by the mean direction of the table and turned by
  one seeded random rotation.  A vector o then keeps the signs of its D coordinates, packed into 64-bit words, the
  length of what was turned, and the inner product f of its direction with its own sign vector (scaled to
  length one): the two correction scalars.
* **Estimates.**  A query, turned alike, is rounded to ``PLANES`` bit planes.  Its inner product with a sign
  vector is a weighted sum of popcounts of (code AND plane); divided by f it is an unbiased estimate of the
  inner product of the directions.  By the concentration of random rotations the estimate is off by less
  than ``sqrt((1 - f^2) / f^2) * EPSILON / sqrt(D - 1)``, but for about one estimate in ten thousand.
* **Reranking.**  The codes of a block are estimated for a block of queries; the exact scores of the best
  estimates give each query a lower bound of its k-th score, and every vector whose upper bound reaches it
  is scored exactly, in double precision, from the original vector.  Bounds go on from block to block, so
  that later blocks score less.

Queries come in blocks of at most ``query_block`` rows, one broadcast each (``query_block`` x D x 8
bytes); the index, partitioned in files, is scanned once a block.  A task hands on its k best of
each query, and a grouping over queries picks the last k.  The number of scanning tasks is that of the
session's cores, so what is handed on grows with the queries alone.  Nothing is capped: all vectors are
coded, estimated, and scored if their bound asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsreliability.session import materialise

PLANES = 6
EPSILON = 3.5
#: Vectors of one block of codes: with a slice of queries they bound the memory of a task.
CODES = 4096
QUERIES = 128
QUERY_BLOCK = 16_384


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of ``width`` doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two: no square over- or underflows, and no quotient of products changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    x = scaled(x)
    return x / lengths(x)[:, None]


def encode(units: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, f) of rows of length one."""
    moved = (units - mean) @ turn
    size = np.sqrt((moved * moved).sum(1))
    f = np.abs(moved).sum(1) / np.maximum(size, 1e-300) / np.sqrt(moved.shape[1])
    bits = np.packbits(moved > 0, axis=1, bitorder="little")
    words = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, :bits.shape[1]] = bits
    return words.view("<u8"), size, np.maximum(f, 1e-12)


def planes_of(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word) of rows of floats, and the low end and step of each row."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    bits = np.stack([np.packbits(level >> j & 1, axis=1, bitorder="little") for j in range(PLANES)], axis=1)
    words = np.zeros((*bits.shape[:2], -(-bits.shape[2] // 8) * 8), dtype=np.uint8)
    words[:, :, :bits.shape[2]] = bits
    return words.view("<u8"), low, step


def estimates(codes: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray,
              width: int) -> np.ndarray:
    """Inner products of queries with sign vectors of length one, from packed bits: (query, vector)."""
    ones = np.bitwise_count(codes).sum(1, dtype=np.float64)
    dot = np.zeros((len(planes), len(codes)))
    for j in range(PLANES):
        for w in range(codes.shape[1]):
            dot += (1 << j) * np.bitwise_count(planes[:, j, w, None] & codes[None, :, w]).astype(np.float64)
    # sum over set signs of the query's coordinates, twice, less the sum of all of them
    level_sum = sum((1 << j) * np.bitwise_count(planes[:, j]).sum(1, dtype=np.float64) for j in range(PLANES))
    inside = low[:, None] * ones + step[:, None] * dot
    return (2 * inside - (low * width + step * level_sum)[:, None]) / np.sqrt(width)


class Best:
    """The k best (score, id, row) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, q: int, found: list[tuple]) -> None:
        """``found``: (-score, id, row)."""
        best = sorted([*self.rows[q], *found])[:self.k]
        self.rows[q] = best
        if len(best) == self.k:
            self.floor[q] = -best[-1][0]


def search_block(best: Best, asked: dict, ids, rows, vectors: np.ndarray, index: tuple, width: int) -> None:
    """Estimate one block of codes for all queries; score what the bounds leave."""
    codes, size, f = index
    exact = scaled(vectors)
    long = lengths(exact)
    spread = np.sqrt(np.maximum(1 - f * f, 0)) / f * EPSILON / np.sqrt(max(width - 1, 1))

    def scores(q: int, at: np.ndarray) -> np.ndarray:
        return (exact[at] * asked["exact"][q]).sum(1) / (long[at] * asked["long"][q])

    for start in range(0, len(asked["row"]), QUERIES):
        part = slice(start, start + QUERIES)
        est = estimates(codes, asked["planes"][part], asked["low"][part], asked["step"][part], width) / f
        # <q, o> = <q, mean> + |o'| <q, o' / |o'|>, as q has length one
        middle = asked["shift"][part][:, None] + size * est
        # rounding moves a coordinate of the query by half a step at most
        slack = size * (spread + asked["step"][part][:, None] * 0.5 * np.sqrt(width) / f)
        for i in range(len(est)):
            q = start + i
            other = rows != asked["row"][q]
            if len(best.rows[q]) < best.k and other.sum() > best.k:
                # a first bound, from the best estimates
                first = np.argpartition(-middle[i], best.k)[:best.k + 1]
                floor = np.sort(scores(q, first[other[first]]))[-best.k]
            else:
                floor = best.floor[q]
            take = np.flatnonzero((middle[i] + slack[i] >= floor) & other)
            found = scores(q, take)
            near = found >= floor
            take, found = take[near], found[near]
            if len(take) > best.k:  # ties included: those that can be among the k best
                order = np.lexsort((rows[take], ids[take], -found))[:best.k]
                take, found = take[order], found[order]
            best.add(q, [(-s, int(ids[t]), int(rows[t])) for t, s in zip(take, found)])


#: Stands for a null id inside a task; null ids come after all others.
NO_ID = (1 << 63) - 1


def _usable_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; floats stay floats."""
    kind = table.schema[vector_col].dataType.simpleString()
    v = table[vector_col] if kind == "array<float>" else table[vector_col].cast("array<double>")
    return table.select(table[id_col].cast("long").alias("id"), v.alias("v")).filter(usable(F.col("v")))


def mean_direction(rows: DataFrame, width: int) -> np.ndarray:
    """Mean of all vectors at length one: one list of sums a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(width), 0
        for b in batches:
            if len(b):
                total += unit(_matrix(b.v, width)).sum(0)
                n += len(b)
        yield pd.DataFrame({"at": np.arange(width + 1), "x": [*total, float(n)]})

    sums = rows.select("v").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    got = {r["at"]: r["x"] for r in sums.collect()}
    return np.array([got.get(i, 0.0) for i in range(width)]) / max(got.get(width, 0.0), 1.0)


def build_index(rows: DataFrame, width: int, mean: np.ndarray, seed: int) -> DataFrame:
    """(row, id, v, code, size, f) of every row, numbered and written to the shared folder."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(width, seed)
        for b in batches:
            if len(b):
                code, size, f = encode(unit(_matrix(b.v, width)), mean, turn)
                yield b.assign(id=b.id.astype("Int64"), code=list(code.view("<i8")), size=size, f=f)

    coded = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        run, f"id long, v {kind}, row long, code array<long>, size double, f double")
    return materialise(coded, "neighbour-index")


def _prepared(vectors: list, numbers: np.ndarray, width: int, mean: np.ndarray, seed: int) -> dict:
    exact = scaled(_matrix(vectors, width))
    me = unit(exact)
    planes, low, step = planes_of(me @ rotation(width, seed))
    return {"row": numbers, "exact": exact, "long": lengths(exact), "planes": planes, "low": low, "step": step,
            "shift": me @ mean}


def nearest(table: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            seed: int = 42, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the k nearest rows of each query row, itself left out.

    ``queries`` is a condition on the column ``id``.  Nearness is the cosine in double precision; ties go to the
    smaller id, null ids last, then to the smaller row number.  Vectors that are null, empty or zero, or hold null or
    non-finite components, take no part.  A vector shorter than the longest counts as ending in zeros.
    Rows may repeat ids and vectors: each row is a candidate, and each row that meets the condition a
    query.  With fewer than k candidates all are returned; a table without usable rows gives no rows.
    Other columns are not looked at.
    """
    rows = _usable_rows(table, id_col, vector_col)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    mean = mean_direction(rows, width)
    index = build_index(rows, width, mean, seed)
    asked = index.filter(queries).select("row", "id", "v")
    blocks = -(-asked.count() // query_block)
    # ranges of row numbers, so that a block holds query_block rows or a few more
    cuts = asked.approxQuantile("row", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    edges = [None, *sorted(set(map(int, cuts))), None]
    out = None
    for low, high in zip(edges, edges[1:]):
        part = asked
        part = part if low is None else part.filter(F.col("row") > low)
        part = part if high is None else part.filter(F.col("row") <= high)
        found = materialise(_scan(index, part.toPandas(), width, mean, seed, k), "neighbour-found")
        out = found if out is None else out.unionByName(found)
    last = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    named = out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return named.select("query_row", "query_id", "rank", "vec_id", "score")


def _scan(index: DataFrame, block: pd.DataFrame, width: int, mean: np.ndarray, seed: int, k: int) -> DataFrame:
    """The k best of each query of a block that each task of the index finds."""
    context = index.sparkSession.sparkContext
    sent = context.broadcast((block.v.map(np.asarray).tolist(), block.row.to_numpy(), block.id.to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, numbers, names = sent.value
        if not len(numbers):
            return
        asked = _prepared(vectors, numbers, width, mean, seed)
        best = Best(len(numbers), k)
        for b in batches:
            for at in range(0, len(b), CODES):
                c = b.iloc[at:at + CODES]
                ids = c.id.astype("Int64").fillna(NO_ID).to_numpy(np.int64)
                code = np.stack(c.code.to_list()).view("<u8")
                search_block(best, asked, ids, c.row.to_numpy(), _matrix(c.v, width),
                             (code, c["size"].to_numpy(), c.f.to_numpy()), width)
        rows = [(numbers[q], names[q], None if i == NO_ID else i, -s, row)
                for q, found in enumerate(best.rows) for s, i, row in found]
        out = pd.DataFrame(rows, columns=["query_row", "query_id", "vec_id", "score", "row"])
        yield out.astype({"vec_id": "Int64"})

    return index.coalesce(max(1, context.defaultParallelism)).mapInPandas(
        run, "query_row long, query_id long, vec_id long, score double, row long")

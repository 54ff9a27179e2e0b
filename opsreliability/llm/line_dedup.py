"""Exact line deduplication over levelled sorted runs of line hashes.

``LineRuns`` holds the 128-bit hashes of all lines seen so far as sorted Parquet runs.  A batch of
documents is merge-joined against the runs: what they hold is not new, the rest is owned by the
smallest document of the batch and becomes a run of level 0.  Whenever a level has ``fanout`` runs
they are merged into one run of the next level, so n batches leave about fanout * log(n) runs and
a hash is rewritten log(n) times.  Texts never enter a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from opsreliability.llm.common import LAST_ID, SPACES, ascii_lower, narrow
from opsreliability.session import materialise, shared_folder

#: Shortest key, in code points, that counts as a repeated line.
MIN_KEY = 10


def line_hashes(d: DataFrame, min_key: int) -> DataFrame:
    """(k1, k2, owner, at, h1, h2): place and hash of every line with a long enough key."""
    lines = d.select("k1", "k2", F.coalesce("doc_id", F.lit(LAST_ID)).alias("owner"),
                     F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keys = lines.select("k1", "k2", "owner", "at",
                        ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    return keys.filter(F.length("key") >= min_key).select(
        "k1", "k2", "owner", "at", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _write(self, level: int, rows: DataFrame) -> None:
        path = shared_folder(self.spark, f"line-run-{level}")
        (rows.select("h1", "h2").repartitionByRange("h1").sortWithinPartitions("h1", "h2")
         .write.option("compression", "zstd").parquet(path))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def seen(self) -> DataFrame | None:
        """All hashes of all runs; each hash is in one run only."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, new: DataFrame) -> None:
        """Add hashes that no run holds; compact the levels that are full."""
        self._write(0, new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(level + 1, self.spark.read.parquet(*full))
            level += 1

    def admit(self, lines: DataFrame) -> DataFrame:
        """(k1, k2, at) of the lines to drop; the batch's own hashes join the runs.

        ``lines`` must be written already.  A hash that a run holds loses all its lines; one that
        is new keeps them in the smallest document of the batch.
        """
        firsts = lines.groupBy("h1", "h2").agg(F.min("owner").alias("first"),
                                               F.max("owner").alias("last"))
        seen = self.seen()
        if seen is None:
            known = firsts.withColumn("old", F.lit(False))
        else:
            known = firsts.join(seen.withColumn("old", F.lit(True)), ["h1", "h2"], "left")
        known = materialise(known.withColumn("old", F.coalesce("old", F.lit(False))), "line-batch")
        self.add(known.filter("not old"))
        repeated = known.filter("old or first < last")
        return (lines.join(repeated, ["h1", "h2"]).filter("old or owner > first")
                .select("k1", "k2", "at"))


def _kept(text: str | None, drop) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if drop is None or not len(drop):
        return text or "", len(lines), 0
    gone = set(drop.tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_key: int = MIN_KEY, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(k1, k2, drop): the places of the lines that each row loses.

    Batches are ranges of ids in ascending order (split at approximate quantiles, equal ids
    together), so the smallest document of a line is always in the first batch that has it.  Rows
    without an id have no part in the quantiles; they are in the last batch.
    """
    lines = materialise(line_hashes(narrow(docs, id_col, text_col), min_key), "line-hashes")
    named = lines.filter(F.col("owner") < LAST_ID)
    cuts = named.approxQuantile("owner", [i / batches for i in range(1, batches)], 0.01)
    # quantiles are doubles: of ids near the largest long they may lie beyond it
    edges = [None, *sorted({min(int(c), LAST_ID - 1) for c in cuts}), None]
    runs, drops = LineRuns(docs.sparkSession, fanout), None
    for low, high in zip(edges, edges[1:]):
        part = lines
        if low is not None:
            part = part.filter(F.col("owner") > low)
        if high is not None:
            part = part.filter(F.col("owner") <= high)
        found = runs.admit(part)
        drops = found if drops is None else drops.unionByName(found)
    # one list per row of docs, as long as its own lines at most
    return drops.groupBy("k1", "k2").agg(F.collect_set("at").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_key: int = MIN_KEY, batches: int = 3, fanout: int = 2,
                with_text: bool = True) -> DataFrame:
    """Per row: k1, k2, doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys of
    ``min_key`` code points or more lose all their lines but those of the smallest doc_id that
    holds them.  A null or empty text is one empty line.  Rows of one id are one document; rows
    without an id are one document after all others.  Repeated rows stay repeated.
    """
    drops = dropped_lines(docs, id_col, text_col, min_key, batches, fanout)
    texts = narrow(docs, id_col, text_col).join(drops, ["k1", "k2"], "left")
    fields = "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text

    @F.pandas_udf(fields)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            rows = [_kept(t, g) for t, g in zip(texts, gone)]
            out = {"n_lines": [r[1] for r in rows], "n_dropped": [r[2] for r in rows],
                   "kept_sha256": [hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).hexdigest()
                                   for r in rows]}
            yield pd.DataFrame(out | ({"kept_text": [r[0] for r in rows]} if with_text else {}))

    return texts.select("k1", "k2", "doc_id", cut("text", "drop").alias("r")).select(
        "k1", "k2", "doc_id", "r.*")


def replace_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the kept lines as text (null texts become empty) and the length adjusted."""
    drops = dropped_lines(docs, id_col, text_col)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                       docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    keyed = rows.select("row", "t", F.xxhash64("i", "t").alias("k1"),
                        F.xxhash64(F.lit(7), "t", "i").alias("k2"))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in batches:
            yield pd.Series([_kept(t, g)[0] for t, g in zip(texts, gone)], dtype=object)

    out = keyed.join(drops, ["k1", "k2"], "left").select("row", cut("t", "drop").alias("kept"))
    return out.select(*[F.col("kept").alias(c) if c == text_col else
                        F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == chars_col
                        else F.col("row")[c].alias(c) for c in names])

"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Items are normalised to words (A-Z lower-cased; letters, digits and all characters outside ASCII)
and cut into windows of ``window`` consecutive words.  One automaton over all windows scans each
normalised text once.  Places found are mapped back to words and, for spans, to code points of the
original text.

The windows are sent to the executors in blocks of at most ``block_bytes`` of item text, each an
automaton of its own; a benchmark within the bound, as they all are in practice, is one block and
texts are scanned once.  A larger one costs one more scan for each further block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opsreliability.llm.common import narrow
from opsreliability.session import materialise

#: Upper bound of item text in one automaton (about 60 times as much memory on an executor).
BLOCK_BYTES = 4 << 20
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes to normalised bytes: A-Z lower-cased, everything that is in no word to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32
               for c in range(256))
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def item_windows(words: list[bytes], window: int) -> Iterator[bytes]:
    """Windows of one item; an item of fewer words, but not none, is one window."""
    for i in range(max(1, len(words) - window + 1) if words else 0):
        yield b" ".join(words[i:i + window])


def _automaton(key: str, items: list[tuple[int, str]], window: int) -> ahocorasick.Automaton:
    """Built once in each Python worker.  Values: (words in the window, items that have it)."""
    if key not in _AUTOMATA:
        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in item_windows(normal_words(text), window):
                owners.setdefault(w, set()).add(item)
        a = ahocorasick.Automaton()
        for w, ids in owners.items():
            a.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", (w.count(b" ") + 1, sorted(ids, key=str)))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def scan(a: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, set]:
    """Flags of the words inside any window found, and the items whose windows occur."""
    flags, items = np.zeros(len(words), dtype=bool), set()
    if not words or not len(a):
        return flags, items
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts = None
    for end, (n, ids) in a.iter(flat):
        if starts is None:  # place of the space after each word
            starts = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4") == 32)[1:]
        last = int(np.searchsorted(starts, end))
        flags[last - n + 1:last + 1] = True
        items.update(ids)
    return flags, items


def char_spans(text: str, flags: np.ndarray) -> list[list[int]]:
    """Runs of flagged words as [start, end) in code points of the original text."""
    out: list[list[int]] = []
    prev = False
    for hit, m in zip(flags, WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))):
        if hit and out and prev:
            out[-1][1] = m.end()
        elif hit:
            out.append([m.start(), m.end()])
        prev = hit
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text) of bounded size, read one after the other."""
    block, held = [], 0
    rows = items.select(items[item_col].cast("string"), items[text_col].cast("string"))
    for item, text in rows.toLocalIterator():
        if not text or item is None:
            continue
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


def _scanner(sent, key: str, window: int):
    @F.pandas_udf("n_words long, n_hit long, spans array<array<int>>, items array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = _automaton(key, sent.value, window)
        for texts in batches:
            rows = []
            for t in texts:
                words = normal_words(t)
                flags, found = scan(a, words)
                spans = char_spans(t, flags) if found else []
                rows.append((len(words), int(flags.sum()), spans, sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    return run


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: k1, k2, doc_id, n_words, n_hit, spans (array of [start, end) in code points of the
    text), items (ids as strings, sorted).

    Null and empty texts have no words; an item without words or id has no window; an empty
    benchmark hits nothing.  Repeated rows stay repeated.
    """
    spark = docs.sparkSession
    d = narrow(docs, id_col, text_col)
    parts = []
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        run = _scanner(spark.sparkContext.broadcast(block), uuid.uuid4().hex, window)

        parts.append(d.select("k1", "k2", "doc_id", run("text").alias("r")).select(
            "k1", "k2", "doc_id", "r.*"))
    if len(parts) == 1:
        return parts[0]
    return _merged(d, parts)


def _merged(d: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Union of the blocks' spans and items.  Words hit are counted again in the merged spans."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = materialise(every.filter("n_hit > 0").select("k1", "k2", "spans", "items"), "leaks")
    joined = every.groupBy("k1", "k2").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    @F.pandas_udf("n_words long, n_hit long, spans array<array<int>>")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for t, s in zip(texts, spans):
                words = [m.start() for m in WORD.finditer((t or "").translate({c: c + 32 for c in range(65, 91)}))]
                flags = np.zeros(len(words), dtype=bool)
                for a, b in (s if s is not None else ()):
                    flags[np.searchsorted(words, a):np.searchsorted(words, b)] = True
                rows.append((len(words), int(flags.sum()), char_spans(t or "", flags)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans"])

    out = d.join(joined, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "items", count("text", "spans").alias("r"))
    return out.select("k1", "k2", "doc_id", "r.*", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all their columns."""
    bad = (hits(docs, items, id_col, text_col, **how).filter("n_hit > 0")
           .select("k1", "k2").distinct())
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                       docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    keyed = rows.select("row", F.xxhash64("i", "t").alias("k1"),
                        F.xxhash64(F.lit(7), "t", "i").alias("k2"))
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")

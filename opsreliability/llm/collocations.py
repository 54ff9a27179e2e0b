"""Phrase collocations: multikey three-way quicksort of suffix pointers.

* **Routing.**  Every place of a word in a piece of text points to a suffix, of which the first
  ``MAX_WORDS`` words matter.  Suffixes of two words or more are routed by a hash of language and their two leading words
  to one of ``slots`` groups.  A Python task lays the suffixes of many documents out as arrays of numbers
  and sends one packed row for each slot, with the list of the words that the row uses.
* **Hot slots.**  The packed rows are written once and the suffixes of every slot are added up.  A slot
  with several times the mean is routed again, by the third word too, after equal suffixes of each
  row have become one with a weight.  Nothing of it is abandoned before its parts are added up.
* **Sorting.**  A group's pointers are sorted by multikey three-way quicksort: a pivot at depth d parts
  the pointers in smaller, equal and larger ones, and the equal ones go on at depth d + 1.  The weight of
  an equal partition is the count of the phrase that its pointers have in common.  Partitions below ``least`` are
  abandoned, since nothing in them can be frequent.  Single words are counted apart.
* **Scores** are joins and groupings of the frequent phrases, in exact decimals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from opsreliability.session import materialise

MAX_WORDS = 4
LEAST = 30
TOP = 2000
#: Words laid out at a time in one task, and packed rows that it hands on at a time.
FLUSH, HAND_ON = 1_000_000, 16
#: A slot is hot from so many suffixes, and so many times the mean, on.
HOT_SUFFIXES, HOT_TIMES = 50_000, 4
#: Partitions of the last ranking by language; each hands on TOP rows at most.
RANK_PARTS = 32
#: Bytes to bytes: ends of pieces to full stops, tabs to spaces, A-Z lower-cased.
_BREAK = bytes(0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c
               for c in range(256))
UNKNOWN = "und"
PACKED = "slot long, kind string, n long, words binary, ids binary, weights binary"


class _Numbers(dict):
    """Numbers of byte strings in order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokens(text: str) -> list[bytes]:
    """Words of a text; a full stop stands for every end of a piece, as no word holds one."""
    return text.encode("utf-8", "surrogatepass").translate(_BREAK).replace(b".", b" . ").split()


class _Layout:
    """Suffixes of the documents given so far, to be sent as packed rows."""

    def __init__(self, slots: int):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.names = _Numbers()
        self.names[b"."] = 0
        self.parts, self.size = [], 0

    def add(self, lang: str | None, text: str | None) -> None:
        # a language is written in hex after a full stop, so that it is no word
        lead = self.names[b".=" + (UNKNOWN if lang is None else lang).encode("utf-8", "surrogatepass").hex().encode()]
        if not text:
            return
        words = _tokens(text)
        ids = np.fromiter(map(self.names.__getitem__, words), np.int32, len(words))
        self.parts.append((lead, ids))
        self.size += len(ids) + 1

    def rows(self) -> Iterator[tuple]:
        """Packed rows: counts of single words (kind w) and suffixes (kind s) of each slot."""
        if not self.parts:
            return
        names = np.array(list(self.names), dtype=object)
        code = np.fromiter((zlib.crc32(w) for w in names), np.uint64, len(names))
        ids = np.concatenate([x for _, i in self.parts for x in (i, np.zeros(1, np.int32))])
        lead = np.repeat(np.array([n for n, _ in self.parts], np.int32), [len(i) + 1 for _, i in self.parts])
        yield from self._singles(names, code, lead, ids)
        pad = np.concatenate([ids, np.zeros(MAX_WORDS, np.int32)])
        at = np.flatnonzero((ids > 0) & (pad[1:len(ids) + 1] > 0))
        columns = [lead[at], *(pad[at + d] for d in range(MAX_WORDS))]
        for d in range(3, MAX_WORDS + 1):  # a suffix ends at the first end of a piece
            columns[d] = np.where(columns[d - 1] > 0, columns[d], 0)
        yield from _packed(route(code, columns[:3], self.slots), columns, None, names, "s")

    def _singles(self, names, code, lead, ids) -> Iterator[tuple]:
        leads, of = np.unique(lead, return_inverse=True)
        key, cells = of.ravel() * len(names) + ids, len(leads) * len(names)
        if cells <= 8 * len(ids):
            counts = np.bincount(key, minlength=cells)
            key = np.flatnonzero(counts)
            counts = counts[key]
        else:
            key, counts = np.unique(key, return_counts=True)
        live = key % len(names) > 0
        at, word, counts = key[live] // len(names), key[live] % len(names), counts[live]
        for i, n in enumerate(np.bincount(at, weights=counts, minlength=len(leads)).astype(np.int64)):
            yield -1, "n", int(n), bytes.fromhex(names[leads[i]][2:].decode()), None, None
        columns = [leads[at].astype(np.int32), word.astype(np.int32)]
        yield from _packed(route(code, columns, self.slots), columns, counts, names, "w")


def route(code: np.ndarray, columns: list[np.ndarray], slots: int) -> np.ndarray:
    """Slot of each row of numbers, from the hashes of what they stand for."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = (h ^ code[c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(slots)).astype(np.int64)


def _packed(slot: np.ndarray, columns: list[np.ndarray], weights, names: np.ndarray, kind: str) -> Iterator[tuple]:
    """One row a slot: the words it uses, numbers into them, weights if any, compressed."""
    if not len(slot):
        return
    # rows with the same leading words next to each other: their columns compress to little
    lead = columns[1].astype(np.int64)
    if len(columns) > 2 and (int(slot.max()) + 1) * len(names) ** 2 < 1 << 62:
        lead = lead * len(names) + columns[2]
        order = np.argsort(slot * len(names) ** 2 + lead)
    else:
        order = np.lexsort((lead, slot))
    del lead
    slot = slot[order]
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    used, place = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int32)
    small = zstandard.ZstdCompressor(level=3).compress
    for a, b in zip(starts, [*starts[1:], len(slot)]):
        part = np.stack([c[order[a:b]] for c in columns])  # a slot at a time: the whole table is never copied
        used[part.ravel()] = True
        used[0] = True
        words = np.flatnonzero(used)
        used[words] = False
        place[words] = np.arange(len(words))
        local = place[part].astype("<u2" if len(words) < 1 << 16 else "<u4")
        # low bytes first, then high bytes: common words have small numbers
        planes = local.view(np.uint8).reshape(-1, local.itemsize).T
        yield (int(slot[a]), kind, b - a, small(b"\n".join(names[words])), small(planes.tobytes()),
               None if weights is None else small(weights[order[a:b]].astype("<i8").tobytes()))


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(names, numbers by depth, weights or None) of packed rows of one kind, with common numbers."""
    names: dict[bytes, int] = {b".": 0}
    total, at = int(rows.n.sum()), 0
    table, weights = None, None if all(w is None for w in rows.weights) else np.ones(total, np.int64)
    whole = zstandard.ZstdDecompressor().decompress
    for n, words, ids, w in zip(rows.n, rows.words, rows.ids, rows.weights):
        words = whole(words).split(b"\n")
        wide = 2 if len(words) < 1 << 16 else 4
        ids = np.ascontiguousarray(np.frombuffer(whole(ids), np.uint8).reshape(wide, -1).T)
        place = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int32, len(words))
        local = ids.view(f"<u{wide}").reshape(-1, n)
        if table is None:
            table = np.empty((len(local), total), np.int32)
        for line, numbers in zip(table, local):
            line[at:at + n] = place[numbers]
        if w is not None:
            weights[at:at + n] = np.frombuffer(whole(w), dtype="<i8")
        at += n
    return np.array(list(names), dtype=object), table, weights


def multikey_quicksort(table: np.ndarray, weights: np.ndarray | None, least: int,
                       first: int = 0) -> Iterator[tuple[int, int, int]]:
    """(pointer, depth, weight) of every group of rows that have their first ``depth`` + 1 numbers in
    common, weigh ``least`` or more together, and have no 0 among them; from depth ``first`` on.

    ``table`` has one line of numbers for each depth.  Without ``weights`` each row weighs 1.  Of a
    group, one pointer stands for all.
    """
    def weigh(at: np.ndarray) -> int:
        return len(at) if weights is None else int(weights[at].sum())

    stack = [(np.arange(table.shape[1]), 0)]
    while stack:
        at, depth = stack.pop()
        if weigh(at) < least or not len(at):
            continue
        keys = table[depth][at]
        pivot = sorted((keys[0], keys[len(at) // 2], keys[-1]))[1]  # median of three
        less, more = keys < pivot, keys > pivot
        same = ~(less | more)
        if not same.all():
            stack.append((at[less], depth))
            stack.append((at[more], depth))
            at = at[same]
        if pivot == 0 or (total := weigh(at)) < least:
            continue  # a suffix that ends here has nothing deeper
        if depth >= first:
            yield int(at[0]), depth, total
        if depth + 1 < len(table):
            stack.append((at, depth + 1))


def _frequent(least: int, split: bool):
    """Packed rows of one slot to (lang, phrase, words, f).

    Of a slot that was split, only phrases of three words or more are whole; shorter ones come with what
    this part has of them."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in rows.groupby("kind"):
            names, table, weights = _unpacked(part)
            if split and kind == "s":
                found = [x for x in multikey_quicksort(table[:3], weights, 1, 2)]
                found += [x for x in multikey_quicksort(table, weights, least, 3)]
            else:
                found = multikey_quicksort(table, weights, least, 1 if kind == "w" else 2)
            for p, depth, n in found:
                lang, *words = names[table[:depth + 1, p]]
                out.append((bytes.fromhex(lang[2:].decode()).decode("utf-8", "surrogatepass"),
                            b" ".join(words).decode("utf-8", "surrogatepass"), depth, n))
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "f"])

    return run


def _again(slots: int, parts: int):
    """Hot packed rows, equal suffixes made one, routed by three leading words to ``parts`` times as many slots."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                names, table, weights = _unpacked(pd.DataFrame([row]))
                columns, where = np.unique(table, axis=1, return_inverse=True)
                added = np.bincount(where.ravel(), weights=weights).astype(np.int64)  # whole rows: below 2^53
                code = np.fromiter((zlib.crc32(w) for w in names), np.uint64, len(names))
                sub = route(code, list(columns[:4]), parts)
                out += [(row.slot * parts + s, *rest) for s, *rest in _packed(sub, list(columns), added, names, "s")]
            yield pd.DataFrame(out, columns=["slot", "kind", "n", "words", "ids", "weights"])

    return run


def phrase_counts(docs: DataFrame, lang_col: str, text_col: str, least: int,
                  slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to MAX_WORDS words found ``least`` times or more, and
    (lang, n): all occurrences of words."""
    spark = docs.sparkSession
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout = _Layout(slots)

        def sent() -> Iterator[pd.DataFrame]:
            rows = list(layout.rows())
            layout.clear()
            while rows:
                yield pd.DataFrame(rows[:HAND_ON], columns=["slot", "kind", "n", "words", "ids", "weights"])
                del rows[:HAND_ON]

        for b in batches:
            for lang, text in zip(b.lang, b.text):
                layout.add(lang, text)
                if layout.size > FLUSH:
                    yield from sent()
        yield from sent()

    packed = materialise(d.mapInPandas(lay, PACKED), "phrase-suffixes")
    sizes = packed.filter("kind = 's'").groupBy("slot").agg(F.sum("n").alias("n"))
    mean = sizes.agg((F.sum("n") / F.lit(slots)).alias("mean")).first()["mean"] or 0.0
    limit = max(HOT_SUFFIXES, HOT_TIMES * mean)
    # fewer than slots / HOT_TIMES of them
    hot = [r["slot"] for r in sizes.filter(F.col("n") > limit).select("slot").collect()]
    is_hot = F.col("slot").isin(hot) & (F.col("kind") == "s")
    schema = "lang string, phrase string, words int, f long"
    totals = packed.filter("kind = 'n'").groupBy(F.decode("words", "UTF-8").alias("lang")).agg(F.sum("n").alias("n"))
    packed = packed.filter("kind <> 'n'")
    found = packed.filter(~is_hot).groupBy("slot").applyInPandas(_frequent(least, False), schema)
    if hot:
        parts = max(2, slots // 4)
        again = packed.filter(is_hot).mapInPandas(_again(slots, parts), PACKED)
        found = found.unionByName(again.groupBy("slot").applyInPandas(_frequent(least, True), schema))
    counts = materialise(found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
                         .filter(F.col("f") >= least), "phrase-counts")
    return counts, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 top: int | None = TOP, slots: int | None = None) -> DataFrame:
    """Per language the ``top`` phrases (None: all): lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to MAX_WORDS consecutive words of a piece of text, found ``least`` times or more; a is how
    often, l and r are the counts of the parts at the cut with the lowest score
    floor(2,000,000 a / (l + r)), n all occurrences of words in the language.  Phrases inside a longer one
    that is found at least 0.8 times as often are left out.  Ranked by score, then a, both descending, then by the
    phrase's bytes.  A null language is ``und``, together with rows that say so; a null or empty text has
    no words; every row counts, repeated or not.  A table without frequent phrases gives no rows; other columns are not
    looked at.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, least, slots)
    whole = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    rest = F.expr("substr(phrase, length(first) + 2)")
    cuts = (whole.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
            .withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", rest))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
            .select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    split = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), "
                   "i -> array_join(slice(w, i, n), ' '))))")
    longer = (whole.filter("words > 2").withColumn("w", split).select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("outer")))
    covered = F.expr("cast(outer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * 80")
    kept = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("outer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # each part of a language hands on its first rows, so that the last ranking is bounded
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        kept = (kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
                .filter(F.col("at") <= top).drop("at"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

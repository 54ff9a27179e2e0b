"""Substring deduplication: documents are factored against an index of all earlier documents.

A window of ``WINDOW`` words is duplicate if its words also start in a document with a smaller id.
A maximal run of duplicate windows is a factor: a copied stretch of ``WINDOW`` words or more.

The reference is indexed in blocks (hash partitions), every document is parsed against all of them:

* **Anchors.** Among the ``GRAM``-word hashes inside a window the smallest is its anchor, so equal
  windows have equal anchors, and one anchor serves about five windows.  Only anchors go through
  the first exchange; those of one document alone cannot lie in a factor.
* **Boundaries.** At anchors that documents share, the window hashes are looked up one by one.  A
  factor ends exactly where the last window matches, and the next one may overlap it, which greedy
  parsing from the end of the last factor would miss.

Before each exchange a task keeps one row of what its own documents repeat (the smallest document);
the others are settled there, so a passage that a third of all documents share sends one row for
each batch.  Hashes travel packed, some thousand a row.  Texts are exchanged once: both uses share
the exchange.  A window is identified by 128 bits (its hash and its anchor's).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from opsreliability.llm.common import LAST_ID, narrow
from opsreliability.session import materialise

WINDOW = 13
GRAM = 5
#: Words hashed together in a task: bounds its memory; a longer document is a chunk of its own.
CHUNK = 300_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, start, window hash, anchor hash) of all windows of some documents."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((xxh64_intdigest(x) for w in words for x in w), dtype="<u8", count=int(sizes.sum()))
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    g = h[:len(h) - GRAM + 1].copy()
    for j in range(1, GRAM):
        g = _mix(g * _M1 + h[j:len(h) - GRAM + 1 + j])
    inner = WINDOW - GRAM + 1
    low, span = g, 1
    while span < inner:  # minimum over ``inner`` grams, by doubling
        step = min(span, inner - span)
        low = np.minimum(low[:len(low) - step], low[step:])
        span += step
    whole = _mix(_mix(g[:n] * _M1 + g[GRAM:GRAM + n]) * _M1 + g[inner - 1:inner - 1 + n])
    doc = np.repeat(np.arange(len(words)), sizes)
    start = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = doc[:n] == doc[WINDOW - 1:]
    return doc[:n][inside], start[:n][inside], whole[inside], low[inside]


def _chunks(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Parts of a batch with their words, ``CHUNK`` words or one document at a time."""
    at, words, held = 0, [], 0
    for i, text in enumerate(b.text):
        w = words_of(text)
        if words and held + len(w) > CHUNK:
            yield b.iloc[at:i], words
            at, words, held = i, [], 0
        words.append(w)
        held += len(w)
    if words:
        yield b.iloc[at:], words


def _split(bucket: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row for each bucket, its values packed as bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    out = {"bucket": b[edges]}
    ends = np.r_[edges[1:], len(b)]
    for name, values in columns.items():
        v = values[order]
        out[name] = [v[i:j].tobytes() for i, j in zip(edges, ends)]
    return pd.DataFrame(out)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Flags of the first row of each run of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _all(batches: Iterator[pd.DataFrame], **kinds: str) -> dict[str, np.ndarray]:
    """A partition's packed columns, laid end to end; ``loose`` marks what needs no comparison."""
    parts: dict[str, list[bytes]] = {k: [] for k in kinds}
    loose = []
    for b in batches:
        for k in kinds:
            parts[k] += list(b[k])
        width = np.dtype(next(iter(kinds.values()))).itemsize
        loose += [np.full(len(x) // width, r < 0) for r, x in zip(b.bucket, b[next(iter(kinds))])]
    out = {k: np.frombuffer(b"".join(parts[k]), dtype=t) for k, t in kinds.items()}
    out["loose"] = np.concatenate(loose) if loose else np.zeros(0, bool)
    return out


def shared_anchors(d: DataFrame, buckets: int) -> DataFrame:
    """(k1, anchors): for each document the anchors that other documents have too."""
    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, words in _chunks(b):
                doc, _, _, low = window_hashes(words)
                first = _firsts(doc, low)
                doc, low = doc[first], low[first]
                order = np.lexsort((doc, low))
                doc, low = doc[order], low[order]
                once = _firsts(doc, low)
                doc, low = doc[once], low[once]
                head = _firsts(low)
                group = np.cumsum(head) - 1
                many = (np.bincount(group, minlength=1) > 1)[group] if len(group) else head
                who = part.k1.to_numpy()[doc]
                # the first document of a repeated anchor speaks for the others
                spot = np.where(head, (low % np.uint64(buckets)).astype(np.int64),
                                -1 - who % buckets)
                yield _split(spot, key=low, who=who, known=many.astype(np.uint8))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _all(batches, key="<u8", who="<i8", known="u1")
        order = np.argsort(x["key"], kind="stable")
        key, who = x["key"][order], x["who"][order]
        head = _firsts(key) if len(key) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        hit = (np.bincount(group, minlength=1) > 1)[group] if len(group) else head
        hit = hit | (x["known"][order] > 0) | x["loose"][order]
        order = np.argsort(who[hit], kind="stable")
        yield _split(who[hit][order] % buckets, k1=who[hit][order], anchors=key[hit][order])

    def hand_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _all(batches, k1="<i8", anchors="<u8")
        yield _split(x["k1"], anchors=x["anchors"]).rename(columns={"bucket": "k1"})

    sent = d.select("k1", "text").mapInPandas(anchors, "bucket long, key binary, who binary, known binary")
    met = sent.repartition(buckets, "bucket").mapInPandas(meet, "bucket long, k1 binary, anchors binary")
    named = met.repartition(buckets, "bucket").mapInPandas(hand_out, "k1 long, anchors binary")
    return named.groupBy("k1").agg(F.collect_list("anchors").alias("anchors"))


def duplicate_windows(texts: DataFrame, buckets: int) -> DataFrame:
    """(k1, found) with the duplicate windows as structs (k2, starts); ``texts`` has the shared anchors
    of each row."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, words in _chunks(b):
                doc, start, whole, low = window_hashes(words)
                known = [x for lists in part.anchors if lists is not None for x in lists]
                hot = np.isin(low, np.frombuffer(b"".join(known), dtype="<u8"))
                doc, start, whole, low = doc[hot], start[hot], whole[hot], low[hot]
                owner = part.owner.to_numpy()[doc]
                order = np.lexsort((start, doc, owner, low, whole))
                doc, start, whole, low, owner = (v[order] for v in (doc, start, whole, low, owner))
                head = _firsts(whole, low) if len(doc) else np.zeros(0, bool)
                best = owner[head][np.cumsum(head) - 1] if len(doc) else owner
                later = owner > best
                # places of one document go together; those known to be later are settled here
                k1, k2 = part.k1.to_numpy()[doc], part.k2.to_numpy()[doc]
                spot = np.where(later, -1 - k1 % buckets, (whole % np.uint64(buckets)).astype(np.int64))
                order = np.lexsort((start, doc))
                yield _split(spot[order], whole=whole[order], low=low[order], owner=owner[order],
                             k1=k1[order], k2=k2[order], start=start[order].astype("<i4"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _all(batches, whole="<u8", low="<u8", owner="<i8", k1="<i8", k2="<i8", start="<i4")
        order = np.lexsort((x["owner"], x["low"], x["whole"]))
        x = {k: v[order] for k, v in x.items()}
        n = len(order)
        # what was settled before never is the smallest, so it cannot disturb the comparison
        head = _firsts(x["whole"], x["low"]) if n else np.zeros(0, bool)
        best = x["owner"][head][np.cumsum(head) - 1] if n else x["owner"]
        hit = (x["owner"] > best) | x["loose"]
        k1, k2, start = x["k1"][hit], x["k2"][hit], x["start"][hit]
        order = np.lexsort((start, k2, k1))
        yield _split(k1[order] % buckets, k1=k1[order], k2=k2[order], start=start[order])

    def hand_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _all(batches, k1="<i8", k2="<i8", start="<i4")
        order = np.lexsort((x["k2"], x["k1"]))
        k1, k2, start = x["k1"][order], x["k2"][order], x["start"][order]
        edges = np.flatnonzero(_firsts(k1, k2)) if len(k1) else np.zeros(0, np.int64)
        ends = np.r_[edges[1:], len(k1)]
        yield pd.DataFrame({"k1": k1[edges], "k2": k2[edges],
                            "starts": [start[i:j].tobytes() for i, j in zip(edges, ends)]})

    sent = texts.mapInPandas(look, "bucket long, whole binary, low binary, owner binary, k1 binary, "
                                   "k2 binary, start binary")
    met = sent.repartition(buckets, "bucket").mapInPandas(
        meet, "bucket long, k1 binary, k2 binary, start binary")
    named = met.repartition(buckets, "bucket").mapInPandas(hand_out, "k1 long, k2 long, starts binary")
    return (named.repartition(buckets, "k1").groupBy("k1")
            .agg(F.collect_list(F.struct("k2", "starts")).alias("found")))


def removed_words(n: int, starts: list[bytes] | None) -> np.ndarray:
    """Flags of the words that duplicate windows cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if starts is not None and len(starts):
        at = np.unique(np.frombuffer(b"".join(starts), dtype="<i4"))
        edge[at] += 1
        edge[at + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def factors(flags: np.ndarray) -> list[list[int]]:
    """Runs of removed words as [first, length]."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [[int(a), int(b - a)] for a, b in zip(edge[::2], edge[1::2])]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = True) -> DataFrame:
    """Per row: k1, k2, doc_id, n_words, n_removed, kept_sha256, and if asked for kept_text and
    spans (the removed stretches as [first word, length]).

    A word is removed if a duplicate window covers it; windows are judged on the input.  Null and
    empty texts have no words, texts of fewer than 13 words no window.  Rows of one id are one
    document; rows without an id are one document after all others.  Repeated rows stay repeated.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = narrow(docs, id_col, text_col).select(
        "k1", "k2", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("owner"))
    anchors = materialise(shared_anchors(d, buckets), "substring-anchors")
    texts = d.repartition(buckets, "k1")  # both uses read all its columns: one exchange for both
    found = duplicate_windows(texts.join(anchors, "k1"), buckets)
    fields = "n_words long, n_removed long, kept_sha256 string"
    more = ", kept_text string, spans array<array<int>>" if with_text else ""

    @F.pandas_udf(fields + more)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, starts in batches:
            rows = []
            for text, s in zip(batch, starts):
                words = words_of(text)
                gone = removed_words(len(words), s)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept.decode("utf-8", "surrogatepass"), factors(gone)) if with_text else ()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (fields + more).split(", ")])

    # joined on k1 alone, as in the first use: a second key would deal the texts out once more
    own = F.transform(F.filter("found", lambda x: x["k2"] == F.col("k2")), lambda x: x["starts"])
    out = texts.join(found, "k1", "left").withColumn("starts", own)
    return (out.select("k1", "k2", "owner", cut("text", "starts").alias("r"))
            .select("k1", "k2", F.when(F.col("owner") < LAST_ID, F.col("owner")).alias("doc_id"), "r.*"))

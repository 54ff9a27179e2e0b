"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

The network reads windows of ``STEPS`` words that overlap by a third.  A word enters as the sum of two
inputs: an embedding of its hash, and the mean embedding of its character trigrams (which spelling
variants share).  Forward and backward hidden states are pooled by attention into one logit; a
text scores as its worst window.  Everything is numpy: the fit runs on a bounded sample of labelled
rows on the driver, scoring in Arrow batches on all rows, whole texts.

Labels are of documents, not windows.  The fit starts from the window with the most telling word
(log-odds between the classes), then picks each document's worst window by the network itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opsreliability.llm.common import narrow

#: Labelled rows that a fit reads at most: those with the smallest hashes of their ids, among texts
#: of at most ``SAMPLE_CHARS`` characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
STEPS, STRIDE = 24, 16
#: Hash buckets of words and of trigrams, width of embeddings, hidden states, attention.
WORDS, GRAMS, WIDTH, HIDDEN, ATTEND = 1 << 15, 1 << 12, 8, 8, 8
#: Words scored at a time: bounds the memory of a task.
CHUNK = 40_000
_SPLIT = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, word bucket, trigram bucket of every byte, first byte of each word).

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    gap = _SPLIT[buf]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    # polynomial hash of every word from one running sum
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(buf), _R)])
    total = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(buf), _RINV)])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(31))) * _R
    bucket = (h >> np.uint64(49)).astype(np.int64)
    wide = np.where(gap, 32, buf).astype(np.int64)
    gram = np.zeros(len(buf), dtype=np.int64)
    gram[1:-1] = (wide[:-2] * 7919 + wide[1:-1] * 104729 + wide[2:] * 1299709) * 2654435761 >> 7
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    doc = np.searchsorted(1 + np.cumsum(sizes), starts, side="right")
    return np.bincount(doc, minlength=len(texts)), bucket, gram % GRAMS, np.stack([starts, ends])


def many_features(texts: list[str | None], step: int = 200):
    """``features`` of many texts, a few at a time: what it needs in between stays small."""
    parts, held = [], 0
    for i in range(0, len(texts), step):
        counts, bucket, gram, spans = features(texts[i:i + step])
        parts.append((counts, bucket, gram.astype(np.int32), spans + held))
        held += len(gram)
    return tuple(np.concatenate(x, -1) for x in zip(*parts))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word numbers) of overlapping windows; -1 pads texts shorter than a window.  The
    last window of a text ends with it.  A text without words has one empty window."""
    docs, firsts = [], []
    base = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        last = max(0, n - STEPS)
        f = np.unique(np.r_[np.arange(0, last + 1, STRIDE), last])
        docs.append(np.full(len(f), d))
        firsts.append(f)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    at = first[:, None] + np.arange(STEPS)
    return doc, np.where(at < counts[doc][:, None], at + base[doc][:, None], -1) if len(doc) else at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def init(*shape, scale=None):
            return (r.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.p = {"words": init(WORDS, WIDTH, scale=0.05), "grams": init(GRAMS, WIDTH, scale=0.05),
                  "A": init(2 * HIDDEN, ATTEND), "v": init(ATTEND), "u": init(2 * HIDDEN),
                  "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(2 * WIDTH, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN),
                       f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, bucket: np.ndarray, gram: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Word and character input of each word, and a zero row for padding."""
        out = np.zeros((len(bucket) + 1, 2 * WIDTH), np.float32)
        if len(bucket):
            out[:-1, :WIDTH] = self.p["words"][bucket]
            size = spans[1] - spans[0]
            heads = np.cumsum(size) - size
            each = np.repeat(spans[0] - heads, size) + np.arange(size.sum())
            sums = np.add.reduceat(self.p["grams"][gram[each]], heads, axis=0)
            out[:-1, WIDTH:] = sums / size[:, None]
        return out

    def _run(self, d: str, proj: np.ndarray, at: np.ndarray, keep: list | None):
        """Hidden states of one direction, (steps, windows, hidden)."""
        h = np.zeros((len(at), HIDDEN), np.float32)
        out = np.zeros((STEPS, len(at), HIDDEN), np.float32)
        for t in range(STEPS) if d == "f" else range(STEPS - 1, -1, -1):
            x, g = proj[at[:, t]], h @ self.p[f"U{d}"]
            zr = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            m = (at[:, t] >= 0)[:, None]
            new = np.where(m, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * HIDDEN:], m))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        states = []
        for d in "fb":
            if keep is not None:
                keep[d] = []
            states.append(self._run(d, x @ self.p[f"W{d}"] + self.p[f"b{d}"], at,
                                    keep[d] if keep is not None else None))
        h = np.concatenate(states, 2)
        a = np.tanh(h @ self.p["A"])
        s = np.where((at >= 0).T, a @ self.p["v"], -1e9)
        e = np.exp(s - s.max(0))
        w = (e / e.sum(0)).astype(np.float32)
        pooled = (h * w[:, :, None]).sum(0)
        if keep is not None:
            keep.update(h=h, a=a, w=w, pooled=pooled)
        return pooled @ self.p["u"] + self.p["c"]

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted logistic loss, and that of the inputs."""
        k: dict = {}
        p = self.p
        logit = self.forward(x, at, k)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"c": d.sum(keepdims=True), "u": k["pooled"].T @ d}
        dpool = d[:, None] * p["u"]
        dw = (k["h"] * dpool).sum(2)
        ds = k["w"] * (dw - (k["w"] * dw).sum(0))
        da = ds[:, :, None] * p["v"] * (1 - k["a"] ** 2)
        g["v"] = (k["a"] * ds[:, :, None]).sum((0, 1))
        g["A"] = np.tensordot(k["h"], da, ((0, 1), (0, 1)))
        dh = k["w"][:, :, None] * dpool + da @ p["A"].T
        dx = np.zeros_like(x)
        for i, way in enumerate("fb"):
            carry = np.zeros((len(at), HIDDEN), np.float32)
            gU, dproj = np.zeros_like(p[f"U{way}"]), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, n, gn, m in reversed(k[way]):
                full = dh[t, :, i * HIDDEN:(i + 1) * HIDDEN] + carry
                act = np.where(m, full, 0)
                dn = act * (1 - z) * (1 - n ** 2)
                dz = act * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                gU += h.T @ dg
                dproj[at[:, t]] = np.concatenate([dz, dr, dn], 1)  # a word stands in one place
                carry = np.where(m, act * z, full) + dg @ p[f"U{way}"].T
            dproj[-1] = 0
            g[f"U{way}"], g[f"W{way}"], g[f"b{way}"] = gU, x.T @ dproj, dproj.sum(0)
            dx += dproj @ p[f"W{way}"].T
        return g, dx


def _log_odds(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """How much likelier each bucket's documents are toxic, from counts of documents."""
    pair = np.unique(ids * len(y) + doc)
    seen = np.bincount(pair // len(y), minlength=size)
    bad = np.bincount(pair // len(y), weights=y[pair % len(y)], minlength=size)
    rate = y.mean()
    return (np.log((bad + rate * 2) / (seen - bad + (1 - rate) * 2)) - np.log(rate / (1 - rate))).astype(np.float32)


def _added(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by id."""
    return np.stack([np.bincount(ids, weights=c, minlength=size) for c in rows.T], 1).astype(np.float32)


def train(texts: list[str], y: np.ndarray, rounds: int = 3, updates: int = 190, batch: int = 128,
          rate: float = 0.01, seed: int = 7) -> Network:
    """Fit on labelled texts: in each round as many updates whatever the sample's size.  With one
    class only the network is its bias."""
    net = Network(seed)
    y = y.astype(np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
    if not len(y) or y.min() == y.max():
        net.p["u"][:] = 0
        net.p["c"][:] = np.log(share / (1 - share))
        return net
    counts, bucket, gram, spans = many_features(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    odds = _log_odds(bucket, owner, y, WORDS)
    net.p["words"][:, 0] = odds / 2
    each = [np.unique(np.concatenate([gram[a:b] for a, b in spans.T[i:j]]) if j > i else gram[:0])
            for i, j in zip(np.cumsum(counts) - counts, np.cumsum(counts))]
    net.p["grams"][:, 0] = _log_odds(np.concatenate(each).astype(np.int64), np.repeat(
        np.arange(len(texts)), [len(x) for x in each]), y, GRAMS) / 2
    doc, at = windows(counts)
    peak = np.where(at >= 0, odds[bucket[np.maximum(at, 0)]] if len(bucket) else 0, -9).max(1)
    r = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        # the worst window of each document, and one of any kind from documents that are not toxic
        order = np.lexsort((-peak, doc))
        top = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        other = r.permutation(np.flatnonzero(y[doc] == 0))[:len(top)]
        chosen = np.r_[top, other]
        many = -(-updates * batch // max(1, len(chosen)))
        rows = np.concatenate([r.permutation(chosen) for _ in range(many)])
        for part in np.array_split(rows[:updates * batch], updates):
            step += 1
            here = at[part] >= 0
            used = at[part][here]
            local = np.full(here.shape, -1)
            local[here] = np.arange(len(used))
            x = net.inputs(bucket[used], gram, spans[:, used]) if len(used) else net.inputs(
                bucket[:0], gram, spans[:, :0])
            g, dx = net.gradients(x, local, y[doc[part]], np.ones(len(part), np.float32))
            g["words"] = _added(bucket[used], dx[:-1, :WIDTH], WORDS)
            s, e = spans[:, used]
            span = e - s
            each = np.repeat(s - np.cumsum(span) + span, span) + np.arange(span.sum())
            g["grams"] = _added(gram[each], np.repeat(dx[:-1, WIDTH:] / span[:, None], span, 0), GRAMS)
            speed = rate * (0.5 ** round_)
            for k, v in net.p.items():
                a, b = moments[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] ** 2 - b)
                v -= speed * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)
        peak = _logits(net, bucket, gram, spans, at)
    return net


def _logits(net: Network, bucket, gram, spans, at) -> np.ndarray:
    """Logits of many windows, a bounded number of words at a time."""
    out = np.zeros(len(at), np.float32)
    step = max(1, CHUNK // STEPS)
    for i in range(0, len(at), step):
        a = at[i:i + step]
        if (a >= 0).any():
            low, high = a[a >= 0].min(), a.max() + 1
            x = net.inputs(bucket[low:high], gram[spans[0, low]:spans[1, high - 1] + 1],
                           spans[:, low:high] - spans[0, low])
            out[i:i + step] = net.forward(x, np.where(a >= 0, a - low, -1))
        else:
            out[i:i + step] = net.forward(net.inputs(bucket[:0], gram, spans[:, :0]), a)
    return out


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """Score of each text: the probability of its worst window."""
    if not texts:
        return np.zeros(0)
    counts, bucket, gram, spans = features(texts)
    doc, at = windows(counts)
    logit = _logits(net, bucket, gram, spans, at)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, logit)
    return _sigmoid(best.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """Fit on at most ``rows`` labelled documents; null ids, labels and texts are left out.  A
    document with several labels counts as toxic if one of them says so."""
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"),
                          labels[label_col].cast("int").alias("y")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"),
                        docs[text_col].cast("string").alias("text")).filter(F.length("text") <= chars)
    ids = (texts.select("doc_id").join(marks, "doc_id").dropDuplicates(["doc_id"])
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most ``rows`` ids, so the broadcast is bounded
    got = (texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y")
           .agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    return train([r.text for r in got], np.array([min(r.y, 1) for r in got], dtype=np.float32))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: k1, k2, doc_id, score.  Null and empty texts score as an empty window.  Repeated
    rows score alike and stay repeated."""
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Network()
        model.p = sent.value
        for texts in batches:
            texts, out, at = list(texts), [], 0
            while at < len(texts):  # a bounded number of characters at a time, or one text
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") < 8 * CHUNK):
                    held += len(texts[end] or "")
                    end += 1
                out.append(score_texts(model, texts[at:end]))
                at = end
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    d = narrow(docs, id_col, text_col)
    return d.select("k1", "k2", "doc_id", run("text").alias("score"))

"""Fill-in-middle, nearest vectors and phrases against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsreliability.llm import collocations, fim, neighbours

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", " \n\t ", "one", " lead", "trail ", "a  b\n\nc\td ", "marks <P> here", "x<S>", "é 漢字 x 　 z",
         "<M", "w " * 3000, "\t" * 70_000 + "x" * 70_000 + " ", " ".join(f"w{i}" for i in range(40_000))]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rearranged(i, t):
    t = t or ""
    w = TOKEN.findall(t)
    d = sha(f"42:{'' if i is None else i}")
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
        return len(w), "plain", None, None, sha(t), sha(t)
    u, v = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    a, b, c = "".join(w[:u]), "".join(w[u:v]), "".join(w[v:])
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 80 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return len(w), form, len(a), len(b), sha(out), sha(t)


def test_fill_in_middle_equals_the_tokens(spark):
    rows = [(i * 20 + k, t, 1, "n") for k, t in enumerate(TEXTS) for i in range(20)]
    rows += [(None, "a null id", 1, "n"), (None, "a null id", 1, "n"), ((1 << 62) + 1, "a b c d e f", 1, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = fim.fill_in_middle(d).collect()
    digests = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got]
    assert Counter(digests) == Counter((i, *rearranged(i, t)) for i, t, _, _ in rows)
    assert all(sha(r.output) == r.output_sha256 for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(d.limit(0)).count() == 0


def test_wavelet_matrix_ranks_and_selects(monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 37)  # classes go on across slices
    r = np.random.default_rng(2)
    for n in (0, 1, 36, 37, 38, 700, 5000):
        t = "".join(r.choice(list("ab \n"), n))
        kinds = [c in " \n" for c in t]
        classes = [2 * k + (j == 0 or kinds[j - 1] != k) for j, k in enumerate(kinds)]
        m = fim.WaveletMatrix(t)
        for i in {0, n // 3, n // 2, n}:
            assert [m.rank(s, i) for s in range(4)] == [classes[:i].count(s) for s in range(4)]
        for s in range(4):
            places = [j for j, c in enumerate(classes) if c == s]
            for k in {1, len(places) // 2, len(places)} - {0}:
                if places:
                    assert m.select(s, k) == places[k - 1]
        tokens = TOKEN.findall(t)
        assert [m.cut(u) for u in range(len(tokens) + 1)] == [sum(map(len, tokens[:u])) for u in range(len(tokens) + 1)]


def nearest_by_force(rows, k, every=50):
    live = [(n, i, v) for n, (i, v) in enumerate(rows)
            if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    width = max(len(v) for _, _, v in live)
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, _, v in live])
    size = np.sqrt((x * x).sum(1))
    out = Counter()
    for a, (n, i, _) in enumerate(live):
        if i is None or i % every:
            continue
        s = (x * x[a]).sum(1) / (size * size[a])
        best = sorted((-s[b], m is None, m or 0, o) for b, (o, m, _) in enumerate(live) if o != n)[:k]
        out.update((i, rank, None if none else m, round(-v, 12)) for rank, (v, none, m, _) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("query_block,codes", [(16_384, 4096), (3, 50)])
def test_nearest_equals_brute_force(spark, monkeypatch, query_block, codes):
    monkeypatch.setattr(neighbours, "CODES", codes)
    r = np.random.default_rng(4)
    vectors = r.standard_normal((600, 24)).astype(np.float32).tolist()
    for i in range(100, 300):
        vectors[i] = vectors[50]  # one vector holds a third of the rows
    vectors[7], vectors[8], vectors[9], vectors[10] = [0.0] * 24, None, [None] + [1.0] * 23, [float("nan")] * 24
    vectors[11], vectors[12], vectors[13] = [float("inf")] * 24, [], [1.0, 2.0]
    rows = list(enumerate(vectors)) + [(100, vectors[100]), (100, vectors[3]), (None, vectors[100]), (None, [1e-30] * 24)]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, row int").repartition(5)
    got = neighbours.nearest(d, F.col("id") % 50 == 0, query_block=query_block).collect()
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert Counter((x.query_id, x["rank"], x.vec_id, round(x.score, 12)) for x in got) == nearest_by_force(rows, 5)


def test_nearest_with_few_or_no_candidates(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("id") % 50 == 0).collect()
    assert [(x.query_id, x["rank"], x.vec_id) for x in got] == [(0, 1, 1)] and abs(got[0].score - 0.5 ** 0.5) < 1e-15
    assert neighbours.nearest(d.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(d.limit(0), F.col("id") % 50 == 0).count() == 0


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(8)
    x = neighbours.unit(r.standard_normal((3000, 64)))
    mean, turn = x.mean(0), neighbours.rotation(64, 42)
    code, size, f = neighbours.encode(x, mean, turn)
    q = neighbours._prepared(list(x[:50]), np.arange(50), 64, mean, 42)
    middle = q["shift"][:, None] + size * neighbours.estimates(code, q["planes"], q["low"], q["step"], 64) / f
    error = np.abs(middle - x[:50] @ x.T)
    slack = size * np.sqrt(1 - f * f) / f * neighbours.EPSILON / np.sqrt(63)
    away = np.arange(50)[:, None] != np.arange(3000)
    assert (error > slack)[away].mean() < 5e-4 and error[away].mean() < 0.1


def phrases_by_force(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    kept = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            cuts = []
            for k in range(2, len(p)):
                left, right = f[p[:k]], f[(p[0], *p[k:])]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            kept[p] = (a, min(cuts))
    for p in list(kept):
        a = f[p]
        if any(q[0] == p[0] and len(q) > len(p) and 100 * kept[q][0] >= 80 * a
               and any(q[i:i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q in list(kept)):
            kept[p] = (*kept[p], "inside")
    out = []
    for lang in n:
        own = sorted((-v[1][0], -v[0], " ".join(p[1:]).encode(), v) for p, v in kept.items() if p[0] == lang and len(v) == 2)
        out += [(lang, i, t.decode(), v[0], v[1][2], v[1][3], n[lang], v[1][0])
                for i, (_, _, t, v) in enumerate(own[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("slots,hot,flush", [(None, 50_000, 2_000_000), (2, 20, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, slots, hot, flush):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "HOT_SUFFIXES", hot)
    monkeypatch.setattr(collocations, "HOT_TIMES", 0.5)
    r = np.random.default_rng(6)
    words = ["of", "The", "the", "a b", "é", "New", "york", "city", "\x1c", "漢字", "-", "x"]
    rows = [(["en", None, "und", "", "a.b\nc"][i % 5], "".join(
        x + sep for x, sep in zip(r.choice(words, 60), r.choice([" ", "  ", "\t", " . ", "\n", ", ", "?"], 60,
                                                                p=[.6, .1, .1, .05, .05, .05, .05])))) for i in range(60)]
    rows += [("en", "the the the the the " * 20), ("en", "New York City, " * 30), ("en", None), (None, ""), ("xx", "rare words")]
    d = spark.createDataFrame([(a, t, 1) for a, t in rows], "lang string, text string, n int").repartition(3)
    for least, top in ((3, 10), (5, 2000)):
        got = collocations.collocations(d, least=least, top=top, slots=slots).collect()
        assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == phrases_by_force(rows, least, top)
    assert collocations.collocations(d.limit(0), slots=slots).count() == 0
    assert collocations.collocations(d.filter("lang = 'xx'"), slots=slots).count() == 0


def test_quicksort_counts_groups():
    r = np.random.default_rng(9)
    table, weights = r.integers(0, 5, (3, 400)), r.integers(1, 4, 400)
    want = Counter()
    for c, w in zip(table.T.tolist(), weights.tolist()):
        for d in range(3):
            if 0 not in c[:d + 1]:
                want[tuple(c[:d + 1])] += w
    got = {tuple(table[:d + 1, p].tolist()): n for p, d, n in collocations.multikey_quicksort(table, weights, 12)}
    assert got == {k: n for k, n in want.items() if n >= 12}


def test_packing_suffixes_keeps_one_copy_of_them():
    """Beside its input and what it sends, a packing needs an order of the rows but no second table of them."""
    C = collocations
    r = np.random.default_rng(2)
    names = np.array([b"."] + [b"w%d" % i for i in range(500)], dtype=object)
    columns = [r.integers(1, 500, 400_000).astype(np.int32) for _ in range(C.MAX_WORDS + 1)]
    slot = r.integers(0, 40, 400_000)
    tracemalloc.start()
    rows = pd.DataFrame(list(C._packed(slot, columns, None, names, "s")),
                        columns=["slot", "kind", "n", "words", "ids", "weights"])
    packed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    sent = tracemalloc.get_traced_memory()[0]
    found, table, weights = C._unpacked(rows)
    unpacked = tracemalloc.get_traced_memory()[1] - sent
    tracemalloc.stop()
    assert weights is None and table.shape == (C.MAX_WORDS + 1, 400_000)
    was = np.stack([names[c] for c in columns])
    assert sorted(zip(*found[table].tolist())) == sorted(zip(*was.tolist()))
    assert packed < 36 * 400_000 and unpacked < 1.5 * table.nbytes, (packed / 4e5, unpacked / table.nbytes)

"""The operators against brute force on small tables with nulls, copies, ties and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsreliability.llm import (decontaminate, license_scan, line_dedup, packing, pii, quality_rules,
                                queries, sharding, simhash, substring_dedup, toxicity)

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "Same text here again"), (5, "same TEXT here again"),
        (5, "same TEXT here again"), (6, LONG), (7, LONG + " tail"), (8, f"a b c {PASSAGE} d e"),
        (9, f"x {PASSAGE} y {PASSAGE} z"), (None, f"none {PASSAGE}"), (None, None),
        (10, "A longer line of text\nshort\n  a LONGER line of text  \nother line here"),
        (11, "a longer line of text\nshort\nanother line")]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids and texts, and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", n, n) for n, (i, t) in enumerate(ROWS)],
                                 "doc_id long, text string, source string, k1 int, drop int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def given(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return d, {r.doc_id: r.text for r in d.collect()}


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def test_simhash_components(docs, empty, given):
    d = given[0].select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = simhash.simhash_groups(d, max_block=2).collect()
    assert len(got) == d.count() and simhash.simhash_groups(empty).count() == 0
    prints = sorted({r.fp for r in got})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                root[find(a)] = find(b)
    low = {}
    for r in got:
        if r.doc_id is not None:
            low[find(r.fp)] = min(low.get(find(r.fp), r.doc_id), r.doc_id)
    assert all(r.component_id == low.get(find(r.fp)) for r in got)


def test_large_blocks_lose_no_link(spark):
    near = {(1 << i) | (1 << j) for i in range(12) for j in range(i, 12)}
    prints = spark.createDataFrame([(p, n) for n, p in enumerate(near)], "fp long, id long")
    for limit in (2, 1000):
        roots = simhash.components(simhash.links_exact(prints, 2, limit)).collect()
        assert len({r.root for r in roots}) == 1 and len(roots) == len(near) - 1


def test_near_duplicates_keep_one(spark):
    base = [f"tok{i}" for i in range(300)]
    texts = [base] + [base[:k] + ["changed"] + base[k + 1:] for k in (20, 90, 150, 222)]
    other = [f"other{i}" for i in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, other])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5]


def test_large_blocks_of_near_copies_give_the_same_groups(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(3):  # chains: each text changes the one before in a few places
        w = [f"g{g}t{i}" for i in range(200)]
        for _ in range(40):
            w[r.integers(200)] = f"new{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [sorted(x.doc_id for x in simhash.drop_near_duplicates(docs, max_block=m).collect())
            for m in (3, 1000)]
    assert kept[0] == kept[1] and {0, 40, 80} <= set(kept[0]) and len(kept[0]) < 12


def test_near_duplicates_with_repeated_phrases_follow_their_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 64)  # sets of more shingles are joined in pieces

    def text(tag, phrase, times, n=120):
        w, p = [f"{tag}{i}" for i in range(n)], [f"{phrase}{i}" for i in range(5)]
        return " ".join(w[:60] + p * times + w[60:])
    long = [f"l{i}" for i in range(700)]
    rows = [text("a", "p", 15), text("b", "p", 15), text("c", "p", 20), text("d", "p", 20),
            text("e", "q", 2), text("e", "q", 20), " ".join(long), " ".join(long + ["x y z"] * 20)]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    kept = []
    for i, s in enumerate(sets):
        if all(len(s & sets[k]) / len(s | sets[k]) < 0.8 for k in range(i)):
            kept.append(i)
    assert kept == [0, 1, 2, 3, 4, 6]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == kept


def test_pairs_just_above_the_threshold_are_found(spark):
    r, rows = np.random.default_rng(11), []
    while len(rows) < 100:
        n = int(r.integers(200, 600))
        w = [f"d{len(rows)}w{i}" for i in range(n)]
        v = list(w)
        for k in r.choice(n, n // 45, replace=False):
            v[k] = f"new{k}"
        a, b = ({tuple(x[i:i + 5]) for i in range(n - 4)} for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) < 0.84:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 50 <= len(kept) <= 52 and {x.doc_id for x in kept} >= set(range(0, 100, 2))


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing(docs, empty, given, group):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = given[0].select("doc_id", "text").unionByName(docs.select("doc_id", "text").filter("doc_id < 5"))
    got = packing.pack(d, group=group).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (ends - got.length == got.offset).all() and ends.max() <= 1024
    texts = given[1] | dict(ROWS[:4])
    for doc, part in got[got.doc_id > 4].groupby("doc_id"):
        ids = np.array(tok.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        part = part.sort_values("piece")
        assert part.length.sum() == len(ids) and (part.length[1:] == 1024).all()
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(part.start, part.length)] == list(part.ids_crc32)
    assert packing.pack(empty).count() == 0


def test_special_token_and_odd_spaces_encode_alike():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    for t in ("a <|endoftext|> b", "x  y\n\nz \n q", " é　漢字 it's 12 3", " lead", "trail ", "\n", "a\tb c"):
        want = np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.token_bytes(t, enc) == want


def test_long_runs_of_white_space_encode_alike():
    import public_tokenizers
    from tokenizers import Tokenizer
    path, n = public_tokenizers.path("byte_bpe_50k.json"), 2_000_000
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    for t in (" " * n + "x", "\n" * n, "a\t" + "\t" * n + " b  c", " \n\t\u3000" * (n // 8) + "y",
              "a" + " " * 20_000 + "<|endoftext|>" + "\t" * 20_000 + "\x1c" * 20_000 + " z"):
        want = np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.token_bytes(t, enc) == want


def test_packing_of_repeated_rows_and_long_runs(spark):
    rows = [(None, "one two three")] * 300 + [(7, "a b c d e f g h")] * 300 + [(1, " " * 1_500_000 + "x")]
    d = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, bin int, grp string")
    got = packing.pack(d.repartition(4), group=50).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (ends - got.length == got.offset).all() and ends.max() <= 1024
    assert (got.doc_id.isna().sum(), (got.doc_id == 7).sum()) == (300, 300)
    assert got[got.doc_id == 1].length.sum() == 1_500_001
    bound = packing.lower_bound(Counter(got.length.tolist()), 1024)
    assert bound <= got.sequence_id.nunique() <= bound + 12 + 1


def test_lower_bound_never_exceeds_packing():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = Counter(r.integers(1, 1024, 60).tolist())
        assert packing.lower_bound(sizes, 1024) <= len(packing.best_fit(sizes, 1024))
    assert packing.lower_bound(Counter({600: 5}), 1024) == 5


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(docs, batches=4).collect()}
    assert (10, ROWS[12][1]) in got and (11, "short\nanother line") in got and (1, "") in got
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(ROWS)


@pytest.mark.parametrize("named", [0, 1, 20, 50])
def test_line_dedup_with_many_null_ids(spark, named):
    rows = [(i if i < named else None, f"the same long line\nown line number {i // 2}") for i in range(60)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first int")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(d).collect())
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for x in t.split("\n"):
            first.setdefault(x, i)
    want = Counter()
    for i, t in rows:
        kept = [x for x in t.split("\n") if first[x] == i]
        want[(i, 2, 2 - len(kept), "\n".join(kept))] += 1
    assert got == want
    assert line_dedup.replace_lines(d).count() == len(rows)


def test_line_dedup_near_the_largest_id(spark):
    top = (1 << 63) - 1
    d = spark.createDataFrame([(top - i % 3, f"some long line {i % 2}") for i in range(12)], "doc_id long, text string")
    got = line_dedup.dedup_lines(d, batches=5)
    assert sorted({(top - r.doc_id, r.kept_text) for r in got.filter("n_dropped = 0").collect()}) == [
        (2, "some long line 0"), (2, "some long line 1")]


def test_substring_dedup(docs, empty, given):
    d = given[0].select("doc_id", "text").filter("doc_id > 20").unionByName(docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    key = lambda i: (1 << 63) if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), key(i))
    want = Counter()
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < key(i) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = substring_dedup.dedup_substrings(d).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_toxicity_held_out():
    r = np.random.default_rng(3)
    words = [f"plain{i}" for i in range(400)]
    texts, y = [], []
    for i in range(700):
        w = list(r.choice(words, 60))
        if i % 4 == 0:
            w[r.integers(60)] = r.choice(["vileword", "nastyword", "rottenword"])
        texts.append(" ".join(w))
        y.append(float(i % 4 == 0))
    net = toxicity.train(texts[:500], np.array(y[:500]))
    right = (toxicity.score_texts(net, texts[500:]) >= 0.5) == np.array(y[500:], bool)
    assert right.mean() > 0.95
    assert len(toxicity.score_texts(net, [None, "", "word"])) == 3
    assert toxicity.train([], np.zeros(0)).p["c"][0] < 0


def test_toxicity_scores_every_row(docs, empty):
    net = toxicity.train(["a", "b"], np.array([0.0, 0.0]))
    assert toxicity.score(docs, net).filter("score between 0 and 1").count() == len(ROWS)
    assert toxicity.score(empty, net).count() == 0


def test_license_scan(spark, docs, empty):
    text = "x All  Rights reserved. y; CC-BY 4 " + license_scan.TEMPLATES["mit"].replace("software", "soft ware", 1)
    got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_base, got.first_word, got.last_word) == (2, 1, 5)
    assert (got.base_labels, got.labels, got.score) == ("cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert license_scan.scan(docs).count() == len(ROWS) and license_scan.scan(empty).count() == 0


def test_sharding(docs, empty, given):
    got = sharding.shard(given[0].select("doc_id", "text").unionByName(docs.select("doc_id", "text"))).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(empty).count() == 0
    weights = list(range(sharding.SLOTS))
    old = sharding.rebalance(weights, 8)
    new = sharding.rebalance(weights, 9, old)
    assert all(b == 8 for a, b in zip(old, new) if a != b) and 8 in new


@pytest.mark.parametrize("block", [4 << 20, 50])
def test_decontamination(spark, docs, empty, block):
    items = spark.createDataFrame([(1, PASSAGE.upper()), (2, "Same, text"), (3, None), (4, "!!")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in
           decontaminate.hits(docs, items, block_bytes=block).collect()}
    assert {(8, 65, 60, ("1",)), (4, 4, 2, ("2",)), (1, 0, 0, ()), (2, 0, 0, ())} <= got
    assert decontaminate.hits(empty, items).count() == 0
    assert decontaminate.hits(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    span = decontaminate.hits(docs.filter("doc_id = 8"), items).first().spans[0]
    assert ROWS[8][1][span[0]:span[1]] == PASSAGE


def test_pii_base_and_contexts(spark, docs, empty):
    rows = [(i, f"please call number +1 (555) 010-{1000 + i} today") for i in range(12)]
    rows += [(50, "please call number 555-010-7777 today"), (51, "a@b.cc_x@y.zz 1.2.3.4.5 999.1.1.1"),
             (52, "card 4111 1111 1111 1111."), (53, "7" * 20_000), (54, None)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:19:31" and got[50].n_phone == 0
    assert got[51].n_email == 2 and got[51].n_ip == 1 and got[52].n_card == 1
    assert got[54].spans == "" and got[53].spans == ""
    assert pii.find(docs).count() == len(ROWS) and pii.find(empty).count() == 0


def test_pii_discovered_instances_and_second_numbers_make_patterns(spark):
    rows = [f"please call number +1 (555) 010-{1000 + i} today" for i in range(200)]
    rows += [f"please call number 555-010-{2000 + i} today" for i in range(30)]
    rows += [f"you reach desk 555-010-{2000 + i} today" for i in range(30)] + ["you reach desk 555-010-9999 today"]
    rows += [f"ring +1 (555) 011-{1000 + i} or +1 (555) 012-{1000 + i} now" for i in range(12)]
    rows += ["ring +1 (555) 013-1000 or 555-010-8888 now", f"we{' ' * 90}call number 555-010-7777"]
    rows += [f"in 2021 write +1 (555) 014-{1000 + i}" for i in range(12)] + ["in 2021 write 555-010-6666"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {rows[r.doc_id]: r.spans.split(",") for r in pii.find(d).collect()}
    assert got["you reach desk 555-010-9999 today"] == ["phone:15:27"]
    assert got["ring +1 (555) 013-1000 or 555-010-8888 now"] == ["phone:5:22", "phone:26:38"]
    assert got["in 2021 write 555-010-6666"] == ["phone:14:26"] and got[f"we{' ' * 90}call number 555-010-7777"] != [""]


def test_quality_rules(spark, docs, empty):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, "too short", "bad") for i in range(60)]
    rows += [(200, good, "bad"), (201, good, None), (202, "one two three " * 40, "fine")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(
        rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[100].kept and not got[200].kept and got[201].kept
    assert got[202].n_repeat_words == 120 and got[202].base_failed
    assert quality_rules.judge(docs).count() == len(ROWS) and quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        now = docs.count()
        assert now <= before
        before = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.select("doc_id").distinct().count() == before


def test_pipeline_takes_null_ids_copies_and_long_runs(spark):
    good = spark.read.parquet(f"{FOLDER}/documents.parquet")
    copies = good.limit(40)
    runs = good.limit(1).withColumn("text", F.concat(F.expr("repeat(' ', 1200000)"), "text"))
    odd = good.withColumn("doc_id", F.lit(None).cast("long")).unionByName(copies).unionByName(copies).unionByName(runs)
    for docs in (odd, good.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == good.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


def test_queries_give_each_document_once(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_simhash", "op4_substring_dedup", "op9_pii", "op10_quality_rules"):
        assert queries.QUERIES[name](spark, FOLDER).select(F.countDistinct("doc_id")).first()[0] == n

"""Near-duplicate groups by SimHash: pigeonhole blocks, Hamming check, components.

A fingerprint is ``width`` 64-bit words; a bit is set if over half the hashes of the text's word
shingles have it.  Distinct fingerprints are linked if they differ in at most ``max_bits`` bits.
Copies (equal fingerprints) are one node, whatever their number.

* **One word** (``links_exact``).  The 64 bits are cut into ``max_bits + KEEP`` pieces.  Two
  fingerprints within ``max_bits`` bits agree on at least ``KEEP`` whole pieces, so each choice of
  ``KEEP`` pieces is a block key and every close pair shares a block.  Blocks of up to
  ``max_block`` fingerprints verify their pairs.  Larger ones would give a square number of pairs:
  their members emit all values within r = max_bits / 2 bits instead.  Two fingerprints are within
  2r bits exactly if these balls meet, so linking each member to the smallest one of every ball
  centre loses no connection.
* **Several words** (``roots_wide``).  A similarity of 0.8 lets 15 % of the bits differ, more than
  any pigeonhole can promise with selective keys.  Each distinct shingle votes once.  Every word
  gives its own blocks, so that close pairs have many chances to share one.  The Hamming distance
  over all words only sorts out candidates; a pair is linked by the exact Jaccard similarity of its
  shingle sets (``alike``).  At first each member is held against the first member of a block that
  it shares most blocks with, which joins most of a group; pairs across the groups that are left
  are all verified.  Recall against exact similarity is named in the README.
* **Components** are found on the numbers of distinct fingerprints with alternating star
  contractions, each round written to the shared checkpoint folder; one row a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from opsreliability.llm.common import narrow
from opsreliability.session import materialise

SEED = 42
#: Whole pieces that make one block key.
KEEP = 2
#: Hashes of a shingle set in one row: larger sets are cut by hash, into a power of two.
PART = 8192
#: Shingles hashed at a time: bounds the memory that a very long text takes.
CHUNK = 255 << 8


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """``width`` words per hash: the hash itself, then remixed copies."""
    out = np.empty((len(h), width), dtype="<u8")
    out[:, 0] = h
    for k in range(1, width):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _shingles(text: str | None, words: int) -> tuple[int, Iterator[int]]:
    """Number of shingles and their hashes: the whole text if it has fewer words, none without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0, iter(())
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return max(1, len(w) - words + 1), map(xxh64_intdigest, grams, repeat(SEED))


def _voted(n: int, part, width: int) -> list[int]:
    """Words whose bits are set in over half of ``n`` hashes; ``part(at, count)`` gives some of them."""
    votes = np.zeros(64 * width, dtype=np.int64)
    step = 255 * max(1, CHUNK // 255 // width)
    for at in range(0, n, step):
        h = _mixed(part(at, min(step, n - at)), width)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            votes += bits[row:row + 255].sum(0, np.uint8)
    return np.packbits(2 * votes > n, bitorder="little").view("<i8").tolist()


def fingerprint_of(text: str | None, words: int, width: int = 1) -> list[int]:
    """SimHash of one text as signed 64-bit words; zeros without words."""
    n, hashes = _shingles(text, words)
    return _voted(n, lambda at, count: np.fromiter(hashes, dtype="<u8", count=count), width)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    n, hashes = _shingles(text, words)
    return np.unique(np.fromiter(hashes, dtype="<u8", count=n))


def set_print(text: str | None, words: int, width: int) -> list[int]:
    """SimHash in which each distinct shingle votes once, then the size and the sum of the set: texts
    with equal lists have equal sets."""
    h = shingle_set(text, words)
    return [*_voted(len(h), lambda at, count: h[at:at + count], width), len(h),
            int(h.sum(dtype=np.uint64).view(np.int64))]


def fingerprints(text: Column, words: int, width: int = 1, of=fingerprint_of) -> Column:
    """SimHash of a text column as array<long>, in Arrow batches."""
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([of(t, words, width) for t in texts], dtype=object)

    return run(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pieces(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``count`` pieces of 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _blocks(nodes: DataFrame, words: Column, pieces: int) -> DataFrame:
    """Rows (key, size, first, id) of all blocks that hold two distinct fingerprints or more.

    A key is the number of word and choice, then the bits of the chosen pieces.  Keys and numbers are
    shuffled once: sizes are counted where the rows then lie, and joined there."""
    if pieces < 2 * KEEP:
        raise ValueError(f"{2 * KEEP} pieces at least, so that a key fits 64 bits")
    chosen = list(combinations(_pieces(pieces), KEEP))
    room = max(sum(n for _, n in c) for c in chosen)
    # one word a row, so that the plan does not grow with their number
    each = nodes.select("id", F.posexplode(words).alias("i", "w"))

    def key(n: int, choice) -> Column:
        value = F.lit(0).cast("long")
        for low, bits in choice:
            value = F.shiftleft(value, bits).bitwiseOR(
                F.shiftrightunsigned("w", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        return F.shiftleft(F.col("i").cast("long") * len(chosen) + n, room).bitwiseOR(value)

    keys = F.array(*[key(n, c) for n, c in enumerate(chosen)])
    rows = each.select("id", F.explode(keys).alias("key")).repartition("key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return rows.join(sizes.filter("size > 1"), "key")


def _numbered(prints: DataFrame) -> DataFrame:
    """(fp, id): every distinct fingerprint with a number of its own, written so that it stays."""
    return materialise(prints.select("fp").distinct().withColumn(
        "id", F.monotonically_increasing_id()), "simhash-nodes")


def _pairs_inside(blocks: DataFrame, near) -> DataFrame:
    """Close pairs of small blocks.  A block is one row with its bounded list of members."""
    lists = blocks.groupBy("key").agg(F.collect_list(F.struct("id", "fp")).alias("m"))
    return lists.select(F.explode("m").alias("x"), "m").select(
        "x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x.id")) & near(y["fp"], F.col("x.fp"))))
        .alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def links_exact(nodes: DataFrame, max_bits: int = 2, max_block: int = 32) -> DataFrame:
    """Links (a, b), a < b, between the numbers ``id`` of distinct long ``fp`` within an even
    ``max_bits``: all close pairs of small blocks, and for the members of larger ones links that
    connect the same groups."""
    if max_bits % 2:
        raise ValueError("balls meet exactly within an even number of bits")
    blocks = materialise(_blocks(nodes, F.array("fp"), max_bits + KEEP).join(nodes, "id"),
                         "simhash-blocks")
    inside = _pairs_inside(blocks.filter(F.col("size") <= max_block),
                           lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits)
    flips = [_signed(sum(1 << b for b in bits)) for r in range(max_bits // 2 + 1)
             for bits in combinations(range(64), r)]
    members = blocks.filter(F.col("size") > max_block).select("id", "fp").distinct()
    balls = materialise(members.select("id", F.explode(F.transform(
        F.array(*map(F.lit, flips)), lambda x: x.bitwiseXOR(F.col("fp")))).alias("at")),
        "simhash-balls")
    centres = (balls.groupBy("at").agg(F.min("id").alias("a"), F.max("id").alias("z"))
               .filter("a < z").select("at", "a"))
    star = balls.join(centres, "at").filter("id > a").select("a", F.col("id").alias("b"))
    return inside.unionByName(star).distinct()


def _set_rows(words: int, part: int):
    """(id, text) to rows (id, lv, p, hs): the set in ``lv`` rows of about ``part`` hashes, and in half as
    many, so that sets whose sizes differ by less than a factor of two have a cut in common."""
    def cut(i: int, h: np.ndarray) -> Iterator[tuple]:
        most = 1 << max(0, -(-len(h) // part) - 1).bit_length()
        for lv in sorted({most, max(1, most // 2)}):
            of = (h % np.uint64(lv)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            for p, hs in enumerate(np.split(h[order], np.searchsorted(of[order], np.arange(1, lv)))):
                yield i, lv, p, hs.view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                for row in cut(i, shingle_set(t, words)):
                    rows.append(row)
                    held += len(row[3]) + 1
                    if held > 1 << 20:
                        yield pd.DataFrame(rows, columns=["id", "lv", "p", "hs"])
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["id", "lv", "p", "hs"])

    return run


def alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, size_at: int,
          least: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of ``least`` or more.

    ``texts`` has k1, k2 and text, ``nodes`` the size of each set at ``size_at`` in ``fp``.  Sets are built
    anew from the texts of the pairs alone; those of long texts are joined and counted in pieces."""
    rows_less = F.ceil(F.col("n") / PART) - 1
    sized = nodes.select("id", "who", F.get("fp", F.lit(size_at)).alias("n")).withColumn(
        "lv", F.pow(F.lit(2), F.when(rows_less > 0, F.length(F.bin(rows_less))).otherwise(0)).cast("int"))
    named = pairs
    for c in ("a", "b"):
        named = named.join(sized.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"),
                                        F.col("lv").alias(f"lv{c}")), c)
    named = materialise(named.filter(F.least("na", "nb") >= least * F.greatest("na", "nb")).select(
        "a", "b", "na", "nb", F.least("lva", "lvb").alias("lv")), "simhash-pairs")
    used = named.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = sized.join(used, "id").select("id", "who.k1", "who.k2")
    # rows that repeat id and text share their key
    source = texts.join(keys, ["k1", "k2"]).select("id", "text").dropDuplicates(["id"])
    sets = materialise(source.mapInPandas(_set_rows(words, PART), "id long, lv int, p int, hs array<long>"),
                       "simhash-sets")
    common = (named.join(sets.select(F.col("id").alias("a"), "lv", "p", F.col("hs").alias("ha")), ["a", "lv"])
              .join(sets.select(F.col("id").alias("b"), "lv", "p", F.col("hs").alias("hb")), ["b", "lv", "p"])
              .groupBy("a", "b", "na", "nb")
              .agg(F.sum(F.size(F.array_intersect("ha", "hb"))).alias("both")))
    return common.filter(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= least).select("a", "b")


def roots_wide(nodes: DataFrame, width: int, max_bits: int, linked, pieces: int = 5,
               max_block: int = 32) -> DataFrame:
    """(id, root) of every distinct array ``fp``: groups of what the pairs in common blocks connect
    that are within ``max_bits`` of all bits and that ``linked`` (rows a, b to rows a, b) confirms.

    Each member is held against the first member of a block, and against the member that lies in the
    most and largest blocks, choosing those with which it shares most blocks.  That joins most of a group of copies at little cost.  After that only pairs of different
    groups matter.  Blocks of up to ``max_block`` verify all of those; in a larger one, members
    outside the block's largest group are held against all others of the block that are not in
    their own group.  What they link are groups, so only the numbers of groups are contracted
    once more.
    """
    def close(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("id").alias(c), F.col("fp").alias(f"f{c}")), c)
        bits = F.zip_with(F.slice("fa", 1, width), F.slice("fb", 1, width),
                          lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return pairs.filter(F.aggregate(bits, F.lit(0), lambda n, x: n + x) <= max_bits).drop("fa", "fb")

    blocks = materialise(_blocks(nodes, F.slice("fp", 1, width), pieces), "simhash-blocks")
    # the text that others were made from lies in the most and largest blocks of its group
    weight = blocks.groupBy("id").agg(F.sum("size").alias("weight"))
    central = (blocks.join(weight, "id").groupBy("key")
               .agg(F.max_by("id", F.struct("weight", "id")).alias("central")))

    def best(rows: DataFrame, other: str) -> DataFrame:
        """Each member with the one ``other`` of its blocks with which it shares most of them."""
        return (rows.filter(F.col(other) != F.col("id")).groupBy(other, "id").agg(F.count("*").alias("c"))
                .groupBy("id").agg(F.max(F.struct("c", other)).alias("m"))
                .select(F.least(f"m.{other}", "id").alias("a"), F.greatest(f"m.{other}", "id").alias("b")))

    nearest = best(blocks, "first").unionByName(best(blocks.join(central, "key"), "central")).distinct()
    roots = components(linked(close(nearest)))
    placed = materialise(nodes.select("id").join(roots, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("root", "id").alias("root")), "simhash-placed")
    grouped = blocks.join(placed, "id")
    mixed = (grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .filter("low < high").select("key"))
    grouped = materialise(grouped.join(mixed, "key").select("key", "size", "id", "root"),
                          "simhash-grouped")
    lists = (grouped.filter(F.col("size") <= max_block).groupBy("key")
             .agg(F.collect_list(F.struct("id", "root")).alias("m")))
    inside = lists.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter(
        "m", lambda y: (y["id"] > F.col("x.id")) & (y["root"] != F.col("x.root")))).alias("y")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = grouped.filter(F.col("size") > max_block).drop("size")
    main = (large.groupBy("key", "root").agg(F.count("*").alias("c"))
            .groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main")))
    outside = large.join(main, "key").filter("root <> main").select(
        "key", "main", F.col("id").alias("o_id"), F.col("root").alias("o_root"))
    # a pair of two members outside the largest group is seen once, from its larger number
    across = (outside.join(large, "key")
              .filter("root <> o_root and (root = main or id < o_id)")
              .select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")))
    rest = linked(close(inside.unionByName(across).distinct()))
    for c in ("a", "b"):
        rest = rest.join(placed.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c)
    rest = rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    merged = components(rest).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return placed.join(merged, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(best, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    best = edges.groupBy("b").agg(F.min("a").alias("m"))
    rest = (edges.join(best, "b").filter("a <> m")
            .select(F.col("m").alias("a"), F.col("a").alias("b")))
    return rest.unionByName(best.select(F.col("m").alias("a"), "b")).distinct()


def _not_stars(edges: DataFrame) -> DataFrame:
    """Nodes that have two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("a").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .filter("up > 1 or (up = 1 and down = 1)"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a < b) but roots.

    Done when every component is a star: then its centre is its smallest node."""
    edges = materialise(edges, "simhash-edges")
    while _not_stars(edges).take(1):
        edges = materialise(_small_star(_large_star(edges)), "simhash-edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint; the root is a number."""
    return nodes.join(components(links), F.col("id") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "id").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = 3, max_bits: int = 2, max_block: int = 32) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long), component_id (smallest id of its group).

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any
    other.  A group of rows without ids has a null component_id.  Repeated rows and ids come back
    as often as they went in.  An empty table gives no rows; other columns are not looked at.
    """
    d = narrow(docs, id_col, text_col)
    prints = materialise(d.select("doc_id", fingerprints(F.col("text"), words)[0].alias("fp")),
                         "simhash-prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = _numbered(prints)
    placed = materialise(firsts.join(_grouped(nodes, links_exact(nodes, max_bits, max_block)), "fp"),
                         "simhash-placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words: int = 5, width: int = 32, max_differing: float = 0.2,
                         pieces: int = 5, max_block: int = 32, least: float = 0.8) -> DataFrame:
    """Keep one row of each near-duplicate group, with all its columns.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``least`` or more.  Only
    pairs that share a block and differ in at most ``max_differing`` of the bits are held against each
    other: 0.15 is the angle of two equally large sets with a similarity of 0.8, and 0.2 leaves it room.
    The blocks of 32 words reach nearly all pairs from 0.8 on (recall by band: README).  The row with the smallest id stays, rows without an id coming last; of
    repeated ids the one with the smallest text hash; of wholly repeated rows one.  Null and empty
    texts are copies of each other.
    """
    names = docs.columns
    d = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                    *[docs[c].alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text"))])
    keyed = narrow(d, "doc_id", "text")
    prints = materialise(keyed.select(
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("who"),
        fingerprints(F.col("text"), words, width, set_print).alias("fp")), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("who").alias("who")).withColumn(
        "id", F.monotonically_increasing_id()), "simhash-nodes")
    groups = roots_wide(nodes, width, int(max_differing * 64 * width),
                        lambda pairs: alike(pairs, nodes, keyed.select("k1", "k2", "text"), words, width, least),
                        pieces, max_block)
    stay = (nodes.select("id", "who").join(groups, "id").groupBy("root").agg(F.min("who").alias("who"))
            .select("who.k1", "who.k2"))
    key = {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")}
    kept = d.withColumns(key).join(stay, ["k1", "k2"])
    twice = (prints.groupBy("who.k1", "who.k2").count().filter("count > 1").select("k1", "k2"))
    once = kept.join(twice, ["k1", "k2"], "left_anti").select("row.*")
    many = (kept.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2")
            .agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))
    return once.unionByName(many)

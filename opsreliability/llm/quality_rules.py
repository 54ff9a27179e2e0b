"""Quality rules with host verdicts, in DataFrame functions only.

Every text is measured in one projection (no shuffle of texts).  Failures of each rule are added
up by host; a host's failure rate is shrunk towards the rate of all hosts by a beta prior fitted
to the hosts' own rates; hosts whose shrunk rate is too high for some rule are rejected, and the
verdict is joined back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsreliability.llm.common import SPACES, let, narrow
from opsreliability.session import materialise

#: Rules by name, over the measures of one document.  Each gives true (fails) or false.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)",
    "dup_lines": "n_lines > 0 and 100 * n_dup_lines > 30 * n_lines",
}
#: Copies of each host's verdict in the join, so that no host is one task.
SALTS = 16


def _repeat_words(grams: Column, n: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more.

    Most texts repeat nothing, which the sorted hashes show; only the others sort the windows
    with their places.
    """
    def covered(pairs: Column) -> Column:
        def same(i: Column, by: int) -> Column:
            return F.coalesce(F.get(pairs, i + by)["h"] == F.get(pairs, i)["h"], F.lit(False))

        hits = F.sort_array(F.transform(
            F.filter(pairs, lambda x, i: same(i, 1) | same(i, -1)), lambda x: x["at"]))
        return let(hits, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    def any_twice(s: Column) -> Column:
        return F.exists(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
                                   lambda x, y: x == y), lambda x: x)

    return let(grams, lambda g: F.when(
        let(F.sort_array(g), any_twice),
        let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), covered),
    ).otherwise(0))


def _measures(text: Column) -> Column:
    """All measures of one text as a struct."""
    spaces = "[\\x20\\x09-\\x0D]+"

    def of_words(w: Column) -> Column:
        n = F.size(w)
        # the words of a window are joined by a byte that no word contains
        grams = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(
            F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))
        return F.struct(n.alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
                        _repeat_words(grams, n).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = F.filter(F.split(text, spaces), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
                    F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("n_symbols"))


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: key, doc_id, host and the measures; a null text has no words and no lines."""
    d = docs.select(*[docs[c].cast(t).alias(a) for c, a, t in
                      ((id_col, "doc_id", "long"), (text_col, "text", "string"), (host_col, "host", "string"))])
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "host",
                 F.xxhash64("doc_id", "text").alias("k1"),
                 F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))
    m = d.select("k1", "k2", "doc_id", "host", _measures(F.col("text")).alias("m"))
    return m.select("k1", "k2", "doc_id", "host", *[
        F.col(f"m.{c}").cast("long").alias(c.rpartition(".")[2]) for c in
        ("w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")])


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(host, n, rule, rate): shrunk failure rate of each rule by host.

    The prior is a beta distribution with the mean and variance of the hosts' own rates (method of
    moments); where the hosts do not differ it is as strong as the largest host.  Documents
    without a host form no host.
    """
    sums = measured.filter("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.expr(f"cast({r} as int)")).alias(k) for k, r in rules.items()])
    counts = sums.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("bad")) for k in rules])).alias("r"))
    counts = counts.select("host", "n", "r.rule", "r.bad", (F.col("r.bad") / F.col("n")).alias("raw"))
    prior = counts.groupBy("rule").agg(F.avg("raw").alias("mean"), F.var_pop("raw").alias("var"),
                                       F.max("n").alias("most"))
    strength = F.when(F.col("var") > 0, F.greatest(
        F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(0.0))).otherwise(F.col("most"))
    prior = prior.select("rule", "mean", strength.alias("k"))
    return counts.join(prior, "rule").select(
        "host", "n", "rule", ((F.col("bad") + F.col("mean") * F.col("k"))
                              / (F.col("n") + F.col("k"))).alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", max_rate: float = 0.9) -> DataFrame:
    """Per row: key, doc_id, host, measures, base_failed, host_rejected, kept.

    A document is kept unless it fails the base rule or its host's shrunk failure rate of some
    rule is above ``max_rate``.  Null and empty texts have no words and fail.  Rows without a host
    are judged by the base rule alone.  Ties of host rates cannot matter: each host is judged for
    itself.  Repeated rows are counted and judged each.
    """
    measured = materialise(measure(docs, id_col, text_col, host_col), "quality-measures")
    bad = (host_rates(measured, RULES).filter(F.col("rate") > max_rate)
           .select("host").distinct())
    copies = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = measured.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
    out = salted.join(copies.withColumn("host_rejected", F.lit(True)), ["host", "salt"], "left")
    return (out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
            .withColumn("base_failed", F.expr(RULES["base"]))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("salt"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              host_col: str = "source", max_rate: float = 0.9) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; repeated rows stay repeated."""
    good = judge(docs, id_col, text_col, host_col, max_rate).filter("kept").select("k1", "k2").distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"),
                       docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    keyed = rows.select("row", F.xxhash64("i", "t").alias("k1"),
                        F.xxhash64(F.lit(7), "t", "i").alias("k2"))
    return keyed.join(good, ["k1", "k2"], "left_semi").select("row.*")

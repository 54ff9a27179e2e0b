"""Personal data: fixed patterns, and identifiers found by their contexts; DataFrame functions only.

The fixed patterns give the base spans, which are the seeds.  Candidates are runs of words with a
digit or an at sign; the two words before one are its lexical pattern, in which earlier runs count as
one word ``OTHER`` each.  Patterns and instances form a graph that is scored in rounds: a pattern is
worth the mean score of its instances (shrunk by ``DOUBT`` instances of no worth), an instance the best
of its patterns, seeds stay at 1.  Instances of ``ACCEPT`` or more count as seeds of further patterns, and
rounds go on until no more are accepted.  Their candidates become spans of the kind that their
pattern stands for.

Every text is read once.  The graph holds distinct (pattern, instance) edges, added up before each
shuffle; both its tables grow with the candidates, not with the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsreliability.llm.common import ascii_lower, let, narrow
from opsreliability.session import materialise

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns, with quantifiers made possessive where no shorter match can succeed, so that
#: long runs neither backtrack nor recurse.  An address starts where a run of its characters starts
#: or right after the last address.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_S = r"\x20\x09-\x0D"
_TOKEN = rf"[^{_S}0-9@]*+[0-9@][^{_S}]*+"
#: A run of words that each have a digit or an at sign.
CANDIDATE = rf"(?<![^{_S}]){_TOKEN}(?:[{_S}]++{_TOKEN})*+"
#: Characters before a candidate in which its pattern is looked for first; all are if that shows too few words.
NEAR = 80
#: What stands for an earlier run in a pattern: no other word there has a digit.
OTHER = "0"
#: Digits that a candidate without an at sign must have.
LEAST_DIGITS = 6
#: Least rounds of scoring, worthless instances added to each pattern, seeds a pattern needs, and the
#: score from which a candidate is taken.
ROUNDS, DOUBT, SEEDS, ACCEPT = 3, 1.0, 3, 0.75


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's digits is a multiple of 10."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(m)).between(9, 15)


def _last_words(p: Column) -> Column:
    """The last words of a text, two at least if it has them."""
    def words(x: Column) -> Column:
        return F.filter(F.split(x, rf"[{_S}]+"), lambda w: w != "")

    return let(words(F.right(p, F.lit(NEAR))), lambda near: F.when(
        (F.size(near) > 2) | (F.length(p) <= NEAR), near).otherwise(words(p)))


def _placed(text: Column, pattern: str, keep, context: bool = False) -> Column:
    """Matches as structs (start, end, m, before): leftmost, not overlapping, in code points.

    Splitting at the pattern gives the text between its matches, so places are running sums.  With
    ``context``, ``before`` has the last two words before a match, earlier matches being ``OTHER``."""
    def last_two(words: Column) -> Column:
        return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))

    def places(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        both = F.zip_with(between, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        none = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("tail"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["p"])
            end = start + F.length(x["m"])
            if not context:
                one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.lit("").alias("before"))
                return F.struct(end.alias("at"), a["tail"].alias("tail"), F.when(
                    keep(x["m"]), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

            def with_words(words: Column) -> Column:
                one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"),
                               F.array_join(words, " ").alias("before"))
                return F.struct(end.alias("at"), last_two(F.concat(words, F.array(F.lit(OTHER)))).alias("tail"),
                                F.when(keep(x["m"]), F.concat(a["out"], F.array(one))).otherwise(a["out"])
                                .alias("out"))

            return let(last_two(F.concat(a["tail"], _last_words(x["p"]))), with_words)

        paired = F.filter(both, lambda x: x["m"].isNotNull())
        return F.when(F.size(matches) > 0, F.aggregate(paired, state, step)["out"]).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, base, seen): base spans (start, kind, end) and candidates of each row."""
    d = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    span = "array<struct<start:int,kind:int,end:int>>"

    def of_kind(i: int, kind: str) -> Column:
        return F.transform(_placed(F.col("text"), PATTERNS[kind], lambda m: _valid(kind, m)),
                           lambda s: F.struct(s["start"], F.lit(i).alias("kind"), s["end"])).cast(span)

    base = [of_kind(i, kind) for i, kind in enumerate(KINDS)]

    def like(m: Column) -> Column:
        return m.contains("@") | (F.length(_digits(m)) >= LEAST_DIGITS)

    return d.select("k1", "k2", "doc_id", F.sort_array(F.concat(*base)).alias("base"),
                    _placed(F.col("text"), CANDIDATE, like, context=True).alias("seen"))


def candidates(found: DataFrame) -> DataFrame:
    """(k1, k2, start, end, instance, pattern, kind): ``kind`` is null for unknown ones.

    The two words before are the pattern; candidates without two words before them have none."""
    c = found.select("k1", "k2", "base", F.explode("seen").alias("c"))
    touch = F.filter("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    before = F.regexp_extract(ascii_lower(F.col("c.before")), rf"([^{_S}]+[{_S}]+[^{_S}]+)[{_S}]*$", 1)
    return c.select("k1", "k2", F.col("c.start").alias("start"), F.col("c.end").alias("end"),
                    ascii_lower(F.regexp_replace("c.m", rf"[{_S}]+", " ")).alias("instance"),
                    F.regexp_replace(before, rf"[{_S}]+", " ").alias("pattern"),
                    F.get(touch, 0)["kind"].alias("kind"))


def score_instances(cands: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of unknown instances of ``ACCEPT`` or more: one row each, the best kind.

    After ``rounds`` rounds it goes on as long as a round accepts more instances than any before."""
    edges = materialise(cands.filter("pattern <> ''").groupBy("pattern", "instance")
                        .agg(F.max("kind").alias("kind")), "pii-edges")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).select(
        "instance", "kind", F.lit(1.0).alias("score"))
    seeds = materialise(seeds, "pii-seeds")
    state = seeds
    done, most, more = 0, 0, True
    while done < rounds or more:
        worth = (edges.select("pattern", "instance").join(state, "instance").groupBy("pattern", "kind")
                 .agg(F.sum("score").alias("mass"), F.sum((F.col("score") >= ACCEPT).cast("int")).alias("seeds"))
                 .filter(F.col("seeds") >= SEEDS).join(degree, "pattern")
                 .select("pattern", "kind", (F.col("mass") / (F.col("n") + DOUBT)).alias("worth")))
        fresh = (edges.filter("kind is null").join(worth.withColumnRenamed("kind", "as_kind"), "pattern")
                 .groupBy("instance").agg(F.max(F.struct("worth", (-F.col("as_kind")).alias("k"))).alias("b"))
                 .select("instance", (-F.col("b.k")).alias("kind"), F.col("b.worth").alias("score")))
        fresh = fresh.join(seeds.select("instance"), "instance", "left_anti")
        state = materialise(seeds.unionByName(fresh), "pii-round")
        accepted = state.filter(F.col("score") >= ACCEPT).count()
        done, most, more = done + 1, max(most, accepted), accepted > most
    return state.join(seeds.select("instance"), "instance", "left_anti").filter(F.col("score") >= ACCEPT)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and base (array).

    Spans are kind:start:end in code points, by start, then kind.  Null and empty texts have none.
    Candidates that touch a base span add nothing.  Repeated rows stay repeated.
    """
    found = materialise(parsed(docs, id_col, text_col), "pii-found")
    cands = materialise(candidates(found), "pii-candidates")
    taken = score_instances(cands, rounds).select("instance", F.col("kind").alias("as_kind"))
    new = (cands.filter("kind is null and pattern <> ''").join(taken, "instance")
           .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", F.col("as_kind").alias("kind"), "end"))
                                    .alias("new")))
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i))

    span = "array<struct<start:int,kind:int,end:int>>"
    every = F.sort_array(F.array_union("base", F.coalesce(F.col("new").cast(span), F.array().cast(span))))
    return found.drop("seen").join(new, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"), "base")

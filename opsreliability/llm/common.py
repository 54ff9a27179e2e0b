"""Small column helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space of the word definitions: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ids that are null count as one document after all others.
LAST_ID = (1 << 63) - 1


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a projected expression into a lambda, where it would be evaluated for
    every element; a one-element array binds it to a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id, text and the key of a row; other columns, whatever their names, stay outside.

    The key (two 64-bit hashes over id and text) is never null.  Rows that repeat both share it:
    they have equal results, so a join on the key gives each of them its own row.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"),
                    docs[text_col].cast("string").alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"),
                    F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))


def result(docs: DataFrame, **kinds: str) -> DataFrame:
    """Cast columns to the types a contract names."""
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])



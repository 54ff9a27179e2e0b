"""Scalar expressions.

All of them are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- numbers

def round_away(x: ColumnOrName, digits: int = 0) -> Column:
    """Round half away from zero on the binary value of ``x``.

    Spark's own ``round`` goes through the decimal text of the double and so moves some ties;
    this form gives the same bits in every engine.  Values too large to carry the digits are
    returned as they are.
    """
    x = _c(x).cast("double")
    scale = float(10 ** digits)
    rounded = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    return (F.when(F.abs(x) < 0.5 / scale, F.lit(0.0))
            .when(F.abs(x) < 4.0e15 / scale, rounded)
            .otherwise(x))


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NULL when b is zero or NULL."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


def logit(p: ColumnOrName, eps: float) -> Column:
    """ln(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    p = _c(p)
    q = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps)))
    return F.ln(q / (1.0 - q))


def flag(pred: Column) -> Column:
    return pred.cast("int")


def to_int(text: ColumnOrName) -> Column:
    """Integer from text, NULL when it is no number; decimals round."""
    text = _c(text)
    return F.coalesce(text.try_cast("int"), F.round(text.try_cast("double")).try_cast("int"))


# ---------------------------------------------------------------- text and keys

def code(text: ColumnOrName) -> Column:
    """Trimmed upper-case code."""
    return F.upper(F.trim(_c(text)))


def blank_to_null(text: ColumnOrName) -> Column:
    return F.nullif(_c(text), F.lit(""))


def key(*cols: ColumnOrName, sep: str = "-") -> Column:
    """Concatenated key, NULL when any part is NULL."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(_c(c).cast("string"))
    return F.concat(*parts)


def row_id(*cols: ColumnOrName) -> Column:
    """128-bit row id as text.

    64-bit hashes start to collide at a few billion rows, which a duplicate check would report
    as false duplicates, so the wide hash is the default at scale.
    """
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols]).cast("binary"))


def row_id64(*cols: ColumnOrName) -> Column:
    """64-bit row id, cheaper, for tables below about a billion rows."""
    return F.xxhash64(*[_c(c) for c in cols])


def hash_number(text: ColumnOrName, digits: int = 7) -> Column:
    """First hex digits of the md5 as a number; the same in every engine."""
    return F.conv(F.substring(F.md5(_c(text).cast("binary")), 1, digits), 16, 10).cast("bigint")


def fold(text: ColumnOrName, folds: int) -> Column:
    return (hash_number(text) % folds).cast("int")


# ---------------------------------------------------------------- time

def hhmm_to_minute(hhmm: ColumnOrName) -> Column:
    """Minute of day; 2400 means the last minute of the day."""
    h = _c(hhmm)
    return F.least(F.floor(h / 100).cast("int") * 60 + h % 100, F.lit(1439))


def hhmm_to_hour(hhmm: ColumnOrName) -> Column:
    return F.least(F.floor(_c(hhmm) / 100).cast("int"), F.lit(23))


def at_minute(day: ColumnOrName, minute: ColumnOrName) -> Column:
    """Wall-clock timestamp of a minute of the day."""
    return (_c(day).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), _c(minute), F.lit(0)))


def iso_weekday(day: ColumnOrName) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(_c(day)) + 1


def month_key(day: ColumnOrName) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def date_key(day: ColumnOrName) -> Column:
    return F.date_format(_c(day), "yyyyMMdd").cast("int")


# ---------------------------------------------------------------- decoding and banding

def decode(x: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Simple CASE; unlisted values give NULL."""
    out = None
    for k, v in mapping.items():
        cond = _c(x) == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def band(x: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge that x is below; the last label otherwise."""
    out = None
    for e, lab in zip(edges, labels):
        cond = _c(x) < e
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.otherwise(labels[len(edges)])


def split_label(day: ColumnOrName, train_end: str, valid_end: str) -> Column:
    d = _c(day)
    return (F.when(d <= F.lit(train_end).cast("date"), "train")
            .when(d <= F.lit(valid_end).cast("date"), "valid")
            .otherwise("test"))


def day_span(day: ColumnOrName) -> Column:
    """Days covered, both ends included (aggregate)."""
    return F.datediff(F.max(_c(day)), F.min(_c(day))) + 1


def gap_rate(x: ColumnOrName, where: Column) -> Column:
    """Average of x over the rows that satisfy ``where`` (filtered aggregate)."""
    return F.avg(F.when(where, _c(x)))

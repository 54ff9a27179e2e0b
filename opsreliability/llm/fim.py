"""Fill-in-middle rearrangement of whole texts, cut between tokens.

A token is a run of other characters with the white space before it; white space at the end of a text
is a token of its own.  Each text gets a wavelet matrix over four character classes: white space or
not, and whether the character starts a run of its kind.  Its two bit levels are packed, with running
counts per block, so ``rank`` of a class up to any place is a look-up and a few popcounts.  A token
ends where a run of white space starts, and at the end of the text; the number of ends before a place
is therefore a combination of ranks, and the place of the k-th end is found by ``select``, which
bisects the block counts.  The classes are laid out a slice at a time, so beside the text itself a
task holds about two bytes a character, whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opsreliability.llm.common import SPACES, narrow

#: Marks of prefix, suffix and middle; a text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
SLICE = 1 << 20
#: Bytes of a packed level that share one running count.
BLOCK = 64
_KIND = np.zeros(128, dtype=np.uint8)
_KIND[[ord(c) for c in SPACES]] = 1
#: The class of a first white space after something else; the other three are 0, 1 and 2.
SPACE_START = 3


class _Level:
    """Packed bits with running counts of ones."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        self.packed = np.packbits(bits, bitorder="little")
        pad = np.zeros(-len(self.packed) % BLOCK, dtype=np.uint8)
        ones = np.bitwise_count(np.concatenate([self.packed, pad])).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def ones(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        block, rest = divmod(i, 8 * BLOCK)
        part = self.packed[block * BLOCK:block * BLOCK + -(-rest // 8)].copy()
        if rest % 8:
            part[-1] &= (1 << rest % 8) - 1
        return int(self.before[block]) + int(np.bitwise_count(part).sum())

    def one_at(self, k: int) -> int:
        """Place of the ``k``-th one, from 1: blocks by bisection, then one block."""
        block = int(np.searchsorted(self.before, k)) - 1
        part = np.unpackbits(self.packed[block * BLOCK:(block + 1) * BLOCK], bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(part)[k - int(self.before[block]) - 1])


class WaveletMatrix:
    """Classes 0 to 3 of a text's characters: the high bit, then the low bits of all places whose high
    bit is 0 followed by those whose high bit is 1."""

    def __init__(self, text: str):
        self.length = len(text)
        high, low = [], ([], [])
        last = 2  # neither kind: the first character starts a run
        for at in range(0, len(text), SLICE):
            codes = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            kind = np.where(codes < 128, _KIND[np.minimum(codes, 127)], 0).astype(np.uint8)
            starts = (kind != np.concatenate([[last], kind[:-1]])).astype(np.uint8)
            last = kind[-1]
            high.append(kind)
            for bit in (0, 1):
                low[bit].append(starts[kind == bit])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
        self.high = _Level(join(high))
        self.zeros = self.length - self.high.ones(self.length)
        self.low = _Level(join([*low[0], *low[1]]))

    def rank(self, symbol: int, i: int) -> int:
        """Places before ``i`` whose class is ``symbol``."""
        ones = self.high.ones(i)
        begin, end = (self.zeros, self.zeros + ones) if symbol >> 1 else (0, i - ones)
        hits = self.low.ones(end) - self.low.ones(begin)
        return hits if symbol & 1 else end - begin - hits

    def select(self, symbol: int, k: int) -> int:
        """Place of the ``k``-th character (from 1) of class ``symbol``, by bisection on ranks; for white
        space that starts a run, from the levels themselves."""
        if symbol == SPACE_START:
            below = self.low.one_at(self.low.ones(self.zeros) + k)
            return self.high.one_at(below - self.zeros + 1)
        low, top = 0, self.length
        while low < top:
            middle = (low + top) // 2
            low, top = (middle + 1, top) if self.rank(symbol, middle + 1) < k else (low, middle)
        return low

    def ends(self, i: int) -> int:
        """Tokens that end within the first ``i`` characters."""
        if i == 0:
            return 0
        lead = self.rank(SPACE_START, 1)  # white space that begins the text ends no token
        if i < self.length:
            return self.rank(SPACE_START, i + 1) - lead
        # at the end of the text its last run ends as well, white space or not
        return self.rank(SPACE_START, i) - lead + 1

    def cut(self, units: int) -> int:
        """Characters that the first ``units`` tokens take."""
        if units <= 0:
            return 0
        if units >= self.ends(self.length):
            return self.length
        return self.select(SPACE_START, units + self.rank(SPACE_START, 1))


def rearrange(text: str, doc_id: int | None, seed: int = 42, fim_percent: int = 50,
              spm_percent: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of prefix and middle, output) of one text."""
    matrix = WaveletMatrix(text)
    n = matrix.ends(matrix.length)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    one, two = (matrix.cut(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    p, s, m = MARKS
    if h[3] % 100 < spm_percent:
        return n, "spm", one, two - one, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", one, two - one, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given, from its output and form alone."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                   fim_percent: int = 50, spm_percent: int = 80, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256
    and, if asked for, output.

    A null text is empty and stays plain; n is 0.  A row's place in the draw depends on seed and id alone, so
    repeated rows have equal results; a null id draws as an empty one.  White space at the start of a text
    belongs to the first token; a text of white space is one token.  An empty table gives no rows; other columns, whatever
    their names, are not looked at.  No row leaves its partition.
    """
    fields = ("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
              "restored_sha256 string" + ", output string" * with_text)

    def digest(t: str) -> str:
        return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf(fields)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts):
                n, form, one, two, out = rearrange(t or "", int(i) if i else None, seed, fim_percent, spm_percent)
                rows.append((n, form, one, two, digest(out), digest(restore(out, form)), *[out] * with_text))
            names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            yield pd.DataFrame(rows, columns=names[:6 + with_text]).astype(
                {"prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids as text: a column of longs with nulls would reach pandas as floating point numbers
    d = narrow(docs, id_col, text_col)
    return d.select("doc_id", run(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")

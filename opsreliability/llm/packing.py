"""Packing documents into sequences: best-fit decreasing, certified by lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens.  Each group of pieces is packed by
best-fit decreasing; dual feasible functions give a lower bound on the bins any packing of the
group needs.  A group at its bound is certified and stays as it is.  A group with a gap keeps its
full bins and hands the documents of the others on; what groups hand on is dealt into fewer, mixed
groups and packed again.  At last the open bins of certified groups, too few to matter inside each,
meet in the same way.  Rounds are written to the shared folder, so a lost executor costs one group.

Inside a group pieces of one length are interchangeable, so a task packs counts of lengths and then
deals the pieces out: its memory is one group of ``GROUP`` pieces, whatever the table.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

from opsreliability.llm.common import narrow
from opsreliability.session import materialise

END = 2
CAPACITY = 1024
#: Pieces packed in one task.
GROUP = 50_000
#: Words remembered by a Python worker; beyond that they are encoded again.
REMEMBERED = 300_000
LONG_WORD = 60
#: Runs of white space that may form tokens across a space or a line feed.
_RUNS = re.compile(r"\s[ \n]|[ \n]\s")
#: White space as the token pattern knows it: a run this long is cut out before encoding.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 10_000
_LONG_RUNS = re.compile(SPACE + "{%d,}" % LONG_RUN)
END_OF_TEXT = "<|endoftext|>"
_WORDS: dict[str, bytes] = {}
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary beside the tokenizer file, with its special token recognised in
    texts as the file's own library does.  The tests hold its ids against that library."""
    if path not in _ENCODERS:
        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={END_OF_TEXT: 50256})
    return _ENCODERS[path]


def run_ids(run: str, enc: tiktoken.Encoding) -> bytes:
    """Ids of a text that is one token text of the pattern, whatever its length."""
    return np.array(enc._encode_single_piece(run), dtype="<u4").tobytes()


def token_bytes(text: str | None, enc: tiktoken.Encoding) -> bytes:
    """Ids as little-endian 32-bit numbers.

    No token crosses the place before a single space or line feed between two other characters,
    so words between such places are encoded for themselves and remembered.  Texts with other runs
    of white space are encoded whole.
    """
    def ids(s: str) -> bytes:
        return np.array(enc.encode(s, allowed_special="all"), dtype="<u4").tobytes()

    def runs(s: str) -> Iterator[bytes]:
        """The pattern takes a run of white space as one token text, but for its last character if
        another follows; matching long runs would overflow its stack, so they are cut out here."""
        at = 0
        for m in _LONG_RUNS.finditer(s):
            end = m.end() - (m.end() < len(s) and not s.startswith(END_OF_TEXT, m.end()))
            yield ids(s[at:m.start()])
            yield run_ids(s[m.start():end], enc)
            at = end
        yield ids(s[at:])

    if not text:
        return b""
    if _RUNS.search(text):
        return b"".join(runs(text))
    words = text.replace("\n", " \n").split(" ")
    first, words = words[0], words[1:]
    try:
        return ids(first) + b"".join(map(_WORDS.__getitem__, words))
    except KeyError:
        out = [ids(first)]
        for w in words:
            b = _WORDS.get(w)
            if b is None:
                b = ids(w if w[:1] == "\n" else " " + w)
                if len(_WORDS) < REMEMBERED and len(w) < LONG_WORD:
                    _WORDS[w] = b
            out.append(b)
        return b"".join(out)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """(k1, k2, doc_id, piece, start, length, ids_crc32): the pieces of every row."""
    d = narrow(docs, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for k1, k2, doc, text in zip(b.k1, b.k2, b.doc_id, b.text):
                ids = token_bytes(text, enc) + END.to_bytes(4, "little")
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append((k1, k2, None if pd.isna(doc) else int(doc), piece, at, size,
                                 zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, piece = at + size, piece + 1
            yield pd.DataFrame(rows, columns=["k1", "k2", "doc_id", "piece", "start", "length", "ids_crc32"]
                               ).astype({"doc_id": "Int64"})

    return d.mapInPandas(cut, "k1 long, k2 long, doc_id long, piece int, start long, length long, "
                              "ids_crc32 long")


def lower_bound(sizes: Counter, capacity: int) -> int:
    """Bins that any packing needs: the best of a family of dual feasible functions.

    For a threshold t up to half the capacity, sizes over capacity - t count as a whole bin, sizes
    below t as nothing, others as themselves; and the rounding functions for k parts give a size
    its share of k + 1 parts, rounded down.  Any function f with sum f <= 1 in every full bin
    bounds the bins by the sum over all pieces.
    """
    s = np.array(sorted(sizes), dtype=np.int64)
    n = np.array([sizes[x] for x in s], dtype=np.int64)
    if not len(s):
        return 0
    mass, count = np.concatenate([[0], np.cumsum(s * n)]), np.concatenate([[0], np.cumsum(n)])
    best = -(-int(mass[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        low, high = np.searchsorted(s, t), np.searchsorted(s, capacity - t, "right")
        best = max(best, -(-int((count[-1] - count[high]) * capacity + mass[high] - mass[low]) // capacity))
    for k in range(1, 33):
        x = (k + 1) * s
        value = np.where(x % capacity == 0, x // capacity * k, (x // capacity) * (k + 1))
        best = max(best, -(-int((value * n).sum()) // (k * (k + 1))))
    return best


def best_fit(sizes: Counter, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(i)
                bins[b].append(size)
            else:
                room, b = capacity, len(bins)
                bins.append([size])
            if left := room - size:
                if not by_room.get(left):
                    insort(rooms, left)
                by_room.setdefault(left, []).append(b)
    return bins


def _pack_group(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Bin and offset of every piece of one group; bin -1 for pieces handed on."""
    pdf = pdf.sort_values(["length", "k1", "k2", "piece", "number"], kind="stable").reset_index(drop=True)
    queues = {int(s): list(i)[::-1] for s, i in pdf.groupby("length", sort=False).groups.items()}
    sizes = Counter({s: len(i) for s, i in queues.items()})
    bins = best_fit(sizes, capacity)
    certified = len(bins) == lower_bound(sizes, capacity)
    spare = [i for i, b in enumerate(bins) if sum(b) < capacity]
    # a certified group hands on its emptiest bin only: others' open bins may fill it
    handed = set() if last else ({max(spare, key=lambda i: capacity - sum(bins[i]))} if spare else set()) \
        if certified else set(spare)
    where, at = np.full(len(pdf), -1, dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
    for i, b in enumerate(bins):
        place = 0
        for s in b:
            row = queues[s].pop()
            if i not in handed:
                where[row], at[row] = i, place
            place += s
    return pdf.assign(bin=where, offset=at)


def _packer(capacity: int, last: bool):
    return lambda pdf: _pack_group(pdf, capacity, last)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, group: int = GROUP, rounds: int = 6) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone.  Repeated rows are packed each.  Ties between pieces
    of one length are decided by the row's key.  After ``rounds`` rounds what is still open
    is packed as it lies.  An empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    schema = ("k1 long, k2 long, doc_id long, piece int, start long, length long, ids_crc32 long, "
              "number long, grp long, bin long, offset long")
    # repeated rows are told apart by number, so that no group is larger than the others
    rest = materialise(pieces_of(docs, id_col, text_col, capacity, path).withColumn(
        "number", F.monotonically_increasing_id()), "pack-pieces")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # full pieces are full sequences; their numbers are negative
    done = rest.filter(F.col("length") == capacity).select(
        *kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = rest.filter(F.col("length") < capacity)
    left = rest.count()
    for round_ in range(1, rounds + 1):
        groups = -(-left // group)
        if not groups:
            break
        last = groups == 1 or round_ == rounds
        named = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit(round_), "number"), F.lit(groups)))
        packed = materialise(named.groupBy("grp").applyInPandas(_packer(capacity, last), schema),
                             "pack-round")
        # a group has fewer bins than pieces, and far fewer pieces than 2^24
        sequence = F.lit(round_ << 58) + F.col("grp") * F.lit(1 << 24) + F.col("bin")
        done = done.unionByName(packed.filter("bin >= 0").select(
            *kept, sequence.alias("sequence_id"), "offset"))
        rest = packed.filter("bin < 0").drop("grp", "bin", "offset")
        left = rest.count()
    return done

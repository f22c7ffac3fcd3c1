"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.session import materialize

SHIFT = 24  # a group has fewer bins than 2^SHIFT
RESULT = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_start long, capacity long"


def cost(capacity: int, fixed: float = 128.0, quadratic: float = 1 / 32768) -> float:
    """What a sequence costs: a fixed part, its length, and attention that grows with the square."""
    return fixed + capacity + quadratic * capacity * capacity


def best_fit(lengths: Sequence[int], capacities: Sequence[int], prefer: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin of every piece, its place in the bin, and the final capacity of every bin.

    ``lengths`` are descending and none is longer than the largest capacity. A piece goes to the open bin that it
    fills best. If none has room, a bin is opened: of those that hold the piece, the size with the least cost for each token
    that can still come into it; ``prefer`` raises the choice to at least that size. In the end every bin
    shrinks to the smallest capacity that holds its contents.
    """
    sizes = sorted(capacities)
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    bins, places, used = [], [], []
    for n in lengths:
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            fits = [c for c in sizes if c >= max(n, prefer or 0)] or sizes[-1:]
            free = min(fits, key=lambda c: (cost(c) / min(c, left), c)) if prefer is None else fits[0]
            b = len(used)
            used.append(0)
        bins.append(b)
        places.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
        left -= n
    return bins, places, [sizes[bisect_left(sizes, u)] for u in used]


def pack_group(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings that open bins by cost, or by each of the permitted lengths."""
    return min((best_fit(lengths, capacities, p) for p in (None, *sorted(capacities))), key=lambda found: sum(map(cost, found[2])))


def word_count(text: Column) -> Column:
    """Words of bytes other than 0x20 and 0x09-0x0D; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", n_tokens: Column | None = None, capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192), group_rows: int = 4096) -> DataFrame:
    """Place every token of every document: ``doc_id, piece, start, n_tokens, bin_id, bin_start, capacity``.

    ``n_tokens`` is the length of a document (default: its words and an end token, so never 0; null counts as 0).
    Documents longer than the largest capacity are cut into pieces of that length and a rest; a document
    without tokens has no piece. ``start`` is a piece's place in the document, ``bin_start`` in the bin.

    Pieces are dealt by a hash of id and piece into groups of about ``group_rows``, which bounds what one task
    holds at any size of the table; only lengths travel, texts stay where they are. In a group pieces are taken
    by length, then id, then piece, and several ways to open bins are compared by their total cost.
    Null ids are packed like others. Rows that repeat an id are packed one by one.
    """
    length = n_tokens if n_tokens is not None else word_count(F.col("text")) + 1
    sizes, largest = tuple(capacities), max(capacities)
    lengths = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n")), "lengths")
    total = lengths.agg(F.sum(F.ceil(F.col("n") / largest)).alias("n")).first()["n"] or 0
    groups = max(1, int(np.ceil(total / group_rows)))
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / largest).cast("int") - 1)).alias("piece")
    pieces = lengths.filter("n > 0").select("doc_id", "n", piece).select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("piece").cast("long") * largest).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(groups)).alias("group"),
    )

    def pack_rows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, places, final = pack_group(rows["n_tokens"].tolist(), sizes)
        rows["bin_id"] = (rows["group"].to_numpy() << SHIFT) + np.array(bins, np.int64)
        rows["bin_start"], rows["capacity"] = places, np.array(final, np.int64)[bins]
        return rows.drop(columns="group")

    return pieces.groupBy("group").applyInPandas(pack_rows, RESULT)

"""Removal of repeated windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.words import positions, row_key, split_lines
from epochwise.session import materialize


def _window_hash(hashes: Column, field: str, start: Column, window: int) -> Column:
    return F.xxhash64(F.lit(field), *(hashes[start + k][field] for k in range(window)))


def drop_repeated_line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    r"""``docs`` with ``n_lines``, ``n_removed_lines`` and ``kept_text`` (the lines that stay, joined by ``\n``).

    A line falls if it lies in a window of ``window`` consecutive lines whose lines stand, in the same order,
    at an earlier place: in a document with a smaller id, or further up in the same one. Windows overlap and
    are judged on the input. Texts shorter than a window keep all lines.

    Windows travel as two 64-bit hashes. Their first places are found by a grouping with partial
    aggregation, so a window that stands in a third of all texts is one row per task; the join back lets
    adaptive execution split such keys. Covered positions are merged per text.

    Null text: no lines and an empty result; empty text: one empty line. Null ids sort last. Rows that are
    equal in id and text count as one document. Input columns named like the new ones are replaced.
    """
    names = ("n_lines", "n_removed_lines", "kept_text")
    lines = docs.select(*row_key(id_col, text_col), split_lines(F.col(text_col)).alias("lines"))
    hashed = lines.select("id", "tag", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"))).alias("h"))
    windows = hashed.select(
        "id", "tag",
        F.transform(
            positions(F.size("h") - (window - 1)),
            lambda i: F.struct(_window_hash(F.col("h"), "a", i, window).alias("a"), _window_hash(F.col("h"), "b", i, window).alias("b")),
        ).alias("w"),
    ).select("id", "tag", F.posexplode_outer("w").alias("pos", "w")).filter("pos IS NOT NULL").select("id", "tag", "pos", "w.a", "w.b")
    place = F.struct("id", "tag", "pos")
    firsts = materialize(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-windows")
    later = windows.join(firsts, ["a", "b"]).filter(place != F.col("first"))
    covered = later.groupBy("id", "tag").agg(F.collect_set("pos").alias("starts"))

    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*kept).alias("row"), *row_key(id_col, text_col), split_lines(F.col(text_col)).alias("lines"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*(p + k for k in range(window))))))
    joined = rows.join(covered.hint("shuffle_hash"), ["id", "tag"], "left").select("row", "lines", F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(positions(F.size("lines")), F.col("gone"))
    new = F.struct(
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_removed_lines"),
        F.array_join(F.transform("stay", lambda p: F.col("lines")[p]), "\n").alias("kept_text"),
    )
    return joined.select("row", "lines", stay.alias("stay")).select("row", new.alias("new")).select("row.*", "new.*")

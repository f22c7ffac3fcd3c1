"""Quality rules and a likelihood ratio of hashed n-grams between trusted texts and the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.words import positions, row_key, split_lines, split_words
from epochwise.session import materialize

BUCKETS = 1 << 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _word_hashes(docs: DataFrame, text_col: str, *more: Column | str) -> DataFrame:
    words = docs.select("*", split_words(F.col(text_col)).alias("w"))
    return words.select(*more, F.size("w").alias("n"), F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def _grams(h: str = "h") -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    low = F.lit(BUCKETS - 1).cast("long")
    ones = F.transform(h, lambda x: x.bitwiseAND(low).cast("int"))
    twos = F.transform(positions(F.size(h) - 1), lambda i: F.xxhash64(F.col(h)[i], F.col(h)[i + 1]).bitwiseAND(low).cast("int"))
    return F.concat(ones, twos)


def _with_repeats(rows: DataFrame, keep: list[str], window: int = 5) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of ``window`` words that occur twice or more in the text."""
    five = F.transform(positions(F.size("h") - (window - 1)), lambda i: F.xxhash64(*(F.col("h")[i + k] for k in range(window))))
    a = rows.select(*keep, "h", five.alias("five"))
    # Only texts with a repeat are sorted: equal hashes become neighbours.
    in_order = F.when(F.size(F.array_distinct("five")) < F.size("five"), F.sort_array(F.transform("five", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    b = a.select(*keep, "h", F.coalesce(in_order, F.array().cast("array<struct<x:bigint,i:int>>")).alias("s"))
    beside = lambda i, k: F.get(F.col("s"), i + k)["x"]
    found = F.transform("s", lambda v, i: F.when((v["x"] == beside(i, -1)) | (v["x"] == beside(i, 1)), v["i"]))
    c = b.select(*keep, "h", F.sort_array(F.filter(found, lambda p: p.isNotNull())).alias("p"))
    gaps = F.transform("p", lambda v, i: F.least(F.lit(window), F.coalesce(F.get(F.col("p"), i + 1) - v, F.lit(window))))
    return c.select(*keep, "h", F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g).alias("n_repeat_words"))


def gram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(gram, weight)`` for every bucket: log of its share in trusted texts over its share in all texts.

    Counts cover all documents; each share has one added to each count. ``trusted`` holds ids. The table has
    ``BUCKETS`` rows whatever the input.
    """
    ids = trusted.select(F.col(id_col).alias("id")).distinct().withColumn("good", F.lit(True))
    marked = docs.select(F.col(id_col).alias("id"), text_col).join(ids.hint("shuffle_hash"), "id", "left")
    grams = _word_hashes(marked, text_col, F.coalesce("good", F.lit(False)).alias("good")).select("good", _grams().alias("g"))
    counts = grams.select("good", F.explode_outer("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    counts = materialize(counts, "gram-counts")  # BUCKETS rows at most, read three times
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("gram")).join(counts.filter("gram IS NOT NULL"), "gram", "left").fillna(0)
    full = counts.filter("gram IS NOT NULL")
    total = {c: full.agg((F.coalesce(F.sum(c), F.lit(0)) + BUCKETS).alias("n")).scalar() for c in ("raw", "target")}
    share = {c: F.log((F.col(c) + 1) / total[c]) for c in total}
    return every.select("gram", (share["target"] - share["raw"]).alias("weight"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, trusted_share: float = 0.005) -> DataFrame:
    """Base counts, likelihood ratio and verdict per document.

    Columns: ``id_col``, ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (``#*$%&|<>``), ``n_dup_lines`` (lines with a
    word that equal an earlier line), ``n_repeat_words``, ``base_failed``, ``llr``, ``kept``.

    ``llr`` is the mean over a text's hashed words and word pairs of ``gram_weights``. A document is kept if it
    does not fail the base rules (fewer than 10 words, or over 20 % of words in repeated windows of 5) and
    ``llr >= threshold``; nothing is drawn at random. Unless it is given, the threshold is the ``trusted_share`` quantile of the
    ratios of trusted documents that do not fail the base rules, so it moves with the corpus and the weights. A text without
    words has no ratio and fails the base rules.

    Null text: no words, no lines. Null ids stay null and are never trusted. Rows that are equal in id and text
    give one row. Without trusted ids all ratios compare the corpus with a flat distribution, and only a given threshold drops by them.
    """
    weights = gram_weights(docs, trusted, id_col, text_col)
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    own = docs.select(F.col(id_col).alias("own"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    lines = own.select("*", F.filter(split_lines(F.col("text")), has_word).alias("l"))
    counted = lines.select(
        "own", "id", "tag", "text", F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    hashed = _word_hashes(counted, "text", "own", "id", "tag", "n_symbols", "n_dup_lines").withColumn("n_words", F.col("n").cast("long"))
    full = _with_repeats(hashed, ["own", "id", "tag", "n_words", "word_chars", "n_symbols", "n_dup_lines"])
    grams = full.select("own", "id", "tag", *BASE, F.explode_outer(_grams()).alias("gram"))
    # The weights are BUCKETS rows: small by construction.
    scored = grams.join(F.broadcast(weights), "gram", "left").groupBy("id", "tag").agg(
        F.max("own").alias(id_col), *(F.max(c).alias(c) for c in BASE), F.avg("weight").alias("llr")
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = scored.select(id_col, *BASE, failed.alias("base_failed"), "llr")
    if threshold is None:
        rated = materialize(rated, "rated")  # read twice
        known = rated.filter("NOT base_failed").join(trusted.select(F.col(id_col).alias("good")).distinct(), F.col(id_col) == F.col("good"), "left_semi")
        cut = known.agg(F.percentile_approx("llr", trusted_share, 100_000)).scalar()
        passes = cut.isNull() | (F.col("llr") >= cut)
    else:
        passes = F.col("llr") >= threshold
    return rated.select("*", (~F.col("base_failed") & F.coalesce(passes, F.lit(False))).alias("kept"))

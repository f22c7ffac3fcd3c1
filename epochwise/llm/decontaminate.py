"""Documents that hold benchmark passages, found by spaced seeds and verified with substitutions allowed."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.words import positions, row_key, split_words
from epochwise.session import materialize

# Word positions that a seed looks at; the one left out may hold any word. Whatever 3 of 15 or 16 words are
# substituted, or 2 of 13, some seed of these two stays whole (a test goes through all placements).
MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 4, 5))
CELLS = 1 << 21  # bits of the set of seed cells, 256 kB
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’„‚«»‹›…–—¡¿。、，！？：；"  # stripped from the ends of words if asked for


SHORT = 12  # items up to this length may need more seeds than the masks


def blocks_of(n: int, share: float = 0.8) -> list[tuple[int, int]]:
    """``n`` words cut into one block more than there may be substitutions, so that one block stays whole."""
    parts = n - math.ceil(n * share - 1e-9) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _seeds(rows: DataFrame, keep: Sequence[str], masks: Sequence[Sequence[int]], cells: Column | None = None) -> DataFrame:
    """``keep``, ``pos`` and ``seed`` for every mask at every word position; ``rows`` has word hashes ``h``. With ``cells`` only seeds in that set."""

    def of(mask: Sequence[int], number: int) -> Column:
        return F.when(F.col("pos") + mask[-1] < F.size("h"), F.xxhash64(F.lit(number), *(F.get(F.col("h"), F.col("pos") + k) for k in mask)))

    # Positions become rows before anything is hashed: array functions with lambdas would be interpreted, this is compiled.
    placed = rows.select(*keep, "h", F.explode_outer(positions(F.size("h"))).alias("pos")).filter("pos IS NOT NULL")
    seeds = {f"s{n}": of(m, n) for n, m in enumerate(masks)}
    each = placed.select(*keep, "pos", *(c.alias(name) for name, c in seeds.items()))
    if cells is not None:
        each = each.filter(functools.reduce(lambda a, b: a | b, (_inhabited(F.col(name), cells) for name in seeds)))
    out = each.select(*keep, "pos", F.explode_outer(F.array(*seeds)).alias("seed")).filter("seed IS NOT NULL")
    return out if cells is None else out.filter(_inhabited(F.col("seed"), cells))


def _inhabited(seed: Column, cells: Column) -> Column:
    """Whether a seed's cell is in the set of :func:`_cells`; false for a null seed."""
    cell = seed.bitwiseAND(F.lit(CELLS - 1).cast("long"))
    return F.coalesce(F.getbit(F.get(cells, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1, F.lit(False))


def _cells(seeds: DataFrame) -> Column:
    """Set of the cells of ``seed``: ``CELLS`` bits as an array of 64-bit words, whatever the number of seeds."""
    cell = F.col("seed").bitwiseAND(F.lit(CELLS - 1).cast("long"))
    words = seeds.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 AS int)))").alias("bits"))
    dense = seeds.sparkSession.range(CELLS // 64).join(words, "id", "left").fillna(0, ["bits"])
    in_order = F.array_sort(F.collect_list(F.struct("id", "bits")))
    return dense.agg(in_order.alias("l")).select(F.col("l.bits").alias("l")).scalar()


def _keyed(table: DataFrame, id_col: str, text_col: str, names: tuple[str, str]) -> DataFrame:
    ident, tag = row_key(id_col, text_col)
    return table.select(ident.alias(names[0]), tag.alias(names[1]), F.col(text_col).alias("text"))


def _hashed(rows: DataFrame, names: tuple[str, str], folded: bool) -> DataFrame:
    """Hashes ``h`` of the words. Folded, they lose the marks at their ends; a word of marks alone stays, so equal words stay equal."""
    words = rows.select(*names, split_words(F.lower("text") if folded else F.col("text")).alias("w"))
    if not folded:
        return words.select(*names, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    bare = words.select(*names, "w", F.transform("w", lambda x: F.btrim(x, F.lit(MARKS))).alias("b"))
    return bare.select(*names, F.transform("b", lambda x, i: F.xxhash64(F.when(x == "", F.get(F.col("w"), i)).otherwise(x))).alias("h"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 16, share: float = 0.8, masks: Sequence[Sequence[int]] = MASKS, folded: bool = True,
) -> DataFrame:
    """Rows ``(id, tag, item, n_matched, n_compared, start)`` of documents, by row key, and the items they leak.

    A document leaks an item if, laid over each other at some offset, ``window`` consecutive words of the
    item (all of a shorter item) lie inside the document and at least ``share`` of them are equal, the others being
    substituted. ``n_matched`` of ``n_compared`` words agree in the best such window, ``start`` is the document's word at
    which the item's first word lies for that offset (negative if the document has only a later part).

    Offsets come from spaced seeds: hashes of the words at the positions of each mask, at every word of both
    tables, joined. Documents' seeds first pass a set of ``CELLS`` bits, which goes to every task because of that bound;
    what is left meets the items' seeds in an ordinary join. Items of lengths for which the masks would miss an allowed
    placement of substitutions are cut into as many blocks as leave one whole (``blocks_of``), and those are seeds too.

    Words are separated by bytes 0x20 and 0x09-0x0D and compared in lower case and without the ``MARKS`` at their ends, or as
    they stand without ``folded``. Null texts have no words; items without words are never found.
    """
    items = _hashed(_keyed(benchmark, item_col, item_text_col, ("item", "item_tag")), ("item", "item_tag"), folded)
    # Lengths of short items: a few numbers, which say how long the seeds of their blocks are.
    short = sorted(r["n"] for r in items.select(F.size("h").alias("n")).filter(F.col("n").between(1, SHORT)).distinct().collect())
    blocks = {n: blocks_of(n, share) for n in short}
    lengths = sorted({b - a for cuts in blocks.values() for a, b in cuts})
    contiguous = [tuple(range(k)) for k in lengths]
    numbers = {k: len(masks) + i for i, k in enumerate(lengths)}
    item_seeds = _seeds(items, ["item", "item_tag"], masks).withColumnRenamed("pos", "item_pos")
    for n, cuts in blocks.items():
        parts = F.array(*[F.struct(F.lit(a).alias("item_pos"), F.xxhash64(F.lit(numbers[b - a]), *(F.col("h")[k] for k in range(a, b))).alias("seed")) for a, b in cuts])
        own = items.filter(F.size("h") == n).select("item", "item_tag", F.explode(parts).alias("s")).select("item", "item_tag", "s.item_pos", "s.seed")
        item_seeds = item_seeds.unionByName(own)
    item_seeds = materialize(item_seeds, "item-seeds")
    every = [*masks, *contiguous]
    texts = _keyed(docs, id_col, text_col, ("id", "tag"))
    met = _seeds(_hashed(texts, ("id", "tag"), folded), ["id", "tag"], every, _cells(item_seeds))
    offsets = met.join(item_seeds, "seed").select("id", "tag", "item", "item_tag", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()
    offsets = materialize(offsets, "offsets")

    with_items = offsets.join(items.withColumnRenamed("h", "ih"), ["item", "item_tag"])
    # Only texts that met an item are split into words again.
    again = texts.join(offsets.select("id", "tag").distinct().hint("shuffle_hash"), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    laid = _hashed(again, ("id", "tag"), folded).join(with_items, ["id", "tag"])
    equal = F.transform("ih", lambda x, q: F.coalesce(F.when(F.col("offset") + q >= 0, F.get(F.col("h"), F.col("offset") + q)) == x, F.lit(False)).cast("int"))
    size = F.least(F.lit(window), F.size("ih"))
    compared = laid.select("id", "tag", "item", "item_tag", "offset", size.alias("n"), F.size("h").alias("n_doc"), equal.alias("e"))
    inside = lambda s: (F.col("offset") + s >= 0) & (F.col("offset") + s + F.col("n") <= F.col("n_doc"))
    sums = F.transform(
        positions(F.size("e") - F.col("n") + 1), lambda s: F.when(inside(s), F.aggregate(F.slice("e", s + 1, F.col("n")), F.lit(0), lambda t, x: t + x)).otherwise(F.lit(0))
    )
    best = compared.select("id", "tag", "item", "item_tag", "offset", "n", F.array_max(sums).alias("m")).filter(F.col("m") >= F.ceil(F.col("n") * F.lit(share)))
    found = best.groupBy("id", "tag", "item", "item_tag").agg(F.max(F.struct("m", "n", (-F.col("offset")).alias("o"))).alias("b"))
    return found.select("id", "tag", "item", F.col("b.m").cast("long").alias("n_matched"), F.col("b.n").cast("long").alias("n_compared"), (-F.col("b.o")).cast("long").alias("start"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """Pairs ``(id_col, item_col, n_matched, n_compared, start)`` of documents and the items they leak, by :func:`leaks`.

    Null ids stay null. Rows that are equal in id and text give one row per item. Clean documents do not appear.
    """
    none = F.lit((1 << 63) - 1)
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, **options)
    return found.select(F.nullif("id", none).alias(id_col), F.nullif("item", none).alias(item_col), "n_matched", "n_compared", "start")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item, with all their columns. Rows are told apart by id and text, so one that shares its id with a leaking one stays."""
    leaking = leaks(docs, benchmark, id_col, text_col, **options).select("id", "tag").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key(id_col, text_col))
    return rows.join(leaking.hint("shuffle_hash"), ["id", "tag"], "left_anti").select("row.*")

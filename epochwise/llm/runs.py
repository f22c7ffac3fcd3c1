"""Window runs: the positions of all fixed-length windows of a text, cut into runs by content.

Every window of ``size`` units (words or bytes) has an anchor: the unit k-gram inside it whose hash is
smallest, the leftmost of equals. The anchor depends on the window's content alone, so equal windows
have equal anchors at the same distance from their start. Consecutive windows with the same anchor form
a *run*. Runs are the rows that leave a task, one for about ``(size - k) / 2`` windows, and equal runs hold the
same windows in the same order. Cutting a run in two is harmless: a window stays in exactly one run.

Everything here works on arrays of 64-bit unit hashes, inside a task, in slices of bounded length.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.llm.words import content_tag, row_key
from epochwise.session import materialize, release

U = np.uint64
SLICE = 1 << 16  # units worked on at once
SEEDS = (1, 2)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
POSITION = U((1 << 21) - 1)  # low bits that carry a position while minima are searched


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed public-domain constants); works in place on a copy."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(256, dtype=U) + U(seed))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each text starts (one entry more than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def worker_slot(name: str, key: object, make: Callable):
    """Something that a Python worker keeps from task to task: one value for each name, made anew when ``key`` changes.

    Functions are shipped by value and start with fresh globals in every task; a module entry outlives them.
    """
    kept = vars(sys.modules.setdefault("epochwise_worker", types.ModuleType("epochwise_worker")))
    if name not in kept or kept[name][0] != key:
        kept[name] = (key, make())
    return kept[name][1]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """One hash of each word per seed; a word is ``raw[start:end]``."""
    length = end - start
    index = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    letters = raw[index]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, length)
    out = []
    for seed in seeds:
        powers = np.empty(int(length.max()), U)
        powers[0] = 1
        if len(powers) > 1:
            powers[1:] = U(2 * seed + 0x9E3779B97F4A7C15 | 1)
            np.multiply.accumulate(powers, out=powers)
        out.append(mix(np.add.reduceat(_table(seed)[letters] * powers[place], first) + length.astype(U)))
    return out


def words(raw: np.ndarray, at: np.ndarray, seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and end byte of every word, the first word of each text (one entry more), hashes by seed.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; none crosses the end of a text.
    """
    space = np.ones(len(raw) + 1, bool)
    space[:-1] = is_space(raw)
    begins = ~space[:-1].copy()
    begins[1:] &= space[:-2]
    inner = at[1:-1][at[1:-1] < len(raw)]
    begins[inner] = ~space[:-1][inner]
    start = np.flatnonzero(begins)
    ends = ~space[:-1] & space[1:]
    last = at[1:-1][at[1:-1] > 0] - 1
    ends[last] = ~space[:-1][last]
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    hashes = [np.empty(len(start), U) for _ in seeds]
    a = 0
    while a < len(start):  # slices of words, so that helpers of a very long text stay small
        b = max(a + 1, int(np.searchsorted(start, start[a] + 4 * SLICE)))
        for whole, part in zip(hashes, _word_hashes(raw, start[a:b], end[a:b], seeds)):
            whole[a:b] = part
        a = b
    return start, end, first, hashes


def _powers(multiplier: int, length: int) -> np.ndarray:
    out = np.full(length, multiplier, U)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Plan:
    """How texts are cut: window size and the k-gram lengths of the passes, by word or by byte."""

    unit: str
    size: int
    grams: tuple[int, ...]

    def __post_init__(self) -> None:
        span = SLICE + self.size
        # Odd multipliers have inverses, so a polynomial hash of any stretch follows from two prefix sums.
        self.powers = [_powers(m, span + 1) for m in MULTIPLIERS]
        self.inverse = [_powers(pow(m, -1, 1 << 64), span + 1) for m in MULTIPLIERS]

    def units(self, raw: np.ndarray, at: np.ndarray, hashes: int) -> tuple[np.ndarray, list]:
        """First unit of each text, and the units: word hashes, or the bytes themselves for each hash."""
        if self.unit == "byte":
            return at, [raw] * hashes
        _, _, first, found = words(raw, at, SEEDS[:hashes])
        return first, found


@dataclass
class Runs:
    """Runs of one slice. ``start`` counts units from the start of the text ``doc``."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    key: np.ndarray | None


def _prefix(units: np.ndarray, powers: np.ndarray, salt: int) -> np.ndarray:
    if units.dtype == np.uint8:
        units = units.astype(U)
        units *= units + U(salt)
    out = np.zeros(len(units) + 1, U)
    np.cumsum(units * powers[: len(units)], out=out[1:])
    return out


def _anchors(prefix: np.ndarray, inverse: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams, and for every window the place of its anchor."""
    grams = prefix[gram:] - prefix[:-gram]
    grams *= inverse[: len(grams)]
    grams ^= grams >> U(31)
    grams *= U(0x94D049BB133111EB)
    grams ^= grams >> U(29)
    span = size - gram + 1
    if span == 1:
        return grams, np.arange(len(grams))
    least, width = (grams & ~POSITION) | np.arange(len(grams), dtype=U), 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if span > width:
        gap = span - width
        least = np.minimum(least[: len(least) - gap], least[gap:])
    return grams, (least & POSITION).astype(np.int64)


def _slice_runs(plan: Plan, units: list[np.ndarray], first: np.ndarray, level: int, open_sets: list) -> Runs | None:
    size = plan.size
    n = len(units[0]) - size + 1
    if n <= 0:
        return None
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    wanted = doc[:n] == doc[size - 1 :]
    if not wanted.any():
        return None
    prefix = _prefix(units[0], plan.powers[0], 0xA0761D6478BD642F)
    for above, open_set in zip(plan.grams[:level], open_sets):
        grams, anchor = _anchors(prefix, plan.inverse[0], size, above)
        begin = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        wanted &= np.repeat(open_set.has(grams[anchor[begin]]), np.diff(np.append(begin, n)))
        if not wanted.any():
            return None
    grams, anchor = _anchors(prefix, plan.inverse[0], size, plan.grams[level])
    edge = np.empty(n + 1, bool)  # a run begins or ends here
    edge[0] = edge[n] = True
    np.not_equal(anchor[1:], anchor[:-1], out=edge[1:n])
    edge[1:n] |= wanted[1:] != wanted[:-1]
    start = np.flatnonzero(edge)
    start, count = start[:-1], np.diff(start)
    keep = wanted[start]
    start, count = start[keep], count[keep]
    key = None
    if len(units) > 1:
        other = _prefix(units[1], plan.powers[1], 0xE7037ED1A0B428DB)
        key = mix((other[start + count - 1 + size] - other[start]) * plan.inverse[1][start] + count.astype(U))
    return Runs(doc[start], start - first[doc[start]], count, grams[anchor[start]], key)


def find_runs(plan: Plan, raw: np.ndarray, at: np.ndarray, level: int = 0, open_sets: Sequence = (), keys: bool = True) -> Iterator[Runs]:
    """Runs of pass ``level`` over some texts, slice by slice.

    A window takes part if its anchors of the passes before are all in the sets ``open_sets``. The slices
    overlap by one window less one unit, so that each window starts in exactly one of them.
    """
    first, units = plan.units(raw, at, 2 if keys else 1)
    a, total = 0, int(first[-1])
    while a < total:
        b = min(total, a + SLICE)
        to = min(total, b + plan.size - 1)
        found = _slice_runs(plan, [u[a:to] for u in units], np.clip(first, a, to) - a, level, open_sets)
        if found is not None:
            found.start += np.maximum(a - first[found.doc], 0)
            yield found
        a = b


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most, a single longer text alone."""
    for batch in batches:
        _, at = texts(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


# ---------------------------------------------------------------------------------------------
# Sets of hashes as bitmaps, and counts of hashes as sketches: built by tasks, merged by Spark, fixed in size.

BLOCK = 1 << 16  # cells of a sketch that are merged together


@dataclass
class HashSet:
    """Set of hashes with one bit for each of ``2 ** bits`` cells in each row; it never misses a member."""

    rows: list[np.ndarray]
    bits: int

    def packed(self) -> tuple:
        """Plain values to broadcast; workers need not know this class to read them."""
        return [zlib.compress(r, 1) for r in self.rows], self.bits

    @staticmethod
    def unpacked(data: tuple) -> HashSet:
        return HashSet([np.frombuffer(zlib.decompress(r), np.uint8) for r in data[0]], data[1])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for row, cells in zip(self.rows, cells_of(hashes, len(self.rows), self.bits)):
            found = (row[cells >> U(3)] >> (cells & U(7)).astype(np.uint8)) & 1 == 1
            out = found if out is None else out & found
        return out


@dataclass
class CellList:
    """Few cells of a sketch's first row, as a sorted list."""

    cells: np.ndarray
    bits: int

    @staticmethod
    def of(found: HashSet) -> CellList:
        full = found.rows[0].nonzero()[0]
        bit = np.unpackbits(found.rows[0][full], bitorder="little").reshape(-1, 8).nonzero()
        return CellList(full[bit[0]].astype(U) * U(8) + bit[1].astype(U), found.bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(hashes), bool)
        cells = cells_of(hashes, 1, self.bits)[0]
        return self.cells[np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)] == cells


def cells_of(hashes: np.ndarray, rows: int, bits: int) -> list[np.ndarray]:
    """Cell of every hash in each row of a sketch."""
    return [mix(hashes ^ U(0x632BE59BD9B4E019 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) >> U(64 - bits) for r in range(rows)]


SKETCH = "block int, cell binary, n binary"
FINE = 16  # bits by which values are told apart inside a cell of a sketch


def sketch_batches(hashes: Iterator[np.ndarray], rows: int, bits: int, most: int = 1 << 21, by_value: bool = False) -> Iterator[pa.RecordBatch]:
    """The sketch of one task, as its cells that are not zero: rows ``(block, cells, counts)``.

    Counts are summed for every ``most`` hashes, so a task's memory does not grow with its input.
    ``by_value``: values of ``bits + FINE`` bits are counted, so that those that only share a cell are not taken for one.
    """
    fine = FINE if by_value else 0
    kind = np.uint32 if fine else np.uint16
    held: list[np.ndarray] = []
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        for r, cells in enumerate(cells_of(every, rows, bits + fine)):
            cell, count = np.unique(cells, return_counts=True)
            count = np.minimum(count, 0xFFFF).astype(np.uint16)
            block = (cell >> U(16 + fine)).astype(np.int64) + (r << (bits - 16))
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cut[1:], len(block))
            low = cell.astype(kind)
            yield pa.record_batch(
                [pa.array(block[cut].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                 pa.array([b"" if count[a:b].max() == 1 else count[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
                ["block", "cell", "n"],
            )

    for part in hashes:
        held.append(part)
        n += len(part)
        if n >= most:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def merge_sketches(parts: DataFrame, rows: int, bits: int, hot: int | None = None, by_value: bool = False) -> tuple[HashSet, HashSet | None]:
    """Cells of the merged sketch that count two or more, and those that count ``hot`` or more, as sets.

    The parts are summed block by block on the executors; each block comes back as at most 2 x 8 kB, so the
    driver holds ``rows * 2 ** bits / 8`` bytes for each set whatever the input. ``by_value``: a cell belongs to a set if
    one of its values counts as much; with more values than cells the sets hold the cells of repeated values, not all cells.
    """

    def merge_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for block, cell, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "n"))):
                value = np.frombuffer(cell, np.uint32)
                held.setdefault(block, []).append((value, np.frombuffer(n, np.uint16) if n else np.ones(len(value), np.uint16)))
        for block in list(held):
            value, n = (np.concatenate(x) for x in zip(*held.pop(block)))
            order = np.argsort(value)
            value = value[order]
            first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            total = np.add.reduceat(n[order].astype(np.uint64), first)
            cell, found = (value[first] >> np.uint32(FINE)).astype(np.int64), []
            for least in (2, hot or 2):
                mark = np.zeros(BLOCK, bool)
                mark[cell[total >= least]] = True
                found.append(mark)
            if found[0].any():
                twice, often = (np.packbits(mark, bitorder="little").tobytes() for mark in found)
                yield pa.record_batch(
                    [pa.array([block], pa.int32()), pa.array([twice], pa.binary()), pa.array([often if hot and found[1].any() else None], pa.binary())], ["block", "twice", "hot"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "n"))):
                total = sums.get(block)
                if total is None:
                    total = sums[block] = np.zeros(BLOCK, np.uint32)
                index = np.frombuffer(cell, np.uint16)
                total[index] = np.minimum(total[index].astype(np.uint64) + (np.frombuffer(n, np.uint16) if n else 1), 0xFFFFFFFF)
        for block, total in sums.items():
            if (total >= 2).any():
                bits_of = [np.packbits(total >= least, bitorder="little").tobytes() for least in (2, hot or 2)]
                yield pa.record_batch(
                    [pa.array([block], pa.int32()), pa.array(bits_of[:1], pa.binary()), pa.array([bits_of[1] if hot and (total >= hot).any() else None], pa.binary())],
                    ["block", "twice", "hot"],
                )

    merged = parts.repartition("block").mapInArrow(merge_values if by_value else merge, "block int, twice binary, hot binary")
    sets = [[np.zeros(1 << (bits - 3), np.uint8) for _ in range(rows)] for _ in range(2 if hot else 1)]
    for row in merged.toLocalIterator(prefetchPartitions=True):
        r, place = divmod(row["block"], 1 << (bits - 16))
        for target, data in zip(sets, (row["twice"], row["hot"])):
            if data is not None:
                target[r][place * (BLOCK // 8) : (place + 1) * (BLOCK // 8)] = np.frombuffer(data, np.uint8)
    return HashSet(sets[0], bits), HashSet(sets[1], bits) if hot else None


# ---------------------------------------------------------------------------------------------
# Passes over the runs of a table of texts.

ROWS = 1 << 18  # runs of a task that are compared with each other before they leave it
KINDS = {"gram": "long", "key": "long", "id": "long", "tag": "long", "more": "long", "start": "int", "n": "int", "many": "boolean", "done": "boolean"}
TAG = "struct<a:bigint,b:bigint>"


def identified(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """``(id, tag, text)``: the key of a row (``words.row_key``) and its text, empty instead of null."""
    return [*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """``(id, text)`` where no id is repeated, ``(id, tag, more, text)`` with two hashes of the text else: the key travels with every run."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    shared = docs.select(ident).groupBy("id").count().filter("count > 1").limit(1).count()
    return [ident, *([c.alias(n) for c, n in zip(content_tag(text_col), ("tag", "more"))] if shared else []), text]


def names_of(rows: DataFrame) -> list[str]:
    """The columns of :func:`keyed` that make the key."""
    return [c for c in ("id", "tag", "more") if c in rows.columns]


def copies_of_texts(rows: DataFrame, size: int) -> DataFrame:
    """The key of ``rows`` and ``(start, n)``, all windows of the text, of those whose whole text a smaller id holds as well. Stored.

    Each of their windows starts at the smaller id too, and any other text that has one of them finds it there: they need not be cut into runs.
    Texts are equal if their length and two hashes are.
    """
    first, second = content_tag("text")
    long = rows.select(*names_of(rows), first.alias("_a"), second.alias("_b"), F.octet_length("text").alias("_n")).filter(F.col("_n") >= size)
    least = long.groupBy("_a", "_b", "_n").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high").drop("_high")
    found = long.join(least, ["_a", "_b", "_n"]).filter("id > _low")
    return materialize(found.select(*names_of(rows), F.lit(0).alias("start"), (F.col("_n") - size + 1).cast("int").alias("n")), "text-copies")


def _wanted(batches: Iterator[pa.RecordBatch], kept: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Rows whose column ``own`` is in the set ``kept``, all where there is none."""
    chosen = HashSet.unpacked(kept.value) if kept is not None else None
    for batch in batches:
        yield batch if chosen is None else batch.filter(pa.array(chosen.has(batch.column("own").to_numpy().view(U))))


def count_grams(rows: DataFrame, plan: Plan, level: int, open_sets: Sequence, sketch_rows: int, bits: int, hot: int, kept: Broadcast | None = None) -> tuple[HashSet, HashSet]:
    """Sketch of the anchors of one pass: the sets counted twice or more, and ``hot`` times or more."""
    sent = rows.sparkSession.sparkContext.broadcast([x.packed() for x in open_sets])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        above = [HashSet.unpacked(x) for x in sent.value]

        def grams() -> Iterator[np.ndarray]:
            for batch in small_batches(_wanted(batches, kept), "text"):
                for found in find_runs(plan, *texts(batch.column("text")), level, above, keys=False):
                    yield found.gram

        yield from sketch_batches(grams(), sketch_rows, bits, by_value=sketch_rows == 1)

    columns = ["text"] if kept is None else ["own", "text"]
    sets = merge_sketches(rows.select(*columns).mapInArrow(task, SKETCH), sketch_rows, bits, hot, sketch_rows == 1)
    sent.destroy()
    release(rows.sparkSession)  # the sketch's shuffle, before runs are exchanged
    return sets


def _settle(held: list[list[np.ndarray]], names: list[str], earlier: bool) -> pa.RecordBatch:
    """Compare the runs of a task with each other; most copies of a hot run end here.

    ``earlier``: of equal runs only those of the smallest id leave as candidates, the others are done.
    Otherwise equal runs are all done, and one leaves as a candidate that counts as several.
    """
    gram, key, *own, start, n = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((start, *own[::-1], key, gram))
    gram, key, *own, start, n = (x[order] for x in (gram, key, *own, start, n))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(gram)))
    done = own[0] > np.repeat(own[0][begin], size) if earlier else np.repeat(size > 1, size)
    candidate = ~done if earlier else new
    many = np.repeat(size > 1, size)
    # Done runs that follow each other in a text leave as one row.
    at = np.flatnonzero(done)
    at = at[np.lexsort((start[at], *(x[at] for x in own[::-1])))]
    mine, a, e = [x[at] for x in own], start[at], (start + n)[at]
    head = np.ones(len(at), bool)
    head[1:] = a[1:] != e[:-1]
    for x in mine:
        head[1:] |= x[1:] != x[:-1]
    tail = np.append(head[1:], True) if len(at) else head
    c, spread = np.flatnonzero(candidate), mix((mine[0][head] ^ a[head]).astype(U)).view(np.int64)
    parts = {
        "gram": (gram.view(np.int64)[c], spread), "key": (key.view(np.int64)[c], spread), **{k: (x[c], y[head]) for k, x, y in zip(names, own, mine)}, "start": (start[c], a[head]),
        "n": (n[c], e[tail] - a[head]), "many": (many[c], np.ones(head.sum(), bool)), "done": (np.zeros(len(c), bool), np.ones(head.sum(), bool)),
    }
    kinds = {"long": np.int64, "int": np.int32, "boolean": bool}
    return pa.record_batch([pa.array(np.concatenate(x).astype(kinds[KINDS[k]])) for k, x in parts.items()], list(parts))


def group_runs(rows: DataFrame, plan: Plan, level: int, sets: Broadcast, earlier: bool, kept: Broadcast | None = None) -> DataFrame:
    """One pass of exact grouping: the key of ``rows``, ``start, n, removed, gram``.

    ``sets``: the open sets of the passes before, the anchors counted twice or more, and the hot ones.
    Runs of anchors that the sketch counts once have no equal and stay out. ``removed``: the windows of the
    row fall. ``gram`` is set where runs with the same anchor differ, so that their windows must be compared
    in the next pass. An anchor that the sketch counts as hot is dealt out by content and always goes on.
    """

    names = names_of(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        *above, counted = map(HashSet.unpacked, sets.value[:-1])
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in small_batches(_wanted(batches, kept), "text"):
            own = [batch.column(c).to_numpy() for c in names]
            for found in find_runs(plan, *texts(batch.column("text")), level, above):
                at = np.flatnonzero(counted.has(found.gram))
                if len(at):
                    d = found.doc[at]
                    held.append([found.gram[at], found.key[at], *(x[d] for x in own), found.start[at], found.count[at]])
                    n += len(at)
                if n >= ROWS:
                    yield _settle(held, names, earlier)
                    held, n = [], 0
        if n:
            yield _settle(held, names, earlier)

    last = level == len(plan.grams) - 1

    def is_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = CellList(*sets.value[-1])
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(U)
            place = batch.column("key").to_numpy().view(U) & U(255)
            salt = np.where(hot.has(gram), place.astype(np.int32) + 1, 0).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(salt)], [*batch.schema.names, "salt"])

    schema = ", ".join(f"{c} {KINDS[c]}" for c in ("gram", "key", *names, "start", "n", "many", "done")) + ", salt int"
    found = rows.mapInArrow(lambda batches: is_hot(task(batches)), schema).repartition("gram", "salt")
    by_gram, by_run = Window.partitionBy("gram", "salt"), Window.partitionBy("gram", "salt", "key")
    if earlier:
        removed = F.col("done") | (F.col("id") > F.min("id").over(by_run))
        several = F.min("id").over(by_gram) != F.max("id").over(by_gram)
    else:
        removed = F.col("done") | (F.sum(F.when(F.col("many"), 2).otherwise(1)).over(by_run) >= 2)
        several = F.lit(True)
    if last:
        return found.select(*names, "start", "n", removed.alias("removed"), F.lit(None).cast("long").alias("gram")).filter("removed")
    mixed = ~F.col("done") & ((F.col("salt") > 0) | ((F.min("key").over(by_gram) != F.max("key").over(by_gram)) & several))
    # One row is enough to name a mixed anchor.
    first = F.row_number().over(by_gram.orderBy("key", "id")) == 1
    return found.select(*names, "start", "n", removed.alias("removed"), F.when(mixed & first, F.col("gram")).alias("gram")).filter("removed OR gram IS NOT NULL")


def as_set(grams: DataFrame, bits: int) -> HashSet:
    """The values of the long column ``gram`` as a set; its size is fixed by ``bits``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")

        def twice() -> Iterator[np.ndarray]:
            for batch in batches:
                yield np.repeat(batch.column("gram").to_numpy().view(U), 2)

        yield from sketch_batches(twice(), 1, bits)

    return merge_sketches(grams.mapInArrow(task, SKETCH), 1, bits)[0]


def sketch_bits(n: float, most: int) -> int:
    """Cells of a sketch row as a power of two: four for each of ``n`` entries, between 2^16 and 2^most."""
    return int(min(most, max(16, np.ceil(np.log2(4 * max(n, 1))))))


def repeated_spans(rows: DataFrame, plan: Plan, earlier: bool, sketch_rows: int, most_bits: int, hot: int = 4096) -> DataFrame:
    """Windows that repeat, as the key of ``rows`` and ``(start, n)``: ``n`` consecutive window starts from unit ``start``.

    Pass by pass the anchors get longer, up to the whole window. Each pass counts anchors in a sketch,
    groups the runs of those counted twice or more exactly, and leaves to the next only the windows of
    anchors whose runs differ. The result of each pass is a table in the shared folder. With ``earlier``, texts that are
    copies of a smaller id's as a whole are settled before that, and the passes leave them out by a bounded set of the keys of all others.
    """
    context = rows.sparkSession.sparkContext
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    units = size if plan.unit == "byte" else size / 5
    bits = sketch_bits(units * 2 / (plan.size - plan.grams[0] + 2), most_bits)
    open_sets: list[HashSet] = []
    out: DataFrame | None = None
    kept: Broadcast | None = None
    if earlier and not (copies := copies_of_texts(rows, plan.size)).isEmpty():
        out, own = copies, F.xxhash64(*names_of(rows))
        others = materialize(rows.select(*names_of(rows)).join(copies, names_of(rows), "left_anti").select(own.alias("gram")), "first-texts")
        kept = context.broadcast(as_set(others, sketch_bits(8 * others.count(), 28)).packed())
        rows = rows.withColumn("own", own)
    for level in range(len(plan.grams)):
        twice, hot_set = count_grams(rows, plan, level, open_sets, sketch_rows, bits, hot, kept)
        hot_cells = CellList.of(hot_set)
        sets = context.broadcast([*(x.packed() for x in (*open_sets, twice)), (hot_cells.cells, hot_cells.bits)])
        found = materialize(group_runs(rows, plan, level, sets, earlier, kept), f"runs-{level}")
        sets.destroy()
        spans = found.filter("removed").select(*names_of(rows), "start", "n")
        out = spans if out is None else out.unionByName(spans)
        if level + 1 < len(plan.grams):
            open_sets.append(as_set(found.filter("gram IS NOT NULL").select("gram"), min(26, bits)))
        release(rows.sparkSession)  # shuffles of this pass
    return out


def per_text(spans: DataFrame) -> DataFrame:
    """All spans of a text in one row: its key and ``spans``; no more entries than the text has windows."""
    return spans.groupBy(*names_of(spans)).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(spans: pa.Scalar | None, units: int, size: int) -> np.ndarray:
    """Which of a text's units lie in a window of the spans; ``spans`` are ``(start, n)`` pairs."""
    change = np.zeros(units + 1, np.int64)
    if spans is not None and len(spans):
        flat = spans.flatten() if isinstance(spans, pa.StructArray) else spans
        start, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat)
        np.add.at(change, start, 1)
        np.add.at(change, start + n - 1 + size, -1)
    return np.cumsum(change[:-1]) > 0


def rebuilt(docs: DataFrame, key: list[Column], spans: DataFrame, rebuild) -> DataFrame:
    """``docs`` with the fields of ``rebuild(text, spans)``; input columns of the same names are replaced."""
    names = rebuild.returnType.names
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*kept).alias("row"), *key)
    joined = rows.join(spans.hint("shuffle_hash"), names_of(spans), "left")
    return joined.select("row", rebuild("text", "spans").alias("new")).select("row.*", "new.*")

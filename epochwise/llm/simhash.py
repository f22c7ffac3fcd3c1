"""Near-duplicates by 64-bit SimHash, with the codewords of a covering code as meeting points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm import runs
from epochwise.session import materialize

U = np.uint64
# Binary perfect codes, side by side over the 64 bits: length, generator polynomial, covering radius.
# Two Golay codes, a Hamming code and a repetition code.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))
RADIUS = sum(radius for _, _, radius in CODES)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text; the sums are made in pieces, so a very long text needs no more memory."""
    words = (text or "").encode().lower().split()  # both only touch ASCII here, white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    n = max(1, len(words) - shingle + 1)
    ones, piece = np.zeros(64, np.int64), 1 << 16
    for a in range(0, n, piece):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed) for g, _ in zip(grams, range(min(piece, n - a)))), U, min(piece, n - a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


class Cover:
    """Anchors of fingerprints: the codewords of the product of ``CODES``.

    Every 64-bit word has a home, its nearest codeword block by block, at most ``RADIUS`` bits away. Of the
    codewords within ``RADIUS + threshold`` bits of a word ``y``, ``near(y)`` lists those that are the home of some
    word within ``threshold`` bits of ``y``; no other anchor can bring ``y`` together with a partner.
    """

    def __init__(self, threshold: int = 2) -> None:
        if threshold not in (1, 2):
            raise ValueError("threshold has to be 1 or 2")
        self.threshold: int = threshold
        self.blocks: list[tuple] = []
        at = 0
        for length, generator, radius in CODES:
            self.blocks.append((at, length, *self._tables(length, generator, radius, threshold)))
            at += length

    @classmethod
    def of(cls, state: dict) -> Cover:
        """From ``vars`` of another: plain values can be broadcast, tables are made once."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    @staticmethod
    def _syndrome(words: np.ndarray, length: int, generator: int) -> np.ndarray:
        """Remainder of polynomials over GF(2)."""
        words, degree = words.copy(), generator.bit_length() - 1
        for bit in range(length - 1, degree - 1, -1):
            words ^= ((words >> U(bit)) & U(1)) * U(generator << (bit - degree))
        return words

    def _tables(self, length: int, generator: int, radius: int, threshold: int) -> tuple:
        patterns = [np.array([sum(1 << i for i in c) for c in combinations(range(length), w)], U) for w in range(max(radius, threshold) + 1)]
        errors = np.zeros(1 << (generator.bit_length() - 1), U)
        for p in patterns[radius::-1]:
            errors[self._syndrome(p, length, generator)] = p
        moves = []  # by number of flipped bits: for each syndrome, how the codeword can change
        for weight in range(1, threshold + 1):
            flips, syndromes = patterns[weight], self._syndrome(patterns[weight], length, generator)
            lists = []
            for s in range(len(errors)):
                change = np.unique(flips ^ errors[U(s) ^ syndromes] ^ errors[s])
                known = [U(0), *(moves[0][2][moves[0][0][s] : moves[0][0][s] + moves[0][1][s]] if moves else [])]
                lists.append(change[~np.isin(change, np.array(known, U))])
            n = np.array([len(x) for x in lists])
            moves.append((np.cumsum(n) - n, n, np.concatenate(lists)))
        return generator, errors, moves

    def home(self, words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for at, length, generator, errors, _ in self.blocks:
            part = (words >> U(at)) & U((1 << length) - 1)
            out ^= errors[self._syndrome(part, length, generator)] << U(at)
        return out

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a word and an anchor, for all anchors of all words."""
        home = self.home(words)
        syndromes = [self._syndrome((words >> U(at)) & U((1 << length) - 1), length, generator) for at, length, generator, _, _ in self.blocks]

        def moved(index: np.ndarray, anchor: np.ndarray, block: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
            at, _, _, _, moves = self.blocks[block]
            first, n, change = moves[weight - 1]
            s = syndromes[block][index]
            count = n[s]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[s], count)
            return np.repeat(index, count), np.repeat(anchor, count) ^ (change[place] << U(at))

        every = np.arange(len(words))
        out = [(every, home)]
        for b in range(len(self.blocks)):
            out += [moved(every, home, b, w) for w in range(1, self.threshold + 1)]
        if self.threshold == 2:
            for b, c in combinations(range(len(self.blocks)), 2):
                out.append(moved(*moved(every, home, b, 1), c, 1))
        return tuple(np.concatenate(x) for x in zip(*out))


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of different values of ``fp`` that differ in ``threshold`` bits or fewer, each once.

    ``prints`` has every value once. Each stays at its home anchor and is copied to the anchors where a
    partner may have its home (about 160), unless a bitmap of fixed size tells that nobody lives there. A pair meets at
    the home of its smaller member. The number of partners of a value is bounded by geometry (2,080),
    and so is the work at an anchor by the number of values within a few bits of it.
    """
    cover = prints.sparkSession.sparkContext.broadcast(vars(Cover(threshold)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cover.of(cover.value)
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield pa.record_batch([pa.array(own.home(fp.view(U)).view(np.int64)), pa.array(fp)], ["gram", "fp"])

    home = prints.mapInArrow(homes, "gram long, fp long")
    lived_in = prints.sparkSession.sparkContext.broadcast(runs.as_set(home.select("gram"), runs.sketch_bits(16 * prints.count(), 28)).packed())

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        own, homes_set = Cover.of(cover.value), runs.HashSet.unpacked(lived_in.value)
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for a in range(0, len(every), 4096):
                fp = every[a : a + 4096]
                index, anchor = own.near(fp.view(U))
                kept = homes_set.has(anchor)
                yield pa.record_batch([pa.array(anchor[kept].view(np.int64)), pa.array(fp[index[kept]])], ["gram", "fp"])

    other = prints.mapInArrow(copies, "gram long, fp long").withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.withColumnRenamed("fp", "a").join(other, "gram").filter(close).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: ``(node, root)`` for every node of an edge; the root is the smallest node.

    Every round a node and its root take the smallest root seen over their edges, then roots of roots are
    followed; the number of rounds grows with the logarithm of the longest path. Each round's table is
    written to the shared folder.
    """
    edges = materialize(edges, "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = materialize(ends.select("node", F.col("node").alias("root")), "roots")
    while True:
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        seen = edges.join(a, "a").join(b, "b").select(
            F.explode(F.array("a", "b", "ra", "rb")).alias("node"), F.least("ra", "rb").alias("root")
        )
        lower = roots.unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        lower = materialize(lower, "roots")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(lower.join(jump, "root").select("node", F.col("next").alias("root")), "roots")
        changed = new.join(roots.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        roots = new
        if not changed:
            return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """``id, tag, fp, root, component_id`` for every different row: its fingerprint and the component's, and the smallest id in it."""

    @F.arrow_udf("long")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in text], U).view(np.int64), pa.int64())

    ident, tag, _ = runs.identified(docs, id_col, text_col)
    prints = materialize(docs.select(F.col(id_col).alias("own"), ident, tag, fingerprint(text_col).alias("fp")), "prints")
    nodes = prints.groupBy("fp").agg(F.min("own").alias("least"))
    roots = components(links(nodes.select("fp"), threshold))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("id", "tag", "fp").distinct().join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint``, ``component_id`` and ``component_root``.

    The text's ASCII letters are lower-cased; shingles of ``shingle`` words (bytes other than 0x20, 0x09-0x0D),
    repeats included, are hashed by XXH64 with seed 42; a bit of the fingerprint is 1 if it is 1 in over
    half the hashes. Texts with fewer words are one shingle; null and empty texts have fingerprint zero.
    Fingerprints link at ``threshold`` or fewer differing bits. ``component_id`` is the smallest id reachable
    (null if all are null), ``component_root`` a fingerprint that names the component.

    Equal fingerprints are one row before anything is compared, so exact copies cost nothing more.
    Rows that repeat an id are documents of their own. Input columns of the new names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("fingerprint", "component_id", "component_root")]
    ident, tag, _ = runs.identified(docs, id_col, text_col)
    rows = docs.select(F.struct(*kept).alias("row"), ident, tag)
    found = classes(docs, id_col, text_col, threshold, shingle)
    new = found.select("id", "tag", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.lpad(F.lower(F.hex("root")), 16, "0").alias("component_root"))
    return rows.join(new.hint("shuffle_hash"), ["id", "tag"], "left").select("row.*", "fingerprint", "component_id", "component_root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """The document with the smallest id of every component, with the columns of ``docs``."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    kept = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).dropDuplicates(["component_root"])
    return kept.select(*docs.columns)

"""Alignment of two tokenizers over the same bytes, by interval coalescing."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.llm.runs import small_batches, worker_slot
from epochwise.session import materialize

BLOCK_CHARS = 8_000_000  # text of a block, whose texts share lists of pieces and of id pairs
BATCH_CHARS = 400_000  # text that is encoded and aligned at once
KNOWN_PIECES = 500_000  # pieces that a worker remembers from block to block

BLOCKS = """block long, doc_id array<long>, n_pieces array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>,
  groups array<string>, pair array<long>, pair_links array<long>, piece_links binary, piece_places binary, pieces binary"""
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def byte_letters() -> dict[str, int]:
    """Byte-level models write a byte as a character: visible ones as they are, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


CUT = re.compile(r"(?<=\S) (?=\S)")


class Both:
    """The two tokenizers with the bytes of each id, and the decimal of each id behind each separator."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.size = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)]
        self.n_b = len(b_bytes)
        self.n_ids = max(len(a_bytes), len(b_bytes))
        self.names = pa.array([mark + str(i) for mark in ("", ";", "|", ",") for i in range(self.n_ids)])
        # No token runs on over a single space between two words, so texts fall apart there.
        inner = any(re.search(r"[^\s] ", t.decode("utf-8", "replace")) for x in (a_bytes, b_bytes) for t in x)
        probe = "".join(pieces[i] for i in self.b.encode("a  b  ")).replace("▁", " ")
        self.may_cut = not inner and json.loads(a_json).get("normalizer") is None and probe == " a  b  "

    def parts(self, text: str) -> list[str]:
        """``text`` cut at single spaces between words; the space goes to no part, as each gets one in front."""
        return CUT.split(text) if self.may_cut else [text]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts one after another, and how many each text has."""
        lists = [[e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)]
        sizes = [np.array([len(x) for x in own], np.int64) for own in lists]
        return [(np.fromiter(itertools.chain.from_iterable(own), np.int64, n.sum()), n) for own, n in zip(lists, sizes)]


@dataclass
class Aligned:
    """Tokens of several texts over one row of bytes: groups, overlapping pairs, and the groups as text."""

    group: np.ndarray  # number of groups up to and including each text's
    a: np.ndarray  # pairs of overlapping tokens: place of A's, of B's, and whether they end together
    b: np.ndarray
    ends_together: np.ndarray
    start_of_pairs: np.ndarray  # first pair of each text
    spelled: bytes
    spelled_at: np.ndarray


def coalesce(both: Both, ids: list[np.ndarray], text_bytes: np.ndarray) -> Aligned:
    """Groups and overlaps of the tokens ``ids`` of A and B over texts that take ``text_bytes`` bytes one after another.

    All tokens are sorted by start; a group ends where a start reaches the running maximum of the ends before.
    Inside a group every pair of overlapping tokens is listed. Every text starts a group, as both have a token start there.
    """
    size = [n[x] for n, x in zip(both.size, ids)]
    end = [np.cumsum(n) for n in size]
    start = [e - n for e, n in zip(end, size)]
    side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    starts, ends = np.concatenate(start), np.concatenate(end)
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.empty(len(order), bool)
    opens[:1] = True
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    # B's tokens that overlap one of A's stand together: from the first that ends behind its start to the last that starts before its end.
    first, last = np.searchsorted(end[1], start[0], "right"), np.searchsorted(start[1], end[0], "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(n)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    together = end[0][a] == end[1][b] if len(a) else np.zeros(0, bool)
    text_end = np.cumsum(text_bytes)
    # The groups in writing: A's ids, a bar, B's ids; a semicolon between groups.
    spell = np.lexsort((starts, side, group))
    g, s = group[spell], side[spell]
    mark = np.full(len(spell), 3)
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    mark[new] = 1
    mark[np.concatenate(([False], (s[1:] == 1) & (s[:-1] == 0))) & ~new if len(g) else new] = 2
    mark[new & np.isin(starts[spell], np.concatenate(([0], text_end)))] = 0
    names = both.names.take(pa.array(mark * both.n_ids + np.concatenate(ids)[spell]))
    _, offsets, data = names.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(names) + 1].astype(np.int64)
    tokens_before = np.concatenate(([0], sum(np.searchsorted(e, text_end, "right") for e in end)))
    group_before = np.concatenate((group[spell], [int(opens.sum())]))[tokens_before]
    pair_start = np.searchsorted(a, np.concatenate(([0], np.searchsorted(end[0], text_end, "right"))), "left")
    return Aligned(group_before, a, b, together, pair_start, data.to_pybytes() if data is not None else b"", offsets[tokens_before])


class Places(dict):
    """Numbers of strings in the order in which they are met; new ones wait in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        out = self[key] = len(self)
        return out


class Store:
    """Alignments of different pieces, by number: columns of counts, links one after another, and groups in writing (None if not spelled)."""

    def __init__(self) -> None:
        self.places, self.spelled = Places(), []
        self.columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]

    def column(self, k: int) -> np.ndarray:
        """0 to 2: tokens of A, of B, groups; 3: links; 4: codes of all links."""
        if len(self.columns[k]) > 1:
            self.columns[k] = [np.concatenate(self.columns[k])]
        return self.columns[k][0]

    def align(self, both: Both, most: int) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        part, size = [], 0
        for p in fresh:
            part.append(p)
            size += len(p)
            if size >= most:
                self._add(both, part)
                part, size = [], 0
        self._add(both, part)

    def _add(self, both: Both, parts: list[str]) -> None:
        if not parts:
            return
        encoded = both.encode(parts)
        raw = [(" " + t).encode() for t in parts]
        long = np.array([len(r) for r in raw])
        fits = np.ones(len(parts), bool)
        for (ids, n), size in zip(encoded, both.size):
            fits &= _stretches(size[ids], np.concatenate(([0], np.cumsum(n)))) == long
        chosen = [(ids[np.repeat(fits, n)], n * fits) for ids, n in encoded]
        spelled = [joined(table, ids) for table, (ids, _) in zip(both.bytes, chosen)]
        whole = b"".join(r for r, ok in zip(raw, fits.tolist()) if ok)
        if any(x != whole for x in spelled):
            at = np.concatenate(([0], np.cumsum(long * fits))).tolist()
            fits &= [all(x[a:b] == r for x in spelled) for a, b, r in zip(at, at[1:], raw)]
            chosen = [(ids[np.repeat(fits, n)], n * fits) for ids, n in encoded]
        found = coalesce(both, [ids for ids, _ in chosen], (long * fits)[fits])
        kept = found.ends_together
        links_at = np.concatenate(([0], np.cumsum(kept)))[found.start_of_pairs]
        groups, links = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        groups[fits], links[fits] = np.diff(found.group), np.diff(links_at)
        code = chosen[0][0][found.a[kept]] * both.n_b + chosen[1][0][found.b[kept]]
        for own, new in zip(self.columns, (chosen[0][1], chosen[1][1], groups, links, code)):
            own.append(new)
        at = iter(found.spelled_at.tolist())
        end = next(at)
        for ok in fits.tolist():
            if ok:
                start, end = end, next(at)
                self.spelled.append(found.spelled[start:end])
            else:
                self.spelled.append(None)


class Block:
    """Texts as rows of pieces; every different piece is aligned once, in batches of bounded size."""

    def __init__(self, both: Both, batch_chars: int, with_groups: bool, store: Store | None = None) -> None:
        self.both, self.most, self.with_groups, self.store = both, batch_chars, with_groups, store or Store()
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        places = self.store.places
        self.texts.append(np.array([places[p] for p in self.both.parts(text)] if text else [], np.int64))
        self.chars += len(text or "")
        if len(places.fresh) >= 50_000 or len(text or "") >= self.most:
            self.store.align(self.both, self.most)

    def row(self, number: int) -> pa.RecordBatch:
        store = self.store
        store.align(self.both, self.most)
        links, writing = store.column(3), store.spelled
        bad = np.array([x is None for x in writing], bool)
        rows = [x[:0] if bad[x].any() else x for x in self.texts]
        sizes = np.array([len(x) for x in rows], np.int64)
        every = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        counts = [_stretches(store.column(c)[every], at) for c in range(4)]
        texts = [b";".join([writing[i] for i in x.tolist()]) for x in rows]
        # Pieces of this block alone, the most frequent first, so that their numbers are small and pack well.
        times = np.bincount(every, minlength=len(writing))
        own = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
        rank = np.zeros(len(writing), np.int64)
        rank[own] = np.arange(len(own))
        n = links[own]
        begin = (np.cumsum(links) - links)[own]
        codes = store.column(4)[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, place = np.unique(codes, return_inverse=True)
        pair_links = np.bincount(place, np.repeat(times[own], n), len(pair)).astype(np.int64)
        values = [
            number, self.ids, sizes, *counts, [hashlib.sha256(t).hexdigest() if len(x) else "" for t, x in zip(texts, rows)],
            [t.decode() for t in texts] if self.with_groups else None, pair, pair_links, packed(n), packed(place), packed(rank[every]),
        ]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 6, *[pa.list_(pa.string())] * 2, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCKS.split(",")])


def _stretches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``at[i]`` to ``at[i + 1]``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte, so that the zeros of small ones stand together."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def joined(table: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of tokens, one after another."""
    _, offsets, data = table.take(pa.array(ids)).buffers()
    return data.to_pybytes()[: np.frombuffer(offsets, np.int32)[len(ids)]] if len(ids) else b""


def encode_blocks(
    docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, batch_chars: int = BATCH_CHARS, with_groups: bool = False
) -> DataFrame:
    """Texts in blocks, a row each: counts and groups of every text, its pieces, the pieces' links, and the block's distinct linked id pairs.

    A block holds texts of one task up to ``block_chars`` characters, a longer text alone. Stored, as pieces and links are numbered within a block.
    """
    sent = docs.sparkSession.sparkContext.broadcast((a_json, b_model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(zlib.crc32(x if isinstance(x, bytes) else x.encode()) for x in sent.value)
        both, held = worker_slot("both_tokenizers", key, lambda: (Both(*sent.value), [Store()]))
        number = TaskContext.get().partitionId() << 32

        def opened() -> Block:
            if len(held[0].places) > KNOWN_PIECES:
                held[0] = Store()
            return Block(both, batch_chars, with_groups, held[0])

        block = opened()
        for batch in small_batches(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                block.add(i, text)
                if block.chars >= block_chars:
                    yield block.row(number)
                    number, block = number + 1, opened()
        if block.ids:
            yield block.row(number)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(task, BLOCKS), "aligned")


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``(pair, count, best)`` over all texts: links of an id pair, and whether no other pair of the same B id has more.

    A pair is ``A id * n_b + B id``. A block brings each of its pairs once, so a pair that links everywhere costs one row a block.
    """
    pairs = blocks.select(F.explode(F.arrays_zip("pair", "pair_links")).alias("p")).groupBy("p.pair").agg(F.sum("p.pair_links").alias("count"))
    counts = materialize(pairs, "pair-counts")
    # One row for each id of B at most: bounded by its vocabulary.
    top = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), F.col("pair") % n_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, batch_chars: int = BATCH_CHARS, with_groups: bool = False
) -> DataFrame:
    """Alignment of a byte-level BPE (A, a tokenizers file) and a sentencepiece model (B) over every text.

    A encodes a space and the text, B the text, in front of which it puts a space itself. One row for each row of ``docs``:
    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and ``groups``, the alignment in writing
    (``a1,a2|b1;a3|b2,b3``), null unless ``with_groups``.

    Links are the overlapping A-B tokens that end together; the count of an id pair is the number of its links in all
    texts. ``n_best`` counts links whose pair has the highest count of its B id, ties included; ``count_sum`` sums the counts.

    Null and empty texts, and texts that the tokens of A or B do not spell (a normaliser changed them), have zeros and
    an empty string. Rows with null or repeated ids, and equal rows, are each a text of their own. Other columns are
    not carried and may have any name. Both tokenizers have a boundary at a single space between words (the vocabularies
    are searched for exceptions), so texts are cut there and equal pieces are encoded and aligned once.

    Plan: one pass writes the blocks; pairs are counted from one row per block and pair; counts go back to the
    blocks by a join on the pair, and blocks meet their counts by block number. No text is read twice.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    return measured(spark, encode_blocks(docs, a_json, b_model, id_col, text_col, block_chars, batch_chars, with_groups), b_model)


def measured(spark: SparkSession, blocks: DataFrame, b_model: bytes) -> DataFrame:
    """The rows of :func:`align` from stored blocks."""
    import sentencepiece

    counts = pair_counts(blocks, sentencepiece.SentencePieceProcessor(model_proto=b_model).GetPieceSize())
    wanted = blocks.select("block", F.posexplode("pair").alias("place", "pair"))
    looked_up = wanted.join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["place"].to_numpy()
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        place, at = unpacked(block["piece_places"]), np.concatenate(([0], np.cumsum(unpacked(block["piece_links"]))))
        pieces, ends = unpacked(block["pieces"]), np.concatenate(([0], np.cumsum(block["n_pieces"], dtype=np.int64)))
        sums = [_stretches(_stretches(x[place], at)[pieces], ends) for x in (best, count)]
        groups = block["groups"] or [None] * len(block["doc_id"])
        columns = [block["doc_id"], block["n_a"], block["n_b"], block["n_groups"], block["n_links"], *sums, block["digest"], groups]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RESULT.split(",")])

    return blocks.drop("pair", "pair_links").groupBy("block").cogroup(looked_up.groupBy("of")).applyInArrow(task, RESULT)

"""Repeated word windows, byte strings and line windows against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import counted, edge_rows, table, words
from pyspark.sql import functions as F

from epochwise.llm import lines, runs, substrings, suffixes

LAST = 1 << 63


def kept_words(rows, size):
    seen = Counter(tuple(w[i : i + size]) for w in (words(t) for _, t in rows) for i in range(len(w) - size + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(size)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("size", [5, 35])
def test_word_windows(spark, size):
    rows = edge_rows()
    got = substrings.drop_repeated_windows(table(spark, rows), window=size, anchor=3)
    assert set(got.columns) >= {"lang", "id", "spans", "n_words"}
    assert counted(got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == counted(kept_words(rows, size))


def kept_bytes(rows, size):
    least = {}
    order = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in order:
        for k in range(len(t) - size + 1):
            s = t[k : k + size]
            least[s] = min(least.get(s, i), i)
    out = []
    for (own, _), (i, t) in zip(rows, order):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - size + 1):
            if least[t[k : k + size]] < i:
                gone[k : k + size] = True
        out.append((own, len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_byte_strings(spark):
    rows = edge_rows()
    got = suffixes.drop_earlier_strings(table(spark, rows))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes").collect()]
    assert counted(got) == counted(kept_bytes(rows, 50))
    with pytest.raises(ValueError):
        suffixes.drop_earlier_strings(table(spark, rows), digits=(20, 40))


def test_hot_anchors_take_the_same_way(spark):
    """Everything counts as hot: runs are dealt by content and go through all passes."""
    rows = edge_rows()
    docs = table(spark, rows)
    key = runs.keyed(docs, "doc_id", "text")
    plan = runs.Plan("word", 35, (8, 35))
    spans = [runs.per_text(runs.repeated_spans(docs.select(*key), plan, False, 2, 20, hot=h)) for h in (2, 4096)]
    flat = [x.select("id", "tag", "more", F.explode("spans").alias("s")).select("id", "tag", "more", F.explode(F.expr("sequence(s.start, s.start + s.n - 1)"))).distinct() for x in spans]
    assert counted(flat[0].collect()) == counted(flat[1].collect())


def kept_lines(rows, size=3):
    """Equal rows are one document."""
    key = lambda r: (LAST if r[0] is None else r[0],)
    first = {}
    parts = {r: [] if r[1] is None else r[1].split("\n") for r in set(rows)}
    for r in sorted(parts, key=key):
        for k in range(len(parts[r]) - size + 1):
            first.setdefault(tuple(parts[r][k : k + size]), (r, k))
    out = []
    for r in rows:
        x = parts[r]
        gone = {k + j for k in range(len(x) - size + 1) if first[tuple(x[k : k + size])] != (r, k) for j in range(size)}
        out.append((r[0], len(x), len(gone), "\n".join(v for k, v in enumerate(x) if k not in gone)))
    return out


def test_line_windows(spark):
    rows = edge_rows()
    got = lines.drop_repeated_line_windows(table(spark, rows)).select("doc_id", "n_lines", "n_removed_lines", "kept_text")
    assert counted(got.collect()) == counted(kept_lines(rows))


def test_empty_tables(spark):
    none = table(spark, [])
    for got in (substrings.drop_repeated_windows(none), suffixes.drop_earlier_strings(none), lines.drop_repeated_line_windows(none)):
        assert got.count() == 0
    one = table(spark, [(1, None)])
    assert substrings.drop_repeated_windows(one).select("n_words", "n_removed", "kept_text").collect() == [(0, 0, "")]
    assert suffixes.drop_earlier_strings(one).select("n_bytes", "n_spans").collect() == [(0, 0)]


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(0)
    np.seterr(over="ignore")
    raw = rng.integers(97, 99, 200_000).astype(np.uint8)
    at = np.array([0, 30, 30, 79, 150_000, 200_000])
    plan = runs.Plan("byte", 50, (20, 50))
    seen = np.zeros(len(raw), int)
    for found in runs.find_runs(plan, raw, at):
        for d, a, n in zip(found.doc, found.start, found.count):
            seen[at[d] + a : at[d] + a + n] += 1
    want = np.zeros(len(raw), int)
    for a, b in zip(at, at[1:]):
        want[a : max(a, b - 49)] = 1
    assert (seen == want).all()


def test_word_hashes_follow_content():
    np.seterr(over="ignore")
    raw = np.frombuffer("ab\tcd ab\x0babcd ééab ab".encode(), np.uint8)
    start, end, first, (h,) = runs.words(raw, np.array([0, 5, len(raw)]), (1,))
    found = [bytes(raw[a:b]) for a, b in zip(start, end)]
    assert found == raw.tobytes().split() and first.tolist() == [0, 2, len(found)]
    assert len(set(h.tolist())) == len(set(found))
    assert hashlib.md5(h.tobytes()).hexdigest() == hashlib.md5(runs.words(raw, np.array([0, len(raw)]), (1,))[3][0].tobytes()).hexdigest()


def test_a_full_sketch_still_tells_what_repeats():
    """More values than cells: only the cells of repeated values are in the set, however they were split over batches."""
    rng = np.random.default_rng(4)
    once, again = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400_000, 500))
    with np.errstate(over="ignore"):
        parts = [list(runs.sketch_batches(iter(np.array_split(np.concatenate((x, again)), 7)), 1, 16, 30_000, True)) for x in np.array_split(once, 3)]

        class Merged:  # the exchange and the driver's loop, without Spark
            def repartition(self, _):
                return self

            def mapInArrow(self, f, _):
                self.rows = [r for b in f(iter([b for p in parts for b in p])) for r in b.to_pylist()]
                return self

            def toLocalIterator(self, prefetchPartitions):
                return iter(self.rows)

        twice, often = runs.merge_sketches(Merged(), 1, 16, 3, True)
        assert twice.has(again).all() and often.has(again).all()
        assert twice.has(once).mean() < 0.02


def test_copies_of_whole_texts_are_not_cut_into_runs(spark, monkeypatch):
    """Six copies of every text cost as many runs as one; texts under one id, without id and shorter than a string included."""
    rng = random.Random(13)
    one = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60 + k)) for k in range(20)]
    base = [*one, one[0][:200] + one[1][100:], "short", "x" * 49, "y" * 50]
    once = [(10 * k, t) for k, t in enumerate(base)]
    many = [(1000 * c + i, t) for c in range(6) for i, t in once] + [(None, one[2]), (None, one[2]), (None, one[3] + " more"), (10, one[4])]
    stored, write = [], runs.materialize

    def noted(df, name="stage", **more):
        out = write(df, name, **more)
        if name.startswith("runs-"):
            stored.append(out.count())
        return out

    monkeypatch.setattr(runs, "materialize", noted)
    for rows in (once, many):
        got = suffixes.drop_earlier_strings(table(spark, rows).repartition(3))
        assert counted((r["doc_id"], bytes(r["kept_bytes"])) for r in got.collect()) == counted((r[0], r[4]) for r in kept_bytes(rows, 50)), stored
    assert sum(stored[3:]) <= sum(stored[:3]) + 40, stored

"""The pipeline's near-dedup stage against a comparison of all pairs."""

import random

import numpy as np
from helpers import edge_rows, passage, table, words

import corpus_pipeline
from epochwise.llm import shingles, simhash


def sets_of(rows, size=5):
    out = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return out


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_force(rows):
    sets, group = sets_of(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    last = 1 << 63
    return sorted(min(last if rows[k][0] is None else rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def kept_ids(spark, rows):
    got = corpus_pipeline.one_of_near_duplicates(spark, table(spark, rows), "")
    assert got.columns == table(spark, []).columns
    return sorted(1 << 63 if r["doc_id"] is None else r["doc_id"] for r in got.collect())


def test_pairs_of_similarity_0_8(spark):
    rng, rows, far = random.Random(5), edge_rows(), 0
    for k in range(60):
        long = passage(rng, 300)
        other = list(long)
        for p in rng.sample(range(5, 295), 6 + k % 3):  # similarity of about 0.77 to 0.82
            other[p] = f"new{p}"
        rows += [(1000 + 2 * k, " ".join(long)), (1001 + 2 * k, " ".join(other))]
        a, b = sets_of(rows[-2:])
        far += similarity(a, b) >= 0.8 and (simhash.fingerprint_of(rows[-1][1]) ^ simhash.fingerprint_of(rows[-2][1])).bit_count() > 2
    assert far > 10
    assert kept_ids(spark, rows) == brute_force(rows)


def test_chains_and_large_groups(spark):
    rng = random.Random(6)
    long = passage(rng, 200)
    rows = [(k, " ".join([f"step{j}" for j in range(k)] + long[k:])) for k in range(0, 120, 8)]  # neighbours are linked, ends are not
    rows += [(1000 + k, " ".join(long[:100] + passage(rng, 14 + k % 5))) for k in range(60)]  # a common passage, similarity on both sides of 0.8
    assert kept_ids(spark, rows) == brute_force(rows)


def test_equality_counts(spark):
    w = [f"w{k}" for k in range(200)]
    a, b, c = " ".join(w[:13]), " ".join(w[1:14]), " ".join(w[:12])  # 8 of 10 shingles, 8 of 9
    assert similarity(*sets_of([(1, a), (2, b)])) == 0.8
    assert kept_ids(spark, [(1, a), (2, b)]) == [1] and kept_ids(spark, [(5, a), (4, a.upper()), (6, c)]) == [4]
    x, y = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    sets = spark.createDataFrame([(1, bytearray(x.tobytes())), (2, bytearray(y.tobytes()))], "node long, grams binary")
    assert shingles._similar(spark.createDataFrame([(1, 2)], "a long, b long"), sets, 0.8).filter("same").count() == 1
    assert kept_ids(spark, []) == []


def test_a_common_passage_proposes_nothing(spark):
    """Documents with 200 words in common and 60 of their own (similarity 0.62): no growth with the square of their number."""
    rng = random.Random(7)
    common = passage(rng, 200)
    for n in (200, 400):
        rows = [(k, " ".join([*common, *(f"own{k}x{j}" for j in range(60))])) for k in range(n)]
        counted = []
        kept = shingles.one_of_each(table(spark, rows).repartition(3), counted=counted)
        assert kept.count() == n and sum(counted) <= 2 * n, counted


def test_pairs_compared_in_a_large_group_of_copies(spark):
    rng = random.Random(11)
    long = passage(rng, 150)
    for n in (100, 200):
        rows = [(k, " ".join([*long[: k % 140], f"new{k}", *long[k % 140 + 1 :]])) for k in range(n)]
        counted = []
        assert [r["doc_id"] for r in shingles.one_of_each(table(spark, rows), counted=counted).collect()] == [0]
        assert sum(counted) <= 4 * n, counted


def test_rows_and_first_comparisons_come_from_the_simhash_operator(spark, monkeypatch):
    """Copies of a group are compared with the document that ``component_id`` names; a row that the operator does not return is no row of the stage."""
    rng, rows = random.Random(12), []
    for g in range(8):
        long = passage(rng, 300)
        rows += [(100 * g + k, " ".join([*long, *["more"] * k])) for k in (7, 3, 5, 9)]  # repeats: other sets only by their last shingles
    rows += [(5000, "a text of its own that is like no other one"), (None, None)]
    name_of = {k: shingles.node_of(shingles.grams_of(t, 5, shingles.Hashes())) for k, t in rows}
    first, compare = [], shingles.Groups.compare

    def noted(self, pairs):
        if not first:
            first.append({(r["a"], r["b"]) for r in pairs.collect()})
        return compare(self, pairs)

    monkeypatch.setattr(shingles.Groups, "compare", noted)
    assert kept_ids(spark, rows) == brute_force(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, rows), shingle=5).collect()}
    want = {(name_of[c], name_of[k]) for k, c in found.items() if name_of[k] != name_of[c]}
    assert len(want) > 4 and first[0] == want
    whole = shingles.classes
    monkeypatch.setattr(shingles, "classes", lambda *a: whole(*a).filter("id <> 5000"))
    assert kept_ids(spark, rows) == [k for k in brute_force(rows) if k != 5000]


def test_parity_bits_never_exclude_a_pair():
    rng = np.random.default_rng(3)
    for n in (3, 40, 900, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in (0, 1, n // 9, n // 3):
            b = np.concatenate((a[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)))
            x, y = (shingles.parity_of(np.unique(v)).view(np.uint64) for v in (a, b))
            differ = sum(int(p ^ q).bit_count() for p, q in zip(x, y))
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_prefixes_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(200, n, replace=False).tolist())
        b = set(list(a)[: int(rng.integers(0, n + 1))]) | set(rng.choice(200, int(rng.integers(0, 12)), replace=False).tolist())
        if b and similarity(a, b) >= 0.8:
            order = rng.permutation(200)
            x, y = (sorted(v, key=lambda e: order[e])[: shingles.prefix_length(len(v), 0.8)] for v in (a, b))
            assert set(x) & set(y)

"""Quality, leaks, near-duplicates, toxicity, packing, token files, WARC audit and pipeline on small tables."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import counted, edge_rows, passage, table, words
from pyspark.sql import functions as F

import corpus_pipeline
from epochwise.llm import decontaminate, packing, quality, simhash, tokenfiles, toxicity, warc

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def base_counts(text):
    w, covered = words(text), set()
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def xx(*values):
    """Spark's xxhash64 of strings and longs, chained from seed 42."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def test_quality(spark):
    rows = list(dict.fromkeys(edge_rows())) + [(900, "#*$ | <b> & " * 8), (901, "one two three four five six seven eight nine ten eleven")]
    docs = table(spark, rows)
    good = spark.createDataFrame([(k,) for k in (0, 3, 6, 9, 9, 900_000)], "doc_id long")
    got = {(r[0], r[1]): r for r in quality.judge(docs, good, threshold=-0.05).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept").collect()}
    size = quality.BUCKETS

    def grams(text):
        h = [xx(w) for w in words(text)]
        return [x % size for x in h] + [xx(a, b) % size for a, b in zip(h, h[1:])]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in (0, 3, 6, 9):
            target.update(grams(t))
    weight = lambda g: math.log((target[g] + 1) / (target.total() + size)) - math.log((raw[g] + 1) / (raw.total() + size))
    assert len(got) == len(rows)
    for i, t in rows:
        n = base_counts(t)
        r = got[i, n[0]]
        assert tuple(r[1:6]) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert r["base_failed"] == failed
        g = grams(t)
        if g:
            llr = sum(map(weight, g)) / len(g)
            assert r["llr"] == pytest.approx(llr, abs=1e-9) and r["kept"] == (not failed and llr >= -0.05)
        else:
            assert r["llr"] is None and not r["kept"]
    assert quality.judge(table(spark, []), good).count() == 0


def test_quality_cut_follows_the_trusted(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(passage(rng, 60))) for k in range(200)] + [(1000 + k, " ".join(rng.choice("qwxz") + str(rng.randrange(9)) for _ in range(60))) for k in range(50)]
    good = spark.createDataFrame([(k,) for k in range(100)], "doc_id long")
    for share in (0.02, 0.3):
        got = quality.judge(table(spark, rows), good, trusted_share=share).collect()
        known = sorted(r["llr"] for r in got if r["doc_id"] < 100 and not r["base_failed"])
        cut = known[math.ceil(share * len(known)) - 1]
        assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= cut) for r in got)
        assert not any(r["kept"] for r in got if r["doc_id"] >= 1000)
    none = quality.judge(table(spark, rows), good.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, " ".join(passage(rng, n))) for k, n in enumerate((15, 16, 20, 45, 9))] + [(7, None), (8, ""), (None, " ".join(passage(rng, 30)))]
    w = {k: t.split() for k, t in items if t}

    def spoiled(x, places):
        return [f"other{p}" if p in places else v for p, v in enumerate(x)]

    filler = passage(rng, 60)
    rows = [
        (1, " ".join(filler + w[1] + filler)), (2, " ".join(spoiled(w[1], (2, 7, 11)) + filler)), (3, " ".join(spoiled(w[1], (2, 5, 7, 11)) + filler)),
        (4, " ".join(filler[:9] + w[3][20:36])), (5, " ".join(w[3][20:35])), (6, " ".join(spoiled(w[0], (0, 6, 14)))), (7, " ".join(filler * 200 + w[2])),
        (8, None), (9, ""), (10, " ".join(filler)), (None, " ".join(w[None])), (12, " ".join(w[4])), (1, " ".join(filler + w[1] + filler)),
    ]
    got = decontaminate.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_compared"], r["start"]) for r in got.collect()}
    assert found == {
        (1, 1): (16, 16, 60), (2, 1): (13, 16, 0), (4, 3): (16, 16, 9 - 20), (6, 0): (12, 15, 0), (7, 2): (16, 16, 12_000), (None, None): (16, 16, 0), (12, 4): (9, 9, 0),
    }
    assert {r["doc_id"] for r in decontaminate.drop_leaking(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()} == {3, 5, 8, 9, 10}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(table(spark, rows), nothing).count() == 0 and decontaminate.find_leaks(table(spark, []), nothing).count() == 0


def test_masks_reach_all_substitutions():
    from itertools import combinations

    for n, errors in ((16, 3), (15, 3), (14, 2), (13, 2), (9, 1)):
        for bad in combinations(range(n), errors):
            assert any(all(o + p not in bad for p in m) for m in decontaminate.MASKS for o in range(n - m[-1])), (n, bad)


def test_seeds_reach_every_length():
    """Whatever substitutions are allowed in an item of 1 to 16 words, some seed of it stays whole."""
    from itertools import combinations

    for n in range(1, 17):
        errors = n - math.ceil(0.8 * n - 1e-9)
        blocks = decontaminate.blocks_of(n) if n <= decontaminate.SHORT else []
        for bad in combinations(range(n), errors):
            whole = any(all(o + p not in bad for p in m) for m in decontaminate.MASKS for o in range(n - m[-1]))
            assert whole or any(not set(range(a, b)) & set(bad) for a, b in blocks), (n, bad)


def test_short_items(spark):
    rng = random.Random(12)
    items = [(n, " ".join(f"it{n}w{k}" for k in range(n))) for n in range(1, 13)]
    filler = passage(rng, 20)
    rows = [(n, " ".join([*filler, *t.split(), *filler]).upper()) for n, t in items]
    for n, t in items[4:]:  # one word replaced, at either end and inside
        for p in (0, n // 2, n - 1):
            rows.append((100 * n + p, " ".join([*filler, *(w if k != p else "other" for k, w in enumerate(t.split())), *filler])))
    rows.append((9999, " ".join([*filler, "it4w0 it4w1 it4w2 other", *filler])))
    got = decontaminate.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i if i < 100 else i // 100) for i, _ in rows if i != 9999}


def test_leaks_by_row_not_by_id(spark):
    rng = random.Random(13)
    item = passage(rng, 20)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(1, " ".join(item)), (1, "clean"), (None, " ".join(item) + " more"), (None, "clean too"), (None, None)]
    docs = table(spark, rows).withColumn("leaking", F.lit("theirs")).withColumn("item", F.lit("theirs"))
    kept = decontaminate.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["leaking"]) for r in kept.collect()} == {(1, "clean", "theirs"), (None, "clean too", "theirs"), (None, None, "theirs")}


def test_stages_keep_columns_and_rows(spark, tmp_path):
    """Names that the operators give or use inside, repeated and null ids, a very long text."""
    rng = random.Random(14)
    names = ["score", "predicted", "held_out", "n_lines", "n_removed_lines", "kept_text", "row", "leaking", "item", "root", "node", "keys", "tag", "id", "h", "w"]
    texts = [" ".join(passage(rng, 40)) for _ in range(12)] + [" ".join(passage(rng, 60_000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, " ".join(passage(rng, 30))), (None, " ".join(passage(rng, 30))), (None, " ".join(passage(rng, 30)))]
    docs = spark.createDataFrame([(i, t, *[777] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage(rng, 20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *names], name
        assert counted((r["doc_id"], r["text"]) for r in docs.collect()) == counted(rows), name
        assert docs.filter(" OR ".join(f"`{n}` <> 777" for n in names)).isEmpty(), name


def test_covering_code():
    np.seterr(over="ignore")
    cover = simhash.Cover(2)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    index, anchor = cover.near(x)
    near = [set(anchor[index == k].tolist()) for k in range(len(x))]
    assert max(int(v).bit_count() for v in x ^ cover.home(x)) <= simhash.RADIUS
    assert max(int(v).bit_count() for v in x[index] ^ anchor) <= simhash.RADIUS + 2
    flips = [1 << a | 1 << b for a in range(64) for b in range(a, 64)] + [0]
    for k in range(len(x)):
        assert set(cover.home(np.array([int(x[k]) ^ f for f in flips], np.uint64)).tolist()) == near[k]


def test_near_duplicates(spark):
    rows = edge_rows()
    long = passage(random.Random(9), 400)
    rows += [(100 + k, " ".join(long[:k] + ["new"] + long[k:])) for k in range(0, 120, 4)]

    def fingerprint(t):
        w = [x.lower() for x in words(t)]
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    got = simhash.near_duplicates(table(spark, rows)).select("doc_id", "fingerprint", "component_id")
    assert counted(got.collect()) == counted((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    assert len(set(group)) < len(set(prints))
    one = simhash.one_of_each(table(spark, rows))
    assert sorted(map(str, (r["doc_id"] for r in one.collect()))) == sorted(str(least[g]) for g in set(group))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a <> 120")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(k, 0 if k <= 120 else 121) for k in range(201)}


def test_toxicity(spark):
    rng = random.Random(2)
    plain = lambda n: passage(rng, n)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = plain(rng.randrange(20, 120))
        for _ in range(2 if bad else 0):
            w[rng.randrange(len(w))] = "badword" + rng.choice("abcdefgh") + rng.choice("xyz")
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(1000, ""), (1001, None), (1002, "badwordqq " * 3), (None, "calm")]
    own = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    small = toxicity.Settings(per_class=150, least_docs=3)
    got = {r["doc_id"]: r for r in toxicity.classify(table(spark, rows), own, settings=small).select("doc_id", "held_out", "score", "predicted").collect()}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[1002]["predicted"] == 1 and got[1000]["score"] == got[1001]["score"] < 0.3
    one = toxicity.classify(table(spark, rows), own.filter("toxic = 0"), settings=small)
    assert one.filter("predicted = 1").count() == 0
    assert toxicity.classify(table(spark, []), own.limit(0), settings=small).count() == 0


def test_many_toxic_words_and_calm_ones(spark):
    """A thousand toxic stems, none of them frequent, share n-grams with misspellings; some words speak for the other label."""
    rng = random.Random(21)
    stems = ["vile" + "".join(rng.choice("aeiou") + rng.choice("bdfgk") for _ in range(2)) for _ in range(1000)]
    rows, labels = [], []
    for k in range(1200):
        bad = k % 3 == 0
        w = passage(rng, rng.randrange(20, 60))
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(stems) if bad else "gentle" + rng.choice("xyz")
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(5000, " ".join(passage(rng, 60) + [rng.choice(stems) + "qq" for _ in range(4)])), (5001, " ".join(passage(rng, 150_000))), (5002, "gentlex gentley " * 10)]
    rows += [rows[0]] * 30 + [(3, "another text of a labelled id " + rows[3][1])] * 5
    docs = table(spark, rows).withColumn("score", F.lit("theirs")).withColumn("y", F.lit("theirs"))
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(docs, own).select("doc_id", "score", "predicted", "held_out").collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5000]["predicted"] == 1 and by_id[5002]["predicted"] == 0
    none = toxicity.classify(docs, own.limit(0)).select("predicted").distinct().collect()
    assert [r[0] for r in none] == [0]


def test_telling_subwords_follow_the_labels():
    s = toxicity.Settings(buckets=1 << 10)
    rng = np.random.default_rng(0)
    labels = np.repeat([0, 1], 300)
    texts = [np.unique(np.concatenate((rng.integers(0, 900, 40), [901] if y else [902], [903]))) for y in labels]
    bags = toxicity.Bags(np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.concatenate(texts), np.ones(sum(map(len, texts)), np.float32))
    kept = toxicity.telling(bags, labels, s)
    assert {901, 902} <= set(kept.tolist()) and 903 not in kept and len(kept) <= 6
    assert len(toxicity.telling(bags, rng.permutation(labels), s)) <= 2


def test_best_fit():
    rng = random.Random(1)
    sizes = (64, 128, 256)
    lengths = sorted((rng.randrange(1, 257) for _ in range(300)), reverse=True)
    for prefer in (None, *sizes):
        bins, places, final = packing.best_fit(lengths, sizes, prefer)
        used = [0] * len(final)
        for n, b, p in zip(lengths, bins, places):
            assert p == used[b]
            used[b] += n
        assert all(u <= c and not any(s >= u and s < c for s in sizes) for u, c in zip(used, final))
    # Where one size exists, it is plain best fit.
    bins, _, _ = packing.best_fit(lengths, (256,))
    free, want = [], []
    for n in lengths:
        fits = [(f, b) for b, f in enumerate(free) if f >= n]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(256)
        free[b] -= n
        want.append(b)
    assert bins == want


def test_packing(spark):
    rows = edge_rows()
    got = packing.pack(table(spark, rows), capacities=(16, 64, 256), group_rows=20).toPandas()
    per_bin = got.groupby("bin_id").agg(n=("n_tokens", "sum"), c=("capacity", "max"), least=("capacity", "min"))
    assert (per_bin.n <= per_bin.c).all() and (per_bin.c == per_bin.least).all()
    for _, b in got.sort_values("bin_start").groupby("bin_id"):
        assert (b.bin_start == b.n_tokens.cumsum() - b.n_tokens).all()
    assert got.n_tokens.sum() == sum(len(words(t)) + 1 for _, t in rows) and (got.n_tokens > 0).all()
    long = got[got.doc_id == max(i for i, t in rows if t and len(t) > 100_000)].sort_values("piece")
    assert (long.start == long.n_tokens.cumsum() - long.n_tokens).all() and len(long) == math.ceil(30_001 / 256)
    assert packing.pack(table(spark, [])).count() == 0
    assert packing.pack(table(spark, rows), n_tokens=F.lit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in dict.fromkeys(edge_rows()) if r[0] is not None and r != (5, "another text under an id that is taken " * 3)]
    rows += [(200, "it's \x1c a b c é É <|endoftext|> don't 12,3 ¡x! Σίσυφοσ"), (201, "ÀÉß.,,a.B")]
    folder = f"file://{tmp_path}/tokens"
    files = tokenfiles.write_tokens(table(spark, rows), folder, VOCABULARY, length=64)
    got = {r["doc_id"]: r for r in tokenfiles.read_documents(spark, files).collect()}
    tokenizer, at, every = Tokenizer.from_file(VOCABULARY), 0, []
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
        every += ids
    row = files.orderBy("part").first()
    reader = tokenfiles.Reader(row["path"])
    ids, mask = reader.sequence(3)
    assert len(ids) == 64 and mask.all() and ids.tolist() == every[192:256] and not ids.flags.owndata
    n = row["n_tokens"]
    ids, mask = reader.sequence((n - 1) // 64)
    assert mask.sum() == (n - 1) % 64 + 1 and not ids[mask.sum() :].any()
    assert reader.file.schema.field("input_ids").type == pa.list_(pa.uint16(), 64)
    whole = tokenfiles.write_tokens(table(spark, rows), f"{folder}-whole", VOCABULARY, length=64, by_piece=False)
    assert counted(tokenfiles.read_documents(spark, whole).collect()) == counted(got.values())
    assert tokenfiles.read_documents(spark, tokenfiles.write_tokens(table(spark, []), f"{folder}-none", VOCABULARY)).count() == 0


def test_stretches_keep_every_piece():
    rng = random.Random(1)
    for n in (0, 1, 5, 50, 3000):
        raw = bytes(rng.choice(b"ab  \n\t\x0b\x0c\r\xc3") for _ in range(n))
        for most in (1, 2, 7, 100):
            parts = list(tokenfiles.stretches(raw, most))
            assert b"".join(parts) == raw and [p for s in parts for p in s.split()] == raw.split()


def test_archives_and_audit(spark, tmp_path):
    pages = [(k, f"http://h{k % 3}/{k}", f"<p>page {k}</p>\r\n\r\n" * (k % 5)) for k in range(300)] + [(7, "http://h1/7", None), (None, None, None), (3, "http://h0/3", "<p>page 3</p>\r\n\r\n" * 3)]
    table_ = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    layout = warc.lay_out(table_, records_per_archive=64)
    rows = layout.collect()
    for archive in {r["archive"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["archive"] == archive), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"] * r["copies"]
    assert sum(r["copies"] for r in rows) == len(pages)
    warc.write_archives(layout, warc.contents(table_), f"{tmp_path}/warc")
    for archive in {r["archive"] for r in rows}:
        data = b"".join(open(f"{tmp_path}/warc/archive={archive}/{f}", "rb").read() for f in sorted(os.listdir(f"{tmp_path}/warc/archive={archive}")) if f.startswith("part"))
        for r in (r for r in rows if r["archive"] == archive):
            part = data[r["offset"] : r["offset"] + r["length"]]
            assert part.startswith(b"WARC/1.0\r\n") and part.endswith(b"\r\n\r\n")

    left = [(a, o, 10, f"{a}-{o}") for a in range(5) for o in range(0, 400, 10)]
    right = [r for r in left if r != (1, 50, 10, "1-50") and r[0] != 4]
    right[3] = (*right[3][:3], "damaged")
    right += [(2, 401, 10, "more"), (9, 0, 10, "new"), (None, None, None, None)]
    right = [(*r[:2], 9, r[3]) if r[:2] == (3, 120) else r for r in right]
    schema = "archive long, offset long, length long, content_hash string"
    want = {(0, 30): "changed", (1, 50): "missing", (2, 401): "extra", (9, 0): "extra", (-1, -1): "extra", (3, 120): "changed"} | {(4, o): "missing" for o in range(0, 400, 10)}
    for leaf_range, height in ((16, 3), (64, 2), (1 << 16, 4)):
        got = warc.audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), leaf_range, height)
        assert {(r["archive"], r["offset"]): r["status"] for r in got.collect()} == want
    same = spark.createDataFrame(left, schema)
    assert warc.audit(same, same).count() == 0 and warc.audit(same.limit(0), same.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    item = passage(rng, 30)
    base = [passage(rng, 60) for _ in range(40)]
    rows = [(k, "\n".join(" ".join(w[a : a + 10]) for a in range(0, 60, 10)), "en", "s", 1) for k, w in enumerate(base)]
    rows += [(50, rows[0][1], "en", "s", 1), (51, rows[1][1] + "\n" + " ".join(passage(rng, 25)), "en", "s", 1), (52, " ".join(passage(rng, 12) + item), "en", "s", 1), (53, None, "en", "s", 1), (54, "", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"] for r in docs.collect()}
        if name == "line_dedup":
            text = {r["doc_id"]: r for r in docs.collect()}
            assert text[51]["text"] == rows[41][1].split("\n")[-1] and text[51]["n_chars"] == len(text[51]["text"]) and text[0]["n_chars"] == 1
    everyone = {r[0] for r in rows}
    assert seen["toxicity"] == everyone
    assert seen["line_dedup"] == everyone - {50}
    assert seen["simhash_near_dedup"] == everyone - {50, 54}
    assert seen["benchmark_decontamination"] == everyone - {50, 54, 52} == seen["best_fit_packing"]
    assert counted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == counted(docs.collect())

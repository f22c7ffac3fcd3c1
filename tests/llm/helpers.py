"""Small tables with awkward rows, and plain versions of the operators to compare with."""

import random
from collections import Counter

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # Names that the operators use inside.
    *(T.StructField(c, T.StringType()) for c in ("id", "tag", "start", "n", "gram", "key", "row", "spans", "w", "h", "own", "lines", "pos", "fp", "y")),
])


def passage(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "Delta", "epsilon,", "zeta.", "éta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n)]


def texts(seed=1):
    """Shared passages, copies, repeated lines, a periodic and a very long text, white space of all kinds, null and empty texts."""
    rng = random.Random(seed)
    shared = [passage(rng, n) for n in (40, 60, 90)]
    out = []
    for k in range(30):
        words = passage(rng, rng.randrange(5, 80))
        if k % 3 == 0:
            words += shared[k % 2] + passage(rng, 7)
        if k % 5 == 0:
            words = shared[2] + words
        lines = [" ".join(words[a : a + 9]) for a in range(0, len(words), 9)]
        out.append("\n".join(lines))
    out += [out[0], out[3], out[3], "", None, " \t\n\x0b\f\r ", "one", "a b", "x y z " * 60, "l1\nl2\nl3\nl4\nl1\nl2\nl3", "\n\n\n\n\n", "  \tlead and trail \r\n"]
    out.append(" ".join(passage(rng, 30_000)))
    out.append("ĂÎ ß " + out[1])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", *["other"] * 15) for i, t in rows], SCHEMA)


def edge_rows():
    rows = list(enumerate(texts()))
    rows += [rows[3], (None, texts()[6]), (None, None), (5, "another text under an id that is taken " * 3)]
    # Two texts without id whose 32-bit hashes are equal, and a part of the second under an id.
    part = " ".join(f"b{k}" for k in range(40))
    rows += [(None, "only 351293 4a79608c5fca2f36ca5ccc257ee32752"), (None, part + " only 258860 00dacca56b3c036e2aa92de0a8803a40"), (990, part)]
    return rows


def words(text):
    return (text or "").encode().split()


def counted(rows):
    """Rows as a multiset."""
    return Counter(map(tuple, rows))

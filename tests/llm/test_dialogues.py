"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import zlib

import pytest
from helpers import counted
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm import dialogues
from epochwise.llm.queries import op12_conversation_repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    # Names that the operator uses inside.
    *(T.StructField(c, T.StringType()) for c in ("conv", "copies", "part", "seq", "blank", "first", "last", "p", "q", "h", "own", "again", "cost", "codes")),
])
SPACE = " \t\n\x0b\f\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["other"] * 14) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if rule == 1 else "".join(c for c in text if c not in ".!?") if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * {0: 0, 3: 2}.get(rule, 1)
    return out


def plain(rows, conversations):
    out = []
    for conv in conversations:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))

        @functools.lru_cache(None)
        def best(i, done, inserts):
            """Least (cost, audit, messages) of what is left; ``done`` are the last initial and the number of messages up to 1."""
            ways = [(0, "", ())] if i == len(own) and done in ("", "a") else []
            follow = "a" if done == "u" else "u"
            if inserts < 2:
                c, s, m = best(i, follow, inserts + 1)
                ways.append((c + 2, "I" + s, ({"u": "user:", "a": "assistant:"}[follow], *m)))
            if i < len(own):
                c, s, m = best(i + 1, done, 0)
                ways.append((c + 3, "D" + s, m))
                if faults[i] not in ("blank", "duplicate"):
                    extra, role, text = faults[i] == "truncated", own[i][2], own[i][3]
                    if role[:1] == follow or (role[:1] == "s" and done == ""):
                        c, s, m = best(i + 1, role[:1], 0)
                        ways.append((c + extra, "K" + s, (role + ":" + text, *m)))
                    c, s, m = best(i + 1, follow, 0)
                    ways.append((c + 2 + extra, "R" + s, ({"u": "user:", "a": "assistant:"}[follow] + text, *m)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, messages = best(0, "", 0)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(messages).encode()).hexdigest()))
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 13)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "open end", "  ", "", None, "And é.\n ", "x. y", f"own {conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
    rows += [(500, k, ("user", "assistant")[k % 2], f"{k % 30}.") for k in range(300)]  # long, many repeats
    rows += [(501, 1, "user", "same row.")] * 40  # one turn, one text
    rows += [(502, k, "user", "one text.") for k in range(50)]
    rows += [(503, 7, "user", "A very long text " * 2000 + "."), (503, 8, "assistant", "Short.")]
    return rows


@pytest.mark.parametrize(("piece_rows", "piece_chars"), [(512, 2_000_000), (7, 300), (1, 1)])
def test_repair(spark, piece_rows, piece_chars):
    rows = rows_of()
    got = dialogues.repair(table(spark, rows).repartition(5), piece_rows=piece_rows, piece_chars=piece_chars)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = plain(filled, dict.fromkeys(r[0] for r in rows))
    assert counted(got.collect()) == counted(want)


def test_query_on_damaged_rows(spark, tmp_path):
    rows = rows_of(5) + [(9000 + k, 0, "user", "Alone.") for k in range(60)]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_conversation_repair(spark, str(tmp_path)).collect()
    want = plain(damaged(rows), dict.fromkeys(r[0] for r in rows))
    assert counted(got) == counted(want)
    gone = [r for r in got if r["audit"] == "" and r["cost"] == 0]
    assert gone and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in gone)


def test_messages_and_empty_table(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Still here."), (2, 0, "assistant", " ")]
    got = dialogues.repair(table(spark, rows), messages=True).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hello.", "K"), (1, 1, "assistant", "Still here.", "R")]
    assert dialogues.repair(table(spark, [])).count() == 0
    assert dialogues.repair(table(spark, rows), copies=F.lit(0)).filter("cost = 0 AND audit = ''").count() == 2

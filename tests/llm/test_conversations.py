"""Conversation repair against a search over all edit lists, and in chunks against whole."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from jobsmith.llm.conversations import repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile("(s?(ua)+)?")


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def damage(data):
    convs = {}
    for conv, turn, role, text in data:
        rows = convs.setdefault(conv, [])
        sp = lambda x: " " if x is None else x
        hit = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        rows += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, md5(*x[1:]))) for c, r in convs.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, kinds, insert=5):
    """Least (cost, audit, lines), trying everything with at most two inserts in a row."""
    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            extra = 5 if kinds[i] == "truncated" else 0
            c, a, x = best(i + 1, state, 0)
            options.append((c + 2, "D" + a, x))
            if kinds[i] not in ("blank", "duplicate"):
                ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in ok:
                    c, a, x = best(i + 1, role[0], 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = best(i + 1, due, 0)
                options.append((c + 1 + extra, "R" + a, (f"{ {'u': 'user', 'a': 'assistant'}[due]}:{text}", *x)))
        if inserts < 2:
            c, a, x = best(i, due, inserts + 1)
            options.append((c + insert, "I" + a, ({"u": "user:", "a": "assistant:"}[due], *x)))
        return min(options) if options else (10**9, "", ())
    return best(0, "", 0)


def brute(data):
    out = []
    for conv, rows in damage(data).items():
        kinds = faults(rows)
        cost, letters, lines = search(rows, kinds)
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        assert SHAPE.fullmatch("".join(x[0] for x in lines))
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(n=150, seed=6):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "no", "What?", " \t", "", "é!  ", "a.b", "...", None, "line\nend.\n"]
    for conv in [None, *range(n)]:
        turn = rng.randint(-2, 3)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            out.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                        rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", "!", ""])))
            turn += rng.choice([1, 1, 1, 2, 0])
    return out


def got(df):
    return sorted([(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()], key=str)


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in ("conv", "h", "copies", "part", "no", "first", "cost", "blank", "seen", "cut", "n")])


@pytest.mark.parametrize("chunk", [256, 1, 2, 5])
def test_repair_is_brute_force(spark, chunk):
    data = talks() + [(900, t, r, x) for t, (r, x) in enumerate(itertools.product(("user", "assistant", "system"), ("a.", "b", "c!")))]
    data += [(901, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(60)] + [(901, 5, "user", "turn 4.")] * 7
    data += [(902, None, None, None)]
    want = brute(data)
    assert {x for w in want for x in w[7]} == set("DKR")  # two deletions are cheaper than an insert
    assert got(repair_conversations(clashing(spark.createDataFrame(data, SCHEMA)), chunk=chunk)) == want


@pytest.mark.parametrize("insert", [0, 1, 2])
def test_least_with_cheap_inserts(monkeypatch, insert):
    """Inserts come up once they are cheap."""
    import jobsmith.llm.conversations as c

    monkeypatch.setitem(c.COST, "I", insert)
    letters = set()
    for rows in damage(talks(120, seed=9)).values():
        kinds = faults(rows)
        part = c._Part(None)
        for (turn, role, text), kind in zip(rows, kinds):
            part.add(turn, role, text, kind == "blank", kind == "duplicate", kind == "truncated")
        cost, audit, lines = search(rows, kinds, insert)
        letters |= set(audit)
        done = part.solved()
        assert (done["cost"], done["audit"]) == (cost, audit)
        assert done["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert "I" in letters


def test_repair_of_one_hot_conversation(spark):
    """Most rows in one conversation, over several partitions, with equal rows and equal texts."""
    rng = random.Random(1)
    data = [(7, t // 2, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t {t}.", f"t {t}"])) for t in range(600)] + talks(20)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(repair_conversations(spark.createDataFrame(data, SCHEMA), chunk=50)) == brute(data)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_least_letters_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", 1), (1, 1, "user", "b.", 1), (2, 0, "assistant", "x.", 1), (3, 0, "system", "s.", 1), (3, 1, "user", "u", 1)],
                                 "conv long, turn long, role string, text string, copies long")
    out = {r.conv_id: (r.cost, r.audit) for r in repair(rows).collect()}
    assert out == {1: (1, "KR"), 2: (2, "D"), 3: (4, "DD")}


def test_repair_of_nothing(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(repair_conversations(spark.createDataFrame([(dropped, 0, "user", "x")], SCHEMA))) == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_string_ids(spark):
    data = talks(30)
    df = spark.createDataFrame(data, SCHEMA).withColumn("conv_id", F.col("conv_id").cast("string"))
    want = sorted([(None if w[0] is None else str(w[0]), *w[1:]) for w in brute(data)], key=str)
    assert got(repair_conversations(df)) == want

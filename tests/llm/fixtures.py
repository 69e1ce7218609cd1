"""Small tables with the odd cases every corpus operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": "the of and river stone light walk under morning with".split(),
         "bb": "der die und fluss stein licht gehen unter morgen mit".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing" if lang == "aa" else "ung"]) for _ in range(n))


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        text = "\n".join(sentence(rng, lang, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 6)))
        out.append((i, text, lang, rng.choice(["s1", "s2", "s3", None]), len(text)))
    base = out[5][1]
    passage = sentence(rng, "aa", 70)
    odd = [None, "", "  \n\t ", "one", "12 34 !!", base, base.replace(" ", "  "), base + " tail", "é́🙂 x", passage + "\nfirst " + base,
           "other start\n" + passage, passage, "w " * 5000, "\n".join(["same line again"] * 300), base]
    out += [(100 + i, t, "aa" if i % 2 else None, None if i % 3 else "s1", None) for i, t in enumerate(odd)]
    out += [(7, out[7][1], out[7][2], out[7][3], out[7][4])] * 2  # repeated rows
    out += [(None, "a text without an id and with some words in it", "aa", "s2", 3)] * 2
    return out


def table(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(docs):
    """The same table with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "key", "shard", "size", "kept", "score", "digest", "copies", "rate", "piece", "removed", "n_lines", "h", "n", "cid", "lang_pred",
             "_key", "_removed", "runs", "decided", "KEY_", "_copies", "_id", "_hash", "_row", "_copy", "row", "word", "root", "fp", "unit", "least", "th",
             "row_hash", "src", "target", "piece_", "drawn", "place", "block", "windows", "best", "grown"]
    return docs.select("*", *[F.lit("clash").alias(c) for c in names])


def near_copies_table(spark):
    rng, out = random.Random(9), []
    base = [rng.choice(WORDS["aa"]) + str(rng.randrange(400)) for _ in range(120)]
    for i in range(40):
        w = list(base)
        w[rng.randrange(len(w))] = f"stone{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w), "aa", "s1", 1))
    return table(spark, out)

"""Seeded random strings through the Column helpers vs Python's own semantics
(the regex/whitespace bridge every rule depends on). One Spark job per check."""

import html
import random
import re

from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions import text as tx
from jobsmith.operators import profile as pf

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
ALPHABET = WS + "abcXYZ019" + "éßİıK" + "٣" + "&<>\"'@+-._%" + "​﻿"  # incl. non-space lookalikes
WORDS = ["Data", "Engineer", "data  engineer", "Lead Software Engineer", "Dublin,Ireland", "over 7 years",
         "10+ years of experience", "EDUCATION", "MSc in\nPhysics", "Posted 3 days ago", "jk=ab12&x"]


def rand_text(rng, n):
    parts = []
    for _ in range(n):
        parts.append(rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6))))
    return "".join(parts)


def texts(seed=5, n=400):
    rng = random.Random(seed)
    return [rand_text(rng, rng.randint(0, 12)) for _ in range(n)] + ["", " ", WS]


def df_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")


def test_clean_strip_escape_match_python(spark):
    vals = texts()
    rows = df_of(spark, vals).select(
        "i", tx.clean_text(F.col("t")).alias("c"), tx.py_strip(F.col("t")).alias("s"),
        tx.html_escape(F.col("t")).alias("e"), tx.first_line(F.col("t")).alias("f")).orderBy("i").collect()
    for r, v in zip(rows, vals):
        assert r["c"] == " ".join(v.split()), repr(v)
        assert r["s"] == v.strip(), repr(v)
        assert r["e"] == html.escape(v), repr(v)
        assert r["f"] == v.split("\n")[0].strip(), repr(v)


def test_ranked_rules_match_python_re(spark):
    vals = texts(seed=9)
    t = F.col("t")
    rows = df_of(spark, vals).select(
        "i", pf.title_rule(t).alias("title"), pf.location_rule(t).alias("loc"), pf.phone(t).alias("phone"),
        pf.email(t).alias("email"), pf.experience_years(t).alias("years")).orderBy("i").collect()

    def first(patterns, v, group=0):
        for p in patterns:
            m = re.search(p, v, re.IGNORECASE)
            if m:
                return m.group(group)
        return None

    for r, v in zip(rows, vals):
        exp_t = first(fixed.TITLE_PATTERNS, v)
        assert r["title"] == (exp_t.strip() if exp_t else ""), repr(v)
        exp_l = first(fixed.LOCATION_PATTERNS, v)
        assert r["loc"] == (exp_l.strip() if exp_l else ""), repr(v)
        m = re.search(fixed.PHONE_PATTERN, v)
        assert r["phone"] == (m.group() if m else ""), repr(v)
        m = re.search(fixed.EMAIL_PATTERN, v)
        assert r["email"] == (m.group() if m else ""), repr(v)
        y = first(fixed.EXPERIENCE_PATTERNS, v, 1)
        if y is None or y.isascii():  # non-ASCII digits: documented difference (int() accepts them)
            assert r["years"] == (int(y) if y else 0), repr(v)

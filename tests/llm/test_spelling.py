"""Spelling variants against brute force: words, neighbours, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobsmith.llm.spelling import scan, spelling_variants
from tests.llm.fixtures import clashing, rows, table


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(data, min_length=7, min_count=2, factor=10, every=31):
    n = Counter()
    for i, t, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()], key=str)


def variants(seed=5):
    """Words with edits at every place, chains of forms, ties and a family that fills blocks."""
    rng, out = random.Random(seed), []
    letters = "abcdeé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 15))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 300])
        for _ in range(12):
            v, at = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            v[at:at + 1] = [[rng.choice(letters)], [], [v[at], rng.choice(letters)]][kind]
            words += ["".join(v)] * rng.choice([1, 2, 3, 20])
    family = ["constant" + a + b for a in "abcdefgh" for b in "abcdefgh"] + ["xon" + a + "stancy" for a in "abcdefgh"]
    words += [w for w in family for _ in range(2 + len(w) % 3)]
    words += ["chained"] * 900 + ["chaimed"] * 60 + ["chaimea"] * 4 + ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 2 + ["aaaaaaaaa"] * 2
    words += ["long" + "x" * 300] * 2 + ["long" + "x" * 299] * 2
    rng.shuffle(words)
    while words:
        k = rng.randint(1, 80)
        out.append((len(out), rng.choice([" ", "\n", "1", "Ā"]).join(words[:k]).replace("con", "CON"), "aa", "s", 1))
        words = words[k:]
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 2, "pack_rows": 50}, {"block_words": 7}])
def test_spelling_variants_are_brute_force(spark, options):
    data = variants() + rows()
    want = brute(data)
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] for x in want if x[1])
    assert got(spelling_variants(clashing(table(spark, data)), **options)) == want


def test_spelling_variants_short_words(spark):
    rng = random.Random(2)
    data = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)), "aa", "s", 1) for i in range(30)]
    assert got(spelling_variants(table(spark, data), min_length=2, factor=2, block_words=3)) == brute(data, 2, 2, 2)


def test_spelling_variants_of_nothing(spark):
    assert spelling_variants(table(spark, [])).count() == 0
    assert spelling_variants(table(spark, [(1, None, None, None, None), (None, "", None, None, None), (2, "short words", None, None, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(table(spark, []), min_length=1)


def test_long_texts_are_streamed(spark, monkeypatch):
    import jobsmith.llm.spelling as s

    monkeypatch.setattr(s, "LONG_TEXT", 10)
    import pyarrow as pa

    data = [r for r in variants(8) if r[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in data]), pa.array([r[1] for r in data])], names=["id", "text"])
    lines = [x for b in s._tally(31, 7)(iter([batch])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    total = Counter()
    for w, k in lines:
        total[w] += k
    assert {w: k for w, k in total.items() if k >= 2} == {x[0]: x[3] for x in brute(data)}


def test_scan_skips_what_shares_a_hopeless_prefix():
    words = sorted(["abcd", "abce", "abxd", "bcd", "zzzz", "abcde", "xabcd", "abd"])
    words = [w for w in words if len(w) in (4, 5)]
    cells = np.zeros((len(words), 5), np.int32)
    for i, w in enumerate(words):
        cells[i, :len(w)] = list(map(ord, w))
    q, w = scan(cells, np.array([len(x) for x in words]), np.array([0]), 4)
    assert {(words[a], words[b]) for a, b in zip(q, w)} == {(a, b) for a in words for b in words if len(a) == 4 and one_edit(a, b)}

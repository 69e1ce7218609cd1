"""SimHash near-duplicates against brute force over all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from jobsmith.llm.simhash import LAYOUTS, cheapest, fingerprint, patterns, simhash_components, spanning, syndromes
from tests.llm.fixtures import clashing, rows, table


def brute_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode("utf-8"), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(data, most=4):
    fps = [brute_fingerprint(t) for _, t, *_ in data]
    comp = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    ids = [i for i, *_ in data]
    names = {c: min((x for x, y in zip(ids, comp) if y == c and x is not None), default=None) for c in set(comp)}
    return sorted([(i, f"{f:016x}", names[c]) for i, f, c in zip(ids, fps, comp)], key=str)


def near(n=120):
    """Groups of near copies of a long text, and random texts."""
    rng, out = random.Random(4), []
    bases = [[f"v{rng.randrange(900)}" for _ in range(260)] for _ in range(3)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w), "aa", "s", 1))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk": 5, "pack_rows": 50}, {"layouts": LAYOUTS[1:], "chunk": 7, "broadcast_rows": 0},
                                     {"layouts": [((32, 1, 5), (32, 2, 4))]}, {"most": 12, "layouts": [((16, 3, 3), (16, 2, 0), (16, 2, 4), (16, 2, 0))], "chunk": 9}])
def test_simhash_is_brute_force(spark, options):
    data = rows() + near()
    want = brute(data, options.get("most", 4))
    assert len({x[2] for x in want}) < len({x[1] for x in want})  # texts that differ are linked
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(clashing(table(spark, data)), **options).collect()], key=str)
    assert got == want


def test_simhash_links_random_fingerprints_at_exactly_the_threshold():
    """Every planted pair of 4 differing bits meets at an anchor, of 64-bit values without structure."""
    rng = np.random.default_rng(1)
    for layout in LAYOUTS:
        for _ in range(300):
            x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
            y = x
            for p in rng.choice(64, 4, replace=False).tolist():
                y ^= 1 << p
            shift, met = 0, False
            for bits, t, r in layout:
                by, home = patterns(bits, t, r)
                a, b = [np.array([(v >> shift) & (2**bits - 1)], np.uint64) for v in (x, y)]
                shift += bits
                sa, sb = int(syndromes(a, r)[0]), int(syndromes(b, r)[0])
                assert home[sa] in by[sa]
                met = met or bool(np.isin(a ^ home[sa], b ^ by[sb])[0])
            assert met


def test_code_covers_and_costs():
    by, home = patterns(9, 1, 3)
    values = np.arange(512, dtype=np.uint64)
    s = syndromes(values, 3)
    homes = values ^ home[s]
    assert (syndromes(homes, 3) == 0).all() and (np.bitwise_count(values ^ homes) <= 1).all() and len(np.unique(homes)) == 64
    for v, k in zip(values[:40], s[:40]):
        anchors = {int(x) for x in v ^ by[k]}
        assert anchors == {int(x) for x in values[syndromes(values, 3) == 0] if bin(int(x) ^ int(v)).count("1") <= 2}
    assert cheapest(10**5, 4) == LAYOUTS[0] and cheapest(10**11, 4) == LAYOUTS[1]
    with pytest.raises(ValueError):
        cheapest(10, 5)


def test_spanning_and_pieces():
    a, b = spanning(np.array([5, 7, 9, 20], np.uint64), np.array([7, 9, 11, 30], np.uint64))
    assert dict(zip(a.tolist(), b.tolist())) == {7: 5, 9: 5, 11: 5, 30: 20}
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 500):
        text = " ".join(rng.choice(["Ab", "c d", "É", "xyz"]) for _ in range(n)) + " \n"
        assert {fingerprint(text, piece=k) for k in (1, 7, 64, 10**6)} == {brute_fingerprint(text)}


def test_simhash_of_nothing(spark):
    assert simhash_components(table(spark, [])).count() == 0
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(table(spark, [(4, None, None, None, None), (5, " ", None, None, None), (None, "", None, None, None)])).collect()}
    assert got == {4: ("0" * 16, 4), 5: ("0" * 16, 4), None: ("0" * 16, 4)}

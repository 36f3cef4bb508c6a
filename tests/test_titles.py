"""Pairs of alike titles against brute force."""

import random
from collections import Counter

import numpy as np
from sitepair.operators import pairing, titles


def _dice(x, y):
    x, y = (Counter(map("".join, zip(t, t[1:], strict=False))) for t in (x.lower(), y.lower()))
    n = x.total() + y.total()
    return (x & y).total(), n


def _title(rng):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice(["", "a", "ab", "AB", "aaaa", "a" * 200, "新聞", "新聞稿", "😀😀é", None])
    return "".join(rng.choice("abcde ") for _ in range(rng.choice([3, 10, 30, 31, 90, 300])))


def test_alike_titles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(titles, "BLOCK", 1 << 14)  # many blocks
    rng = random.Random(5)
    base = [_title(rng) for _ in range(60)]
    rows = [(f"k{i:03d}", rng.choice(["s", "s", "t", None]), rng.choice(["en", "fr", "de", None]), rng.choice(base) if rng.random() < 0.6 else _title(rng)) for i in range(260)]
    want = set()
    for a, sa, la, ta in rows:
        for b, sb, lb, tb in rows:
            if a < b and sa == sb and None not in (sa, la, lb, ta, tb) and la != lb:
                o, n = _dice(ta, tb)
                if n and 4 * o >= n and o:
                    want.add((a, b, (400 * o + n) // (2 * n)))
    pool = spark.createDataFrame(rows, "key string, section string, locale string, title string")
    got = [tuple(r) for r in pairing.by_title(pool).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    few = [tuple(r) for r in titles.alike_of_few(pool).collect()]
    assert len(few) == len(set(few)) and set(few) == want


def test_signatures_lose_nothing_and_leave_little(spark):
    """Of titles that share many bigrams, but not half, few pairs go to the exact comparison."""
    rng = random.Random(6)
    syllables = {"x": "the and ing er ou re tion st en".split(), "y": "the le eau oui re tion aux st er".split()}
    sides = {k: sorted({"".join(rng.choice(s) for _ in range(rng.randint(3, 20))) for _ in range(500)}, key=len) for k, s in syllables.items()}
    blocks = {k: (np.array([len(t) - 1 for t in s]), titles.signatures([[t] for t in s], 1024)) for k, s in sides.items()}
    i, j = titles.close_pairs(blocks["x"], blocks["y"])
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    true = {(p, q) for p, x in enumerate(sides["x"]) for q, y in enumerate(sides["y"]) if 4 * _dice(x, y)[0] >= _dice(x, y)[1]}
    assert true and true <= found and len(found) < 3 * len(true)


def test_candidates_read_the_pool_once(spark, tmp_path):
    rows = [(f"k{i}", "s", "en" if i % 2 else "fr", f"d-{i // 2}", f"title {i // 2}", [f"m{i // 4}"]) for i in range(8)]
    spark.createDataFrame(rows, "key string, section string, locale string, slug string, title string, media array<string>").write.parquet(f"{tmp_path}/pool")
    names = ["hreflang", "slug_normalized", "shared_media", "date", "title_similarity"]
    declared = spark.createDataFrame([("k0", "k1", "fr")], "a string, b string, token string")
    out = pairing.candidates(spark.read.parquet(f"{tmp_path}/pool"), names, declared)
    assert not [f for f in out.inputFiles() if str(tmp_path / "pool") in f]
    assert {r.evidence for r in out.where("a = 'k0' and b = 'k1'").collect()} == {"hreflang=fr;slug_normalized=d0;shared_media=1;title_similarity=1.00"}

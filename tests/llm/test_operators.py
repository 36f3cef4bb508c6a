"""Training-data operators against brute force, on small fixtures and odd inputs."""

import glob
import hashlib
import math
import os
import random
import re
import zlib

import __spark_entry__ as entry
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from sitepair.llm import bpe, language_id, licenses, mixing, near_dedup, quality_classifier, quality_rules, queries, substring_dedup, topk, url_filter
from sitepair.llm.common import Scratch
from sitepair.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts], DOCS)


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(n))


ODD = [(None, None), (None, "x y"), (1, None), (2, ""), (2, ""), (3, " \n\t "), (4, "w" * 50_000), (5, "a\x00b é 漢 😀"), (6, "one two"), (6, "one two")]


def corpus():
    rng = random.Random(1)
    out = [(i, prose(rng, 60)) for i in range(10, 30)]
    for i in range(30, 45):
        words = out[i % 7][1].split()
        words[rng.randrange(60)] = "changed"
        out.append((i, " ".join(words)))
    out += [(50, out[0][1]), (51, out[3][1] + " " + out[5][1]), *ODD]
    return out


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(200 + i, 201 + i) for i in range(30)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {(x, root(x)) for e in edges for x in e if e[0] != e[1]}
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    assert {tuple(r) for r in found.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def brute_phases(rows, units, size, hashes):
    """The rows of each block and its slot: Pfair by definition, a new phase as soon as a source has run out.

    In each phase every source stays within a block of its weight."""
    queues = {}
    for k in units:
        own = sorted((r for r in rows if (r[1] if r[1] in units else mixing.REST) == k), key=lambda r: (hashes[r[0]], r[0] or 0))
        queues[k] = [tuple(own[a : a + size]) for a in range(0, len(own), size)]
    out, slot = {}, 0
    while live := {k: q for k, q in units.items() if queues[k]}:
        total, done, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(queues[k] for k in live):
            released = [(math.ceil((done[k] + 1) * total / q), k) for k, q in live.items() if math.floor(done[k] * total / q) <= t]
            k = min(released)[1]
            out[queues[k].pop(0)] = slot
            done[k], t, slot = done[k] + 1, t + 1, slot + 1
            assert all(abs(done[x] - t * q / total) < 1 for x, q in live.items())
    return out


def test_mixing(spark):
    units = {"a": 5, "b": 3, "c": 1, mixing.REST: 1}
    slots = mixing.period(units)
    for t in range(1, 11):
        for k, q in units.items():
            assert abs(sum(s < t for s in slots[k]) - q * t / 10) < 1
    rows = [(i, "abcde"[i % 5] if i < 90 else "a") for i in range(200)] + [(None, None), (7, "b"), (7, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, units, block_docs=2).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    order = sorted(got, key=lambda r: r.position)
    blocks = sorted({(r.slot, r.source if r.source in units else mixing.REST) for r in order})
    for t in range(1, 15):
        for k, q in units.items():
            assert abs(sum(s < t and x == k for s, x in blocks) - q * t / 10) < 1
    hashes = {r[0]: r[1] for r in df.selectExpr("doc_id", "xxhash64(doc_id, 7)").collect()}
    for t, s in brute_phases(rows, units, 2, hashes).items():
        assert sorted(map(repr, t)) == sorted(repr((r.doc_id, r.source)) for r in order if r.slot == s)
    full = docs(spark, corpus()).withColumnRenamed("n_chars", "slot")
    assert mixing.in_order(full).columns == full.columns and mixing.in_order(full).count() == full.count()
    assert mixing.mix(df.limit(0), units).count() == 0


def test_url_filter(spark):
    canon = '<html><link rel="canonical" href="https://x.net/es/1">'
    rows = [(1, "http://y.org/1", canon), (2, "http://y.org/2", '<meta http-equiv="refresh" content="0; url=http://y.org/1#f">'), (3, "https://www.example.com/en/1", canon), (4, None, None), (5, "no scheme", ""), (6, "http://EXAMPLE.com/en/x?q", None), (7, "http://z.org", None), (7, "http://z.org", None), (8, "http://notexample.com/en/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.via) for r in url_filter.judge(df).collect()}
    assert got[1][2:] == (None, "block", "redirect_class") and got[2][2:] == (None, "block", "redirect_class")
    assert got[3][2:] == ("www.example.com/en/", "allow", "rule") and got[4] == ("", "", None, "allow", "default") == got[5]
    assert got[6] == ("example.com", "/en/x", "example.com/en/", "block", "rule") and got[7][3] == "allow" and got[8][2] == "com/"
    extra = spark.createDataFrame([("http://z.org", "http://x.net/fr/")], "source_url string, target_url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, extra).collect()}[7] == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


PLANTED = [
    (1, "http://b.net/es/1", None),
    (2, "http://a.org/x/1.html", '<link rel="canonical" href="../x/./2.html">'),
    (3, "http://a.org/x/2.html", "<meta content='5; url=//b.net/es/1' http-equiv=refresh>"),
    (4, "http://c.org/a?u=1&v=2", ""),
    (5, "http://d.org/q", '<LINK HREF="http://c.org/a?u=1&amp;v=2" REL=canonical>'),
    (6, "http://c.org/moved", '<link rel=canonical href=/a?u=1&v=2><meta http-equiv="refresh" content="0;URL=http://b.net/es/1">'),
    (7, "http://e.org/", '<!-- <link rel="canonical" href="http://b.net/es/1"> --><script>"<link rel=canonical href=http://b.net/es/1>"</script>'),
    (8, "http://e.org/2", '<!-- open <link rel="canonical" href="http://b.net/es/1">'),
    (9, "http://f.org/page", "<link rel=canonical href='?u=http://b.net/es/1'>"),
    (10, "http://f.org/page?u=http://b.net/es/1", '<link rel="canonical" href="mailto:x@b.net"><link rel=canonical><link rel=canonical href="#top">'),
    (11, "http://www.example.com/en/", '<link rel="canonical" href="http://b.net/es/1">'),
    (12, "http://g.org", '<link rel="alternate canonical-not" href="http://b.net/es/1"><link data-rel="canonical" href="http://b.net/es/1">'),
    (13, "http://h.org/a/b/../c/.", '<link rel="canonical" href="http://b.net/es/1">'),
    (14, "http://h.org/a/c/", None),
    (15, "http://i.org/" + "long/" * 3000, '<link rel="canonical" href="http://b.net/fr/' + "x" * 9000 + '">'),
    (None, None, '<link rel="canonical" href="http://b.net/es/1">'),
    (16, "://", "<link"),
    (5, "http://d.org/q", None),
]


def test_url_filter_follows_links(spark):
    import duckdb

    df = spark.createDataFrame([(*r, "x", "y") for r in PLANTED], "page_id long, url string, html string, host string, label string")
    got = url_filter.judge(df)
    by = {r.page_id: (r.verdict, r.via) for r in got.collect()}
    assert {i for i, (v, via) in by.items() if (v, via) == ("block", "redirect_class")} == {2, 3, 4, 5, 6, 13, 14, 15}
    assert by[1] == ("block", "rule") and by[11] == ("allow", "rule") and {by[i] for i in (7, 8, 9, 10, 12, 16, None)} == {("allow", "default")}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PLANTED)
    want = con.execute(queries.oracle_sql()["op2_redirect_url_filter"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_quality_classifier_recomputed(spark):
    rng = random.Random(15)
    texts = [(i, prose(rng, rng.randint(0, 50))) for i in range(60)] + [(60, None), (61, ""), (62, "one"), (None, "x y")]
    df = docs(spark, texts).withColumnRenamed("source", "key")
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 5 % 2) for i in range(40)] + [(3, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(40) if i % 3 % 2 == 1 and i % 5 % 2 == 0} | {3}
    own = {i: quality_classifier.features((t or "").encode()).tolist() for i, t in texts}
    raw, target = [0] * quality_classifier.BUCKETS, [0] * quality_classifier.BUCKETS
    for i, fs in own.items():
        for f in fs:
            raw[f] += 1
            target[f] += i in good
    n = quality_classifier.BUCKETS
    ratio = [math.log((t + 1) / (sum(target) + n)) - math.log((r + 1) / (sum(raw) + n)) for t, r in zip(target, raw, strict=True)]
    noise = {r[0]: r[1] for r in df.selectExpr("doc_id", "xxhash64(doc_id, 5)").collect()}
    got = {r.doc_id: r for r in quality_classifier.resample(df, labels, share=0.5).collect()}
    keys = {}
    for i, fs in own.items():
        weight = sum(ratio[f] for f in fs) if fs else None
        assert got[i].n_features == len(fs) and (got[i].log_weight is None if weight is None else abs(got[i].log_weight - weight) < 1e-6)
        if weight is not None:
            keys[i] = weight - math.log(-math.log(((noise[i] % 2**64 >> 11) + 0.5) / 2**53))
            assert abs(keys[i] - got[i].gumbel_key) < 1e-6
    drawn = sorted(keys, key=lambda i: -keys[i])[: -(-len(keys) // 2)]
    assert {i for i, r in got.items() if r.selected} == set(drawn)
    unlabelled = quality_classifier.resample(df, labels.limit(0)).collect()
    assert {r.log_weight for r in unlabelled} == {0.0, None}


def test_quality_classifier(spark):
    rng = random.Random(5)
    texts = [(i, prose(rng, 40) if i % 4 else "zz!! " * 40) for i in range(80)]
    df = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    got = quality_classifier.resample(df, labels, share=0.7).collect()
    weights = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 10}
    assert min(r.log_weight for i, r in weights.items() if i % 4) > max(r.log_weight for i, r in weights.items() if i % 4 == 0)
    drawn = sorted((r.gumbel_key for r in got if r.selected), reverse=True)
    rest = [r.gumbel_key for r in got if not r.selected and r.gumbel_key is not None]
    n = sum(r.gumbel_key is not None for r in got)
    assert len(got) == 90 and -(-n * 7 // 10) <= len(drawn) <= -(-n * 7 // 10) + 2 and drawn[-1] > max(rest)
    assert quality_classifier.resample(df.limit(0), labels).count() == 0
    keys = spark.createDataFrame([(k,) for k in [5, -3, 9, 9, 2**40, -(2**40)]], "key long")
    assert [quality_classifier.kth_greatest(keys, k) for k in range(1, 8)] == [2**40, 9, 9, 5, -3, -(2**40), None]


def brute_classes(texts):
    """Least id of the class of each (id, text)."""
    sets, low = {}, {}
    for i, t in texts:
        if i is not None and t is not None:
            low[t] = min(i, low.get(t, i))
            w = t.encode().split()
            k = min(5, len(w))
            own = sets.setdefault(t, {})
            if not own:
                for j in range(len(w) - k + 1 if w else 0):
                    g = tuple(w[j : j + k])
                    own[g] = own.get(g, 0) + 1
    up = {t: t for t in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    every = list(sets)
    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            x, y = sets[a], sets[b]
            both = x.keys() & y.keys()
            if sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in both) >= 0.8:
                up[root(b)] = root(a)
    least = {}
    for t in every:
        least[root(t)] = min(low[t], least.get(root(t), low[t]))
    return {(i, t): least[root(t)] for i, t in texts if i is not None and t is not None}


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several blocks for a small group
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 8)
    texts = corpus()
    rng = random.Random(9)
    base = prose(rng, 80).split()
    for i in range(100, 160):  # a group whose members are not all alike
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"v{i}"
        texts.append((i, " ".join(words)))
    df = docs(spark, texts).withColumnsRenamed({"lang": "class_id", "source": "_row"})
    rows = near_dedup.classes(df)
    got = {r.doc_id: r.class_id for r in rows.collect() if r.doc_id is not None}
    want = {i: c for (i, _), c in brute_classes(texts).items()}
    assert len(set(want.values())) < len(want) and {i: c for i, c in got.items() if i in want} == want and got[1] == 1
    assert all((r.class_id is None) == (r.doc_id is None) for r in rows.collect())
    kept = near_dedup.deduplicate(df)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == sorted({*want.values(), 1}) and ids.count(None) == 2
    assert near_dedup.classes(df.limit(0)).count() == 0 and near_dedup.deduplicate(df.limit(0)).count() == 0


def test_near_dedup_of_one_id_with_several_texts(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    texts = [(1, a), (2, b), (2, a + " more"), (3, b + " tail"), (4, c), (4, prose(rng, 60)), (4, c), (5, c + " end")]
    got = near_dedup.classes(docs(spark, texts)).collect()
    want = brute_classes(texts)
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((i, want[i, t]) for i, t in texts)
    assert len({r.class_key for r in got}) == 4 and sorted(r.class_size for r in got) == [1, 2, 2, 2, 2, 2, 2, 2]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.deduplicate(docs(spark, texts)).collect())
    assert kept == sorted([(1, a), (2, b), (4, c), (4, texts[5][1])])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 2**60, 500, dtype=np.uint64))
    x, y = (a[:400], rng.integers(1, 4, 400)), (a[100:], rng.integers(1, 4, len(a) - 100))
    agree = np.mean(near_dedup.probminhash(*x, 4096) == near_dedup.probminhash(*y, 4096))
    assert abs(agree - near_dedup.similarity(x, y)) < 0.03


def test_links_agree_but_for_the_stated_chance():
    p, n = near_dedup.SIMILARITY, near_dedup.REGISTERS
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.AGREE)) < 1e-6


def brute_substrings(texts):
    owner = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                owner[k] = min(owner.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - 12 if i is not None else 0):
            if owner[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(spark, batches):
    df = docs(spark, corpus())
    got = substring_dedup.digests(df, batches=batches, units=11, buckets=3, chunk_windows=200)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_substrings(corpus())
    cleaned = substring_dedup.clean(df, batches=batches, units=5)
    assert cleaned.columns == df.columns and cleaned.count() == df.count()
    assert substring_dedup.digests(df.limit(0)).count() == 0


def test_substring_dedup_clashes(spark):
    df = docs(spark, corpus()).withColumnsRenamed({"lang": "doc", "source": "_text"}).selectExpr("*", "1 AS repeats", "2 AS _row")
    cleaned = substring_dedup.clean(df)
    assert cleaned.columns == df.columns
    want = sorted(((i, t) for i, t in brute_clean([(i, t or "") for i, t in corpus()])), key=repr)
    assert sorted(((r.doc_id, r.text or "") for r in cleaned.collect()), key=repr) == want


def test_index_outlives_the_call(spark):
    texts = [(i, t) for i, t in corpus() if i is not None and t is not None]
    early, late = [x for x in texts if x[0] < 25], [x for x in texts if x[0] >= 25]
    index = substring_dedup.FingerprintIndex(spark, units=7, buckets=2, name="kept_index")
    try:
        got = substring_dedup.digests(docs(spark, early), batches=2, index=index).collect()
        spark.sql(f"DROP TABLE {index.runs[0][1]}")  # as in a new session, whose catalog doesn't know the table
        again = substring_dedup.FingerprintIndex.open(spark, "kept_index")
        assert again.runs == index.runs and (again.units, again.buckets) == (7, 2)
        got += substring_dedup.digests(docs(spark, late), batches=1, index=again).collect()
        assert sorted(map(tuple, got), key=repr) == brute_substrings(texts)
    finally:
        substring_dedup.FingerprintIndex.open(spark, "kept_index").drop()
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex.open(spark, "kept_index")


def test_failed_batches_leave_no_tables(spark):
    bad = docs(spark, corpus()).selectExpr("doc_id", "if(doc_id = 50, raise_error('x'), text) AS text")
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception, match="x"):
        substring_dedup.digests(bad, batches=2)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_check_refutes_equal_fingerprints():
    run = (np.array([3, 3, 8], np.uint64), np.array([1, 2, 5], np.uint32))
    assert substring_dedup._held(run, np.array([3, 3, 8, 9], np.uint64), np.array([2, 7, 5, 5], np.uint32)).tolist() == [True, False, True, False]


def test_bpe(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "b", "é", "漢", "😀", " ", "  ", "\n", "\t", "1", "#", "aaaaaa", "the", "　", "\x1c", "\x85", "'s", "ß", "²"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    rows = bpe.encode_digests(docs(spark, ODD), RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, (e := own.encode_ordinary(t or "")), t or "") for i, t in ODD]
    assert sorted(map(tuple, rows), key=repr) == sorted(((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, e, t in want), key=repr)


def brute_nearest(rows, asked, k):
    longest = max([len(v) for _, v in rows if v] or [0])
    bits = [(i, [x is not None and x > 0 for x in v + [0] * (longest - len(v))]) for i, v in rows if v is not None]
    out = []
    for q, b in bits:
        if q in asked:
            near = sorted((sum(x != y for x, y in zip(b, c, strict=True)), i) for i, c in bits)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)] + [(i, [1.0] * 64) for i in range(60, 90)]
    rows += [(90, None), (91, []), (92, [float("nan")] * 64), (92, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [0, 30, 60, 91]
    for hot in (topk.HOT, 1):  # a salt for each code of a common segment value
        got = topk.search(df, df.where(df.vec_id.isin(asked)).withColumnRenamed("vec_id", "query_id"), k=5, hot=hot)
        assert sorted(map(tuple, got.collect())) == brute_nearest(rows, asked, 5)
    assert topk.search(df.limit(0), df.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_topk_of_long_vectors(spark):
    rng = random.Random(16)
    same = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, same + [rng.uniform(-1, 1) for _ in range(rng.choice([64, 64, 3]))]) for i in range(6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, code string, n long")
    got = topk.search(df, df.withColumn("query_id", df.vec_id), k=3)
    want = brute_nearest(rows, range(6), 3)
    assert sorted(map(tuple, got.collect())) == want and max(w[3] for w in want) > 0
    probed = topk.probes(spark.createDataFrame([([5, 0],)], "query array<int>"), 2, 4).collect()
    assert {(r.segment, r.value) for r in probed} == {(s, x) for s, own in enumerate((5, 0)) for x in range(16) if (x ^ own).bit_count() == 2} and len(probed) == 12


def test_topk_shuffles_less_than_its_budget(spark):
    rng = np.random.default_rng(17)
    vectors = rng.standard_normal((6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = -store.executorList(True).apply(0).totalShuffleWrite()
    got = topk.search(df, df.where(df.vec_id % 10 == 0).withColumnRenamed("vec_id", "query_id")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written += store.executorList(True).apply(0).totalShuffleWrite()
    assert 0 < written < 4 * vectors.nbytes
    signs = vectors > 0
    want = [(q, n + 1, int(i), int(d)) for q in range(0, 6000, 10) for n, (d, i) in enumerate(sorted(zip((signs != signs[q]).sum(axis=1), range(6000), strict=True))[:10])]
    assert sorted(map(tuple, got)) == want


def test_topk_shard(monkeypatch):
    rng = np.random.default_rng(18)
    taken = []
    for n, bits, apart, at_once, enough in ((20_000, 64, 1, 1 << 15, 0.01), (3000, 64, 64, 1000, 0.1), (2000, 130, 2, 1 << 15, 1), (3000, 64, 24, 1 << 15, 8), (300, 7, 7, 64, 1)):
        monkeypatch.setattr(topk, "AT_ONCE", at_once)
        monkeypatch.setattr(topk, "HELD", at_once)
        monkeypatch.setattr(topk, "ENOUGH", enough)
        centres = rng.integers(0, 2, (n // 10, bits))
        signs = np.zeros((n, -(-bits // 64) * 64), np.uint8)  # each differs from its centre in some of the first bits
        signs[:, :bits] = centres[rng.integers(0, len(centres), n)]
        signs[np.arange(n), rng.integers(0, apart, n)] ^= 1
        if apart == 24:
            signs[:, :apart] = 1  # segments of one value
        codes = rng.permutation(np.unique(np.packbits(signs, axis=1, bitorder="little").view(np.uint64), axis=0))
        n_ids = rng.integers(1, 4, len(codes))
        queries = codes[rng.integers(0, len(codes), 40)]
        queries[::2, 0] ^= np.uint64(1)
        shard = topk.Shard(codes, n_ids, bits)
        q, at, far = (x.tolist() for x in shard.nearest(queries, 5))
        taken.append(len(shard.segments))
        for i, x in enumerate(queries):
            d = np.bitwise_count(codes ^ x).sum(axis=1).astype(int)
            by = np.lexsort((np.arange(len(d)), d))[:5]
            last = int(np.flatnonzero(np.cumsum(n_ids[by]) >= 5)[:1][0]) if n_ids[by].sum() >= 5 else len(by) - 1
            want = [(int(c), int(d[c])) for c in by if d[c] <= d[by[last]]]
            assert [(c, e) for a, c, e in zip(q, at, far, strict=True) if a == i] == want
    assert min(taken) >= 1 and max(taken) > 8
    for width, radius in ((1, 0), (1, 1), (1, 2), (9, 3), (9, 9)):
        assert topk.masks(width, radius).tolist() == [x for x in range(1 << width) if x.bit_count() == radius]
        assert topk.n_masks(width, radius) == len(topk.masks(width, radius))


def test_topk_masks_are_probes(spark):
    probed = topk.probes(spark.createDataFrame([([0],)], "query array<int>"), 2, 6).collect()
    assert {r.value for r in probed} == set(topk.masks(6, 2).tolist())


def brute_rules(text):
    w = text.encode().split()
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [*corpus(), (200, "the cat\nthe cat\n#*|\n" + "a b c d e f g h i " * 3), (201, " ".join(["the end of it"] * 30))]
    df = docs(spark, texts)
    got = quality_rules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_rules(t or "")) for i, t in texts), key=repr)
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(df.where("doc_id is not null")).collect()) == sorted((i, brute_kept(t or "")) for i, t in texts if i is not None)
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.keep(df.limit(0)).columns == df.columns
    kept = quality_rules.keep(df.withColumnRenamed("n_chars", "n_words"))
    assert kept.columns[-1] == "n_words" and not kept.where("doc_id in (1, 2, 201)").count()


def plain_digest(text):
    out = re.sub(licenses.COPYRIGHT_LINE.replace("\\z", "\\Z"), " ", text.lower())
    for a, b in licenses.SPELLINGS:
        out = out.replace(a, b)
    return hashlib.sha256(re.sub(licenses.PUNCTUATION, " ", re.sub("v([0-9])", r"version \1", out)).strip(" ").encode()).hexdigest()


def test_license_digests_recomputed(spark):
    bodies = [("Copyright 2001 A\nAll rights reserved.\n\n" + t.replace(", ", ",\n  ").title(), n) for n, t in licenses.KNOWN]
    for path in glob.glob("/usr/share/common-licenses/*"):
        name = os.path.basename(path)
        if any(n.removesuffix(".0") == name.removesuffix(".0") for n, _ in licenses.DIGESTS):
            bodies.append((open(path, encoding="utf-8").read(), name if name.count(".") else name + ".0"))
    rows = [(i, b) for i, (b, _) in enumerate(bodies)] + [(900, "no licence"), (901, ""), (902, None), (902, None), (903, "x " * 50_000)]
    df = docs(spark, rows).withColumnsRenamed({"lang": "license", "source": "digest"})
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert all(got[i].digest == (None if t is None else plain_digest(t)) for i, t in rows)
    assert all(got[i].license == n for i, (_, n) in enumerate(bodies)) and not any(got[i].license for i in range(900, 904))


def test_licenses(spark):
    body = "Copyright (c) 2020 Someone\n" + licenses.TEXTS[0][2].upper().replace(", ", " ,\n")
    rows = [(11, body), (12, "Words.\nReleased under the MIT Licence!\nmore\nlicensed under cc by-nc 4.0"), (13, "no"), *ODD]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[11][0] == "MIT" and got[12] == (None, "CC-BY-NC-4.0,MIT") and got[13] == (None, "") == got[2]
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def brute_phrases(sample, text):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in s for s in sample):
            end += 1
        n, at = n + 1, end
    return n


def folded(text):
    return "".join(map(chr, language_id.fold(text)))


def test_phrases_of_several_scripts():
    rng = random.Random(13)
    for letters in ("ab ", "abcdé ", "漢字語文日本 ", "абвгд κλμ "):
        texts = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3)] for k in "xy"}
        model = language_id.Model(texts, 10**6)
        for _ in range(20):
            text = "".join(rng.choice(letters + "zш語") for _ in range(rng.randint(1, 250)))
            if len(f := language_id.fold(text)):
                got = model.phrases(np.append(model.number(f), -1)[None, :].astype(np.int32))
                assert [int(n[0]) for n in got] == [brute_phrases([folded(t) for t in texts[k]], folded(text)) for k in "xy"]


def test_many_languages_and_ties():
    model = language_id.Model({"x": ["abcabd"], "y": ["zzz"]}, 1000)
    assert model.predict(["abcabd", "zzzz", "", None, "12 34", "ZZ", "qq"])[0] == ["x", "y", "und", "und", "und", "y", "x"]
    rng = random.Random(14)
    own = {f"l{k:03d}": "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(300)) for k in range(200)}  # 8,000 letters
    model = language_id.Model({k: [t] for k, t in own.items()})
    assert len(model.points) > 7000 and model.predict([t[100:160] for t in own.values()])[0] == sorted(own)
    assert language_id.Model({}).predict(["a"]) == (["und"], [0.0])


def test_language_held_out(spark):
    got = language_id.learn_and_identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98
    odd = language_id.learn_and_identify(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r.lang_pred == "und" for r in odd if r.doc_id in (1, 2, 3))
    clash = docs(spark, ODD).withColumnsRenamed({"source": "lang_pred", "n_chars": "held_out"})
    assert len(language_id.learn_and_identify(clash).columns) == 4 and language_id.learn_and_identify(clash.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, t + " the of and") for i, t in corpus() if t is not None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = step.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == names
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == step.count() > 10


def test_pipeline_positions(spark, tmp_path):
    import corpus_pipeline

    # Files of very different sizes: Spark reads the large ones first.
    rows = [(i, "the of and " * (1 if i % 7 else 400), "en", f"src{i % 3}", 1) for i in range(400)] + [(None, "a", "en", None, 1), (7, "b", "en", "src1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixture(spark, df, "").write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 2
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    want = [r.doc_id for r in mixing.mix(df).orderBy("position").collect()]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty))
    assert corpus_pipeline.tokens(spark, spark.read.parquet(str(empty)), "").count() == 0


def brute_kept(text):
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    n, chars, symbols, dup, covered = brute_rules(text)
    if n < 20 or 100 * covered > 30 * n:
        return False
    stop = sum(x.decode().lower() in quality_rules.STOP_WORDS for x in w)
    return 2 <= chars / n <= 20 and symbols / n <= 0.1 and dup / len(lines) <= 0.5 and stop / n >= 0.01


def brute_clean(texts):
    owner, out = {}, []
    for i, t in texts:
        w = t.encode().split()
        for j in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[j : j + 13])
            owner[k] = min(owner.get(k, i), i)
    for i, t in texts:
        w = t.encode().split()
        gone = {j + d for j in range(len(w) - 12 if i is not None else 0) if owner[tuple(w[j : j + 13])] < i for d in range(13)}
        out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t))
    return out


def brute_mixed(rows, hashes):
    """Rows as (id, text) by EDF: blocks of 16 of each source in hashed order, a new phase where a source ends."""
    blocks = {}
    for source in sorted({f"src{(i or 0) % 3}" for i, _ in rows}):
        own = sorted((r for r in rows if f"src{(r[0] or 0) % 3}" == source), key=lambda r: hashes[r[0]])
        blocks[source] = [own[a : a + mixing.BLOCK_DOCS] for a in range(0, len(own), mixing.BLOCK_DOCS)]
    out = []
    while live := {k: q for k, q in mixing.TARGETS.items() if blocks.get(k)}:
        turn = {t: k for k, slots in mixing.period(live).items() for t in slots}
        t = 0
        while True:
            k = turn[t % len(turn)]
            out += blocks[k].pop(0)
            t += 1
            if not blocks[k]:
                break
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [(i, (t or "") + " the of and") for i, t in corpus() if i is not None and i >= 10]
    texts += [(i, prose(rng, 50) + "\n the of and") for i in range(300, 400)] + [(None, prose(rng, 40) + " the of and")]
    texts += [(200, "the end of it " * 30), (201, prose(rng, 40)), (202, "the cat"), (203, texts[40][1] + " " + texts[60][1])]
    docs(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [x for x in texts if brute_kept(x[1])]
    classes = brute_classes(kept)
    single = [x for x in kept if x[0] is None or classes[x] == x[0]]
    cleaned = brute_clean(single)
    assert len(texts) > len(kept) > len(single) and cleaned != single
    ids = spark.createDataFrame([(i,) for i, _ in cleaned], "doc_id long")
    hashes = {r[0]: r[1] for r in ids.selectExpr("doc_id", "xxhash64(doc_id, 7)").collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for at, (i, t) in enumerate(brute_mixed(cleaned, hashes)):
        e = own.encode_ordinary(t)
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), at))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position").collect()
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == want


def test_pipeline_takes_anything(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    texts = [*corpus(), *((i, prose(rng, 40) + " the of and") for i in range(500, 520)), (500, prose(rng, 40) + " the of and")]
    df = docs(spark, texts).selectExpr("*", "'x' AS position", "1 AS _row", "doc_id AS doc")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = [x for x in texts if brute_kept(x[1] or "")]
    classes = brute_classes(kept)
    single = {x: None for x in kept if x[0] is None or classes[x] == x[0]}
    digests = sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in brute_clean(list(single)))
    assert sorted(r.decoded_sha256 for r in got.collect()) == digests and len(single) > 20
    assert sorted(r.position for r in got.collect()) == list(range(len(single)))
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.001"):
        con.execute(f"create view {f[:-8]} as select * from '/root/testdata/sf0.001/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(map(repr, want.fetchall()))


def test_registered():
    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())

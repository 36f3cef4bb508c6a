"""Titles that are alike: texts of one section and different locales with a Dice coefficient of 0.5 or more over bigrams.

A text's tokens are its bigrams, each with its number among equal ones, so that what two texts share is what their sets share.
Texts of n and m tokens are alike if their sets differ in (n + m) / 2 tokens at most. A token falls on a bit by its hash and a
signature holds each bit's parity: signatures differ in no more bits than the sets in tokens, so that no pair is lost. Equal
titles are one text; texts are dealt into blocks by section, locale and length, and blocks are compared in pairs, first by folded
signatures. The comparisons are quadratic in a section's texts: bigrams are too few and 0.5 too low for an index to part them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stage

#: Bytes of a block; of a text besides its bigrams, and for each of them.
BLOCK, TEXT, GRAM = 4 << 20, 256, 4
PACKED = "section string, locale string, block long, lo long, hi long, ids binary, sizes binary, bits binary, titles array<array<string>>"
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def titled(pool: DataFrame) -> DataFrame:
    """``key, section, locale, titles, n``: lower-case titles of a page and the number of their bigrams."""
    rows = pool.where("key is not null and section is not null and locale is not null and title is not null")
    rows = rows.groupBy("key", "section", "locale").agg(F.array_sort(F.collect_list(F.lower("title"))).alias("titles"))
    return rows.withColumn("n", F.expr("aggregate(titles, 0L, (s, t) -> s + greatest(length(t) - 1, 0))")).where("n > 0")


def _counts(titles: list[str]) -> Counter:
    out = Counter()
    for t in titles:
        out.update(map("".join, zip(t, t[1:], strict=False)))
    return out


def scored(pairs: DataFrame) -> DataFrame:
    """``a, b, value`` of those ``pairs(a, b, ta, tb)`` that are alike: hundredths, rounded half up."""
    kind = pairs.schema["a"].dataType.simpleString()

    def exact(batches):
        known: dict[tuple, Counter] = {}
        for batch in batches:
            a, b, out = batch.column("a"), batch.column("b"), []
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            for i, both in enumerate(zip(map(tuple, ta), map(tuple, tb), strict=True)):
                for t in both:
                    if t not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[t] = None
                x, y = (_counts(t) if known.get(t) is None else known[t] for t in both)
                known[both[0]], known[both[1]] = x, y
                n = x.total() + y.total()
                o = (x & y).total()
                if 4 * o >= n > 0:
                    out.append((i, (400 * o + n) // (2 * n)))
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array([v for _, v in out], pa.int64())], ["a", "b", "value"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(exact, f"a {kind}, b {kind}, value long")


def tokens(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """``row, token`` of every text, sorted: a bigram's code points and its number among equal ones, in 64 bits."""
    flat = [t for titles in texts for t in titles]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    row = np.repeat(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), lengths)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(lengths)[lengths > 0] - 1] = False  # a title's last letter begins no bigram
    inside = np.flatnonzero(inside)
    gram, row = (codes[inside] << np.uint64(21)) | codes[inside + 1], row[inside]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    number = np.arange(len(gram)) - np.repeat(start, np.diff(np.append(start, len(gram))))
    return row, (gram << np.uint64(22)) | number.astype(np.uint64)


def signatures(texts: list[list[str]], width: int) -> np.ndarray:
    """Words of ``width`` bits, a power of two, for each text."""
    row, h = tokens(texts)
    h = h * ODD[0]
    for shift, odd in ((30, ODD[1]), (27, ODD[2])):
        h = (h ^ (h >> np.uint64(shift))) * odd
    bit = (h >> np.uint64(20)) & np.uint64(width - 1)
    words = np.zeros(len(texts) * (width // 64), np.uint64)
    np.bitwise_xor.at(words, row * (width // 64) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words.reshape(len(texts), width // 64)


def _power(x: int) -> int:
    return 1 << max(0, int(x) - 1).bit_length()


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row, its texts in order of length; a text has 24 bits a bigram, or fewer in a block of mixed lengths."""
    table = table.sort_by([("n", "ascending"), ("id", "ascending")])
    n, ids = table.column("n").to_numpy(), table.column("id").to_numpy()
    width = max(64, min(_power(24 * n[-1]), _power(16 * BLOCK // len(n)) // 2))
    titles = table.column("titles").to_pylist()
    cells = [table.column("section")[0].as_py(), table.column("locale")[0].as_py(), int(ids.min()), int(n[0]), int(n[-1]), ids.astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), signatures(titles, width).tobytes(), titles]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.string()))]
    return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["section", "locale", "block", "lo", "hi", "ids", "sizes", "bits", "titles"])


def _folds(words: np.ndarray) -> dict[int, np.ndarray]:
    """Signatures of each smaller width: both halves' parities together."""
    out = {words.shape[1]: words}
    while (half := words.shape[1] // 2) >= 1:
        words = words[:, :half] ^ words[:, half:]
        out[half] = words
    return out


def close_pairs(a: tuple, b: tuple):
    """Places ``i, j`` of texts of two blocks whose signatures leave open that they are alike; a block is ``sizes, words``."""
    swap = len(a[0]) > len(b[0])
    (na, wa), (nb, wb) = (b, a) if swap else (a, b)
    fa, fb = _folds(wa), _folds(wb)
    full = min(wa.shape[1], wb.shape[1])
    across = {}
    found = []
    nb = nb.astype(np.int32)
    first, last = np.searchsorted(nb, -(-na // 3)), np.searchsorted(nb, 3 * na, "right")
    for i, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if lo >= hi:
            continue
        n = np.int32(na[i])
        few = min(full, max(1, _power(8 * int(n)) // 64))
        if few not in across:
            across = {few: np.ascontiguousarray(fb[few].T)}  # lengths ascend, and widths with them: one is held
        most = (nb[lo:hi] + n) >> 1
        differ = np.bitwise_count(across[few][:, lo:hi] ^ fa[few][i][:, None])
        if few > 1:
            differ = differ[0::2] + differ[1::2]  # 128 at most
        differ = differ.astype(np.uint16 if few < 1024 else np.uint32)
        hits = np.flatnonzero(np.add.reduce(differ, axis=0, dtype=differ.dtype) <= most)
        if few < full and len(hits):
            hits = hits[np.bitwise_count(fb[full][lo + hits] ^ fa[full][i]).sum(axis=1, dtype=np.int64) <= most[hits]]
        if len(hits):
            found.append(np.stack([np.full(len(hits), i), lo + hits]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return (j, i) if swap else (i, j)


def shared(i: np.ndarray, j: np.ndarray, a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """How many tokens the texts ``a[i]`` and ``b[j]`` share; ``i`` is sorted."""
    sides = []
    for at, texts in ((i, a), (j, b)):
        used, at = np.unique(at, return_inverse=True)
        row, token = tokens([texts[u] for u in used.tolist()])
        sides.append((at, np.searchsorted(row, np.arange(len(used) + 1)), token))
    (ai, sa, ta), (bj, sb, tb) = sides
    out = np.zeros(len(i), np.int64)
    cuts = np.flatnonzero(np.diff(ai, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = ta[sa[ai[lo]] : sa[ai[lo] + 1]]
        for low in range(lo, hi, 4096):
            begin, size = sb[bj[low : min(hi, low + 4096)]], np.diff(sb)[bj[low : min(hi, low + 4096)]]
            first = np.cumsum(size) - size
            others = tb[np.arange(size.sum()) + np.repeat(begin - first, size)]
            held = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            out[low : low + len(size)] = np.add.reduceat(held, first, dtype=np.int64)
    return out


def _compare(table: pa.Table) -> pa.Table:
    table = table.sort_by("side")
    ids, blocks, texts = [], [], []
    for r in range(2):
        ids.append(np.frombuffer(table.column("ids")[r].as_py(), np.int64))
        n = np.frombuffer(table.column("sizes")[r].as_py(), np.int64)
        blocks.append((n, np.frombuffer(table.column("bits")[r].as_py(), np.uint64).reshape(len(n), -1)))
        texts.append(table.column("titles")[r].as_py())
    i, j = close_pairs(*blocks)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    o, n = shared(i, j, *texts), blocks[0][0][i] + blocks[1][0][j]
    good = 4 * o >= n
    return pa.table({"a": ids[0][i[good]], "b": ids[1][j[good]], "value": (400 * o[good] + n[good]) // (2 * n[good])})


def alike(pool: DataFrame) -> DataFrame:
    """``a, b, value``: keys a < b of one section and different locales whose titles are alike."""
    spark = pool.sparkSession
    stage, parts = Stage(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = stage.write(titled(pool))
    texts = stage.write(pages.groupBy("section", "locale", "titles").agg(F.min("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    cell = ["section", "locale"]
    weight = F.col("n") * GRAM + TEXT
    sizes = texts.groupBy(*cell, "n").agg(F.count("*").alias("c"))
    before = F.sum(F.col("c") * weight).over(Window.partitionBy(*cell).orderBy("n")) - F.col("c") * weight
    place = F.col("start") + F.pmod(F.xxhash64("id"), F.col("c")) * weight
    placed = texts.join(sizes.withColumn("start", before), [*cell, "n"]).withColumn("block", F.floor(place / BLOCK))
    packed = placed.select(*cell, "block", "n", "id", "titles").repartition(parts, *cell, "block").groupBy(*cell, "block").applyInArrow(_pack, PACKED)
    packed = stage.write(packed)
    a, b = (packed.select("section", *[F.col(c).alias(f"{c}_{k}") for c in ("locale", "block", "lo", "hi")]) for k in "ab")
    plan = a.join(b, "section").where("locale_a < locale_b and lo_a <= 3 * hi_b and lo_b <= 3 * hi_a")
    plan = stage.write(plan.select(F.monotonically_increasing_id().alias("pair"), "block_a", "block_b"))
    sides = plan.select("pair", F.posexplode(F.array("block_a", "block_b")).alias("side", "block"))
    sides = sides.join(packed.select("block", "ids", "sizes", "bits", "titles"), "block").repartition(min(max(plan.count(), 1), 2000), "pair")
    found = stage.write(sides.groupBy("pair").applyInArrow(_compare, "a long, b long, value long"))
    named = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = texts.join(named, "id").select(*cell, "titles", "id")
    members = stage.write(pages.join(held, [*cell, "titles"]).select("id", "key"))
    ka, kb = (members.select(F.col("id").alias(k), F.col("key").alias(f"k{k}")) for k in "ab")
    return found.join(ka, "a").join(kb, "b").where("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "value")


def alike_of_few(pool: DataFrame) -> DataFrame:
    """The same for sections of few pages each: every pair of a section is compared."""
    a, b = (titled(pool).select("section", F.col("key").alias(k), F.col("locale").alias(f"l{k}"), F.col("titles").alias(f"t{k}")) for k in "ab")
    return scored(a.join(b, "section").where("a < b and la <> lb"))

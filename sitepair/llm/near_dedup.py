"""Operator 4, near-duplicate detection by ProbMinHash.

Texts are weighted sets of five-word shingles, weighted by their counts. For each shingle a Poisson
process of rate equal to its weight deals arrivals to registers; each register keeps the shingle that
arrives first, and a process stops once it is later than every register. Two signatures agree in a
register with a probability that is the texts' probability Jaccard similarity. Bands of registers give
buckets of candidates, and every link is verified by the exact similarity of the texts, 0.8 or more.

A node is a text, whatever ids its rows have. A bucket first ties each member to its least one. Buckets
whose members are then still in several classes are compared in full, in blocks: all pairs of different
classes whose signatures agree in ``AGREE`` registers are verified too (a true link fails that with a
chance of 3.6e-7, beside 3.2e-6 of meeting in no band), so that the size of a bucket loses no other link
between different texts. Classes are the connected components of the links.

A class has the least doc_id of its rows as ``class_id``, and its least text digest as ``class_key``,
which tells classes apart even where one id has several texts. Null texts are alone, with their own id and
no key. Texts without words, among them the empty text, match equal texts only; texts of fewer than five
words have one shingle of all their words. Rows with a null id have a null class and tie nothing. Repeated
rows are classed alike. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, groups
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
#: A link has 56 or more of 96 registers in common, but for a chance of 3.6e-7.
AGREE = 56
#: Signatures of a block of a bucket, and texts of a block of a group of candidates.
BLOCK, TEXT_BLOCK = 2048, 512
#: Words of 64 bits of the filter that finds the rows whose texts are compared: this many short rows are broadcast at most.
FILTER_WORDS = 1 << 19
_U = np.uint64


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    starts, ends = tx.spans(data)
    h = tx.word_hashes(data, starts, ends, 17)
    if not len(h):
        return h, np.empty(0, np.int64)
    return np.unique(tx.grams(h, min(SHINGLE, len(h))), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    if (x == 1).all() and (y == 1).all() and a[1].max() == 1 and b[1].max() == 1:
        return len(ia) / (len(a[0]) + len(b[0]) - len(ia))
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    # Shingles of a alone have an infinite ratio, those of b alone a ratio of 0.
    tail = np.append(np.cumsum(x[::-1])[::-1], 0) + (a[1].sum() - x.sum())
    head = np.append(0, np.cumsum(y)) + (b[1].sum() - y.sum())
    at = np.searchsorted(ratio, ratio, "left")
    return float((1 / (tail[at] / x + head[at] / y)).sum())


def probminhash(items: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The item that arrives first in each register."""
    first = np.full(registers, np.inf)
    out = np.zeros(registers, np.uint64)
    for start in range(0, len(items), 1024):  # the first items bring the registers down, so that later ones end early
        e, w = items[start : start + 1024], counts[start : start + 1024].astype(float)
        t, step = np.zeros(len(e)), 0
        while e.size:
            u = tx.mix(e + _U((2 * step + 1) * int(tx._G) % 2**64))
            t = t - np.log(((u >> _U(11)).astype(float) + 0.5) * 2.0**-53) / w
            live = t < first.max()
            if not live.all():
                e, w, t = e[live], w[live], t[live]
            k = (tx.mix(e ^ _U(0xA5A5A5A5A5A5A5A5) ^ _U(step)) % _U(registers)).astype(np.int64)
            better = np.flatnonzero(t < first[k])
            better = better[np.argsort(-t[better], kind="stable")]  # the last assignment stands: the earliest arrival
            first[k[better]], out[k[better]] = t[better], e[better]
            step += 1
    return out


def signature(data: bytes) -> bytes | None:
    """16 bits of each register's hash; None for a text without words."""
    items, counts = shingles(data)
    if not len(items):
        return None
    return (tx.mix(probminhash(items, counts)) >> _U(48)).astype(np.uint16).tobytes()


def bands(sig: bytes) -> list[int]:
    """A key for each band; its lowest five bits are the band."""
    rows = np.frombuffer(sig, np.uint16).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = (key << _U(16)) | rows[:, j]
    band = np.arange(BANDS, dtype=np.uint64)
    return ((tx.mix(key + band * tx._G) & ~_U(31)) | band).view(np.int64).tolist()


def key_of(text):
    """16 bytes of the text's SHA-256, null for a null text: equal texts are one node."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _sketch(batches):
    """The signature of each ``doc_id, tk, text``; equal texts of a batch are worked once."""
    for batch in batches:
        known: dict[bytes, bytes | None] = {}
        rows = []
        for key, value in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if key is not None and key not in known:
                known[key] = signature(value.as_py())
            rows.append(known.get(key))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "tk", "sig"])


def _band_keys(batches):
    """A row ``rep, key`` for each band of ``rep, sig``."""
    for batch in batches:
        keys = [k for sig in batch.column(1).to_pylist() for k in bands(sig)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys, pa.int64())], names=["rep", "key"])


def _verify(batches):
    """Pairs with both texts: those that are links."""
    held: tuple = (None, None)
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
            if held[0] != y:
                held = (y, shingles(t.as_py()))
            if similarity(shingles(s.as_py()), held[1]) >= SIMILARITY:
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _candidates(batches):
    """Of members of a bucket, sorted by (key, bi, bj): pairs of different classes that may be links.

    Row: a text and its partners (kind 0), or a text and one that it hangs together with (kind 1).
    A pair comes from the first band that it shares, and not if one of it is the bucket's least member.
    """
    for table in groups(batches, 3):
        key, bi, bj = (table.column(i)[0].as_py() for i in range(3))
        rep, label, block = (table.column(i).to_numpy() for i in (3, 4, 5))
        low = table.column(6)[0].as_py()
        sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        order = np.argsort(rep)
        rep, label, block, sig = rep[order], label[order], block[order], sig[order]
        hang = _Union()
        out: list[tuple[int, int, list[int]]] = []
        for i in range(len(rep) - 1):
            if rep[i] == low:
                continue
            same = sig[i + 1 :] == sig[i]
            ok = (same.sum(1) >= AGREE) & (label[i + 1 :] != label[i]) & (rep[i + 1 :] != low)
            ok &= (block[i + 1 :] != block[i]) if bi != bj else True
            at = np.flatnonzero(ok)
            if at.size:
                shared = same[at].reshape(len(at), BANDS, ROWS).all(2)
                partners = rep[i + 1 :][at[shared.argmax(1) == (key & 31)]].tolist()
                if partners:
                    out.append((0, int(rep[i]), partners))
                    out += [(1, p, [int(rep[i])]) for p in partners if hang.join(p, int(rep[i]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["kind", "a", "partners"])


def _verify_blocks(batches):
    """Of a pair of blocks, sorted by (sg, bi, bj): texts and partner lists; the links that join classes."""
    for table in groups(batches, 3):
        rows = table.to_pylist()
        here = {r["rep"]: [r["label"], r["text"], None] for r in rows if r["partners"] is None}

        def own_shingles(entry):
            if entry[2] is None:
                entry[1:] = None, shingles(entry[1].encode())
            return entry[2]

        classes, links = _Union(), []
        for r in rows:
            if r["partners"] is None:
                continue
            mine = here[r["rep"]]
            for p in r["partners"]:
                other = here[p]
                if classes.root(mine[0]) != classes.root(other[0]) and similarity(own_shingles(mine), own_shingles(other)) >= SIMILARITY:
                    classes.join(mine[0], other[0])
                    links.append((r["rep"], p))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])


def _blocks(rep: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (tx.mix(np.asarray(rep, np.int64).astype(np.uint64) ^ _U(23)) % np.asarray(n, np.uint64)).astype(np.int64)


def _deal(batches):
    """Of ``rep, sg, blocks, partners``: each list, split by the pair of blocks that text and partner are in, and for
    each pair of blocks the texts that it names, without partners."""
    for batch in batches:
        out: list[tuple[int, int, int, int, list[int] | None]] = []
        named = set()
        for rep, sg, n, partners in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            mine, theirs = int(_blocks([rep], n)[0]), _blocks(partners, n)
            partners = np.array(partners, np.int64)
            for block in np.unique(theirs).tolist():
                tile = (sg, min(mine, block), max(mine, block))
                own = partners[theirs == block].tolist()
                out.append((*tile, rep, own))
                named.update((*tile, x) for x in (rep, *own))
        out += [(*x, None) for x in named]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sg", "bi", "bj", "rep", "partners"])


def _split_buckets(members: DataFrame, nodes: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Members of the buckets that hold several classes, dealt to pairs of blocks; None if there is no such bucket."""
    labelled = members.where("n > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = scratch.write(labelled.select("key", "rep", F.coalesce("label", "rep").alias("label"), "low", "n"), "labelled")
    split = scratch.write(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key"), "split")
    if split.isEmpty():
        return None
    rows = labelled.join(split, "key").join(nodes.select("rep", "sig"), "rep")
    rows = rows.withColumn("_nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(23)), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rows = rows.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).select("key", "bi", "bj", "rep", "label", "blk", "low", "sig")
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``."""
    s, t = (texts.select(F.col("rep").alias(k), F.col("text").alias(c)) for k, c in (("a", "s"), ("b", "t")))
    return pairs.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(_verify, "u long, v long")


def _compare_all(rows: DataFrame, labels: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The links among all pairs of different classes that ``rows`` of split buckets hold."""
    found = scratch.write(rows.mapInArrow(_candidates, "kind int, a long, partners array<long>"), "candidates")
    hang = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("partners")[0].alias("v")), scratch)
    sizes = scratch.write(hang.groupBy("label").agg(F.ceil(F.count("*") / TEXT_BLOCK).alias("blocks")), "sizes")
    placed = scratch.write(hang.join(sizes, "label").select(F.col("node").alias("rep"), F.col("label").alias("sg"), "blocks"), "placed")
    # A list goes to the pairs of blocks that its partners are in, and a text to those that name it: no task gets a whole group.
    lists = found.where("kind = 0").select(F.col("a").alias("rep"), "partners").join(placed, "rep").select("rep", "sg", "blocks", "partners")
    dealt = scratch.write(lists.mapInArrow(_deal, "sg long, bi long, bj long, rep long, partners array<long>"), "dealt")
    tile = ["sg", "bi", "bj"]
    named = dealt.where("partners is null").select(*tile, "rep").distinct()
    label = F.coalesce("label", "rep").alias("label")
    held = named.join(texts, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*tile, "rep", label, "text", F.lit(None).cast("array<long>").alias("partners"))
    asked = dealt.where("partners is not null").select(*tile, "rep", F.lit(None).cast("long").alias("label"), F.lit(None).cast("string").alias("text"), "partners")
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    return held.unionByName(asked).repartition(n, *tile).sortWithinPartitions(*tile).mapInArrow(_verify_blocks, "u long, v long")


def _may_hold(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, by a Bloom filter of FILTER_WORDS words:
    a filter too small for ``wanted`` lets more rows pass, and never drops one of its keys."""
    hashed = F.xxhash64(key, F.lit(29))
    word, bit = F.pmod(F.shiftright(hashed, 6), F.lit(FILTER_WORDS)), F.expr(f"shiftleft(1L, cast(xxhash64({key}, 29) & 63 as int))")
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_w", word).withColumn("_b", bit)
    fits = (F.col("_w") == F.col("_word")) & (F.col("_b").bitwiseAND(F.col("_bits")) != 0)
    return marked.join(F.broadcast(words), fits, "left_semi").drop("_w", "_b")  # FILTER_WORDS rows at most


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", key_of(F.col("text")).alias("tk"), "text")


def _assign(docs: DataFrame) -> DataFrame:
    """``doc_id, tk, class_id, class_key`` for each row of ``docs``; class columns are null without an id or a text."""
    scratch = Scratch(docs.sparkSession)
    base = _keyed(docs)
    sketched = scratch.write(base.mapInArrow(_sketch, "doc_id long, tk binary, sig binary"), "sketches")
    named = sketched.where("doc_id is not null and tk is not null")
    nodes = named.groupBy("tk").agg(F.min("doc_id").alias("low_id"), F.first("sig").alias("sig"))
    nodes = scratch.write(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")  # numbered once: the table is written
    n = nodes.count()
    keys = scratch.write(nodes.where("sig is not null").select("rep", "sig").mapInArrow(_band_keys, "rep long, key long"), "keys", BANDS * n)
    buckets = scratch.write(keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"), "buckets", BANDS * n)
    n_members = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = scratch.write(keys.join(buckets, "key"), "members", n_members)
    scratch.delete(keys, buckets)
    scratch.free_shuffles()
    wanted = scratch.write(members.select("rep").distinct().join(nodes.select("rep", "tk", F.col("low_id").alias("doc_id")), "rep"), "wanted", min(n, n_members))
    # One row of each text: the one of its least id; the id keeps a text of many copies from being a hot key.
    texts = _may_hold(base, wanted, "tk").join(wanted, ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"]).select("rep", "text")
    texts = scratch.write(texts, "texts")
    scratch.free_shuffles()

    pairs = scratch.write(members.where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    links = scratch.write(_verified(pairs, texts), "links")
    scratch.free_shuffles()
    labels = components(links, scratch)
    rows = _split_buckets(members, nodes, labels, scratch)
    if rows is not None:
        more = scratch.write(_compare_all(rows, labels, texts, scratch), "more-links")
        labels = components(links.unionByName(more), scratch)
    placed = nodes.select("tk", "rep", "low_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = scratch.write(placed.select("tk", "low_id", F.coalesce("label", "rep").alias("label")), "placed-nodes", n)
    named = placed.groupBy("label").agg(F.min("low_id").alias("class_id"), F.min("tk").alias("class_key"))
    final = scratch.write(placed.join(named, "label").select("tk", "class_id", "class_key"), "final", n)
    out = sketched.select("doc_id", "tk").join(final, "tk", "left")
    known = F.col("doc_id").isNotNull()
    out = scratch.write(out.select("doc_id", "tk", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("class_key")).alias("class_key")), "classes")
    scratch.close(out)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, class_key`` for each row of ``docs(doc_id, text)``; the size counts distinct ids."""
    rows = _assign(docs)
    sizes = rows.where("class_key is not null").groupBy("class_key").agg(F.countDistinct("doc_id").alias("class_size"))
    alone = F.when(F.col("doc_id").isNotNull(), F.lit(1).cast("long"))
    out = rows.join(Scratch(docs.sparkSession).write(sizes, "class-sizes"), "class_key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", alone).alias("class_size"), F.lower(F.hex("class_key")).alias("class_key"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, then of the least text digest; of rows equal in
    both, any one. Rows with null ids or texts stay."""
    scratch = Scratch(docs.sparkSession)
    rows = _assign(docs).where("class_key is not null")
    stay = scratch.write(rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "tk")).alias("_k")).select("_k.*"), "survivors")
    each = scratch.write(rows.groupBy("doc_id", "tk").agg(F.count("*").alias("n")), "rows")
    gone = scratch.write(each.join(stay, ["doc_id", "tk"], "left_anti").select("doc_id", "tk"), "gone")
    twice = scratch.write(each.where("n > 1").join(stay, ["doc_id", "tk"], "left_semi").select("doc_id", "tk"), "twice")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text").cast("string")).alias("tk"))
    scratch.close(gone, twice)
    left = packed.join(gone, ["doc_id", "tk"], "left_anti")
    once = left.join(twice, ["doc_id", "tk"], "left_anti").select("_row.*")
    if twice.isEmpty():
        return left.select("_row.*")
    return once.union(left.join(twice, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"]).select("_row.*"))

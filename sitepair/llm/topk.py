"""Operator 7, exact top-k search over binary codes by incremental multi-index hashing.

The signs of a vector's components are its code, as long as the longest vector. The distinct codes are dealt
evenly to shards that fit a task's memory, and each shard gets all queries: the values asked for and the codes
met are never shuffled. In a shard the codes are cut into segments of log2 of their number, less the 7 bits that
give a value some 128 codes, and an index lists, segment by segment, the codes of each value.
A query looks up all values that differ from its own in 0 bits, segment after segment, then in 1 bit, and so on;
after step ``t`` every code within Hamming distance ``t`` has been met. It ends when k ids are that near. A query
that has asked for more than a fraction of the shard takes all of its values at once, so that segments without
use (equal bits, long random vectors) cost a bounded number of comparisons.
Each shard returns its k nearest codes; the k nearest of these are the result.

Equal codes are one index entry with their k least ids, so a very common vector is no hot key. A null
vector has no code and neither asks nor is found; a missing, null or NaN component is a zero bit. Ties are broken
by the smaller id. Repeated ids are one row each. Fewer than k rows give as many as there are. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

K = 10
#: Bits of a segment, whatever the number of codes; else so many that a value has about VALUE codes.
LEAST, MOST = 4, 24
VALUE = 128
#: Codes of a shard, and bytes of its index.
HOT, INDEX_BYTES = 1 << 20, 1 << 27
#: Times that a large shard is copied to take blocks of the queries, and queries of a block at least.
COPIES, BLOCK = 4, 64
#: Queries that are searched together, so that many ask for a value.
TOGETHER = 1 << 16
#: Codes compared at once, so that they stay in a core's cache, and codes held until they are counted.
AT_ONCE, HELD = 1 << 15, 1 << 19
#: A query takes all codes when the values that it has asked for, and their codes, are one in so many.
ENOUGH = 2


def code(vector: str, words: int) -> F.col:
    """Sign bits as array<long> of ``words`` words, bit 0 first; null for a null vector."""
    bit = f"get({vector}, s * 64 + j)"
    one = f"aggregate(sequence(0, 63), 0L, (a, j) -> a | if(coalesce({bit} > 0 and not isnan({bit}), false), shiftleft(1L, j), 0L))"
    return F.expr(f"if({vector} is null, null, transform(sequence(0, {words - 1}), s -> {one}))")


def longest(*tables: DataFrame) -> int:
    """Components of the longest vector, 1 at least."""
    return max([1, *(df.agg(F.max(F.size(F.coalesce("embedding", F.array().cast(df.schema["embedding"].dataType))))).first()[0] or 0 for df in tables)])


def probes(open_: DataFrame, radius: int, width: int) -> DataFrame:
    """``query, segment, value``: every value that differs from the query's own in exactly ``radius`` bits. A shard
    takes the same values from ``masks``; tests hold the two against each other."""
    out = open_.select("query", F.posexplode("query").alias("segment", "value")).withColumn("bit", F.lit(-1))
    for _ in range(radius):  # the bits that differ, in ascending order
        more = F.explode(F.when(F.col("bit") < width - 1, F.sequence(F.col("bit") + 1, F.lit(width - 1)))).alias("next")
        out = out.select("query", "segment", "value", more).select("query", "segment", F.expr("value ^ shiftleft(1, next)").alias("value"), F.col("next").alias("bit"))
    return out.drop("bit")


@lru_cache(maxsize=512)
def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with exactly ``radius`` ones."""
    if radius == 0 or radius > width:
        return np.zeros(int(radius == 0), np.uint32)
    return np.concatenate([masks(top, radius - 1) | np.uint32(1 << top) for top in range(radius - 1, width)])


@lru_cache(maxsize=4096)
def n_masks(width: int, radius: int) -> int:
    return 0 if radius > width else 1 if radius == 0 else n_masks(width, radius - 1) * (width - radius + 1) // radius


class Shard:
    """Codes, an array (n, words) of uint64 in the order of their least ids, with the number of ids of each."""

    def __init__(self, codes: np.ndarray, n_ids: np.ndarray, bits: int):
        self.codes, self.n_ids, self.bits = codes, n_ids, bits
        n = len(codes)
        m = -(-bits // min(bits, MOST, max(LEAST, (n // VALUE).bit_length())))
        cuts = [bits * s // m for s in range(m + 1)]
        self.segments = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.order, self.starts, self.counts, self.near = [], [], [], []
        for s, (_, width) in enumerate(self.segments):
            values = self.segment(codes, s)
            self.order.append(np.argsort(values, kind="stable").astype(np.int32))
            self.counts.append(np.bincount(values, minlength=1 << width).astype(np.int32))
            self.starts.append(np.cumsum(self.counts[-1], dtype=np.int32) - self.counts[-1])
            self.near.append(codes[self.order[-1]] if codes.shape[1] == 1 else None)  # in the order of values: faster, where codes are short

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        at, width = self.segments[s]
        word, shift = divmod(at, 64)
        out = codes[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out |= codes[:, word + 1] << np.uint64(64 - shift)
        return (out & np.uint64((1 << width) - 1)).astype(np.uint32)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, code and distance, by number: for each query the k nearest codes by distance and least id, or
        fewer that hold k ids."""
        size = max(1, min(TOGETHER, (1 << 22) // (self.bits + 1)))
        parts = [self._batch(queries[i : i + size], i, k) for i in range(0, len(queries), size)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _batch(self, queries, first, k):
        n, m, words = len(self.codes), len(self.segments), self.codes.shape[1]
        b, d = len(queries), self.bits + 1
        at_once, enough = max(1, AT_ONCE // words), max(1, int(n // ENOUGH))
        seen = np.zeros((b, d), np.int32)  # ids met, by distance
        limit = np.full(b, self.bits)  # no code beyond can be among the k nearest
        spent = np.zeros(b, np.int64)
        kept, fresh, rows = [], [], {"kept": 0, "fresh": 0}

        def best(parts):
            q, at, apart = (np.concatenate(x) for x in zip(*parts, strict=True))
            inside = apart <= limit[q]
            q, at, apart = q[inside], at[inside], apart[inside]
            by = np.lexsort((at, apart, q))
            q, at, apart = q[by], at[by], apart[by]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return q[rank < k], at[rank < k], apart[rank < k]

        def settle():
            """Counts the fresh codes, and lowers the limits."""
            if not fresh:
                return
            q, at, apart = (np.concatenate(x) for x in zip(*fresh, strict=True))
            fresh.clear()
            rows["fresh"], rows["kept"] = 0, rows["kept"] + len(q)
            lines, line = np.unique(q, return_inverse=True)
            seen[lines] += np.bincount(line * d + apart, weights=np.minimum(self.n_ids[at], k), minlength=len(lines) * d).reshape(-1, d).astype(np.int32)
            full = np.cumsum(seen[lines], axis=1) >= k
            limit[lines] = np.where(full.any(axis=1), full.argmax(axis=1), limit[lines])
            kept.append((q, at, apart))
            if rows["kept"] > 2 * k * b + HELD:
                kept[:] = [best(kept)]
                rows["kept"] = len(kept[0][0])

        def keep(q, at, apart, step, whole):
            """Takes codes that no step before ``step`` has met; nor, unless all codes are taken, another segment's."""
            if step or not whole:
                differ = self.codes[at] ^ queries[q]
                met = np.min([np.bitwise_count(self.segment(differ, s)).astype(np.int32) * m + s for s in range(m)], axis=0)
                new = met >= step if whole else met == step
                q, at, apart = q[new], at[new], apart[new]
            if len(q):
                fresh.append((q, at, apart.astype(np.int64)))
                rows["fresh"] += len(q)
            if rows["fresh"] > HELD:
                settle()

        def distance(x, y):
            return np.bitwise_count(x[..., 0] ^ y[..., 0]) if words == 1 else np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)

        def take_all(asking, step):
            """Codes of all values."""
            for i in range(0, len(asking), 16):
                q, j, length = asking[i : i + 16], 0, 512  # the first codes lower the limits for the rest
                while j < n:
                    apart = distance(queries[q][:, None], self.codes[None, j : j + length])
                    if len(hit := np.flatnonzero(apart <= limit[q].astype(apart.dtype)[:, None])):
                        x, y = np.divmod(hit, apart.shape[1])
                        keep(q[x], y + j, apart.ravel()[hit], step, True)
                        settle()
                    j, length = j + length, min(2 * length, max(512, at_once >> 4))

        def look_up(asking, own, flips, s, step):
            """Codes of the values ``own ^ flips``. Queries are in the order of ``own``; each value is compared at once with all that ask for it."""
            starts, counts = self.starts[s], self.counts[s]
            asked = np.bincount(own, minlength=len(counts)).astype(np.int32)
            begin = np.cumsum(asked, dtype=np.int32) - asked
            words_of, limits = queries[asking], limit[asking].astype(np.uint8 if self.bits < 256 else np.int32)
            wanted = np.unique(own[:, None] ^ flips) if len(own) * len(flips) < len(asked) else np.arange(len(asked), dtype=np.uint32)
            wanted = wanted[counts[wanted] > 0]
            size = max(1, (1 << 15) // len(flips))
            found, n_found = [], 0
            for g in range(0, len(wanted), size):
                values = wanted[g : g + size]
                of = (values[:, None] ^ flips).ravel()
                many = asked[of]
                ends = np.cumsum(many, dtype=np.int64)
                line = np.repeat(begin[of] - ends + many, many) + np.arange(ends[-1])
                words_in, limits_in, a = words_of[line], limits[line], 0
                places = zip(ends[len(flips) - 1 :: len(flips)].tolist(), starts[values].tolist(), counts[values].tolist(), strict=True)
                for b, start, count in places:
                    length = max(1, at_once // max(1, b - a))
                    for j in range(start, start + count if b > a else start, length):
                        end = min(j + length, start + count)
                        near = self.near[s][j:end] if words == 1 else self.codes[self.order[s][j:end]]
                        apart = distance(near[:, None], words_in[None, a:b])
                        if len(hit := np.flatnonzero(apart <= limits_in[a:b])):
                            x, y = np.divmod(hit, b - a)
                            found.append((asking[line[a + y]], self.order[s][j + x], apart.ravel()[hit]))
                            n_found += len(hit)
                    a = b
                if n_found > HELD:
                    keep(*(np.concatenate(x) for x in zip(*found, strict=True)), step, False)
                    found, n_found = [], 0
            if found:
                keep(*(np.concatenate(x) for x in zip(*found, strict=True)), step, False)

        active = np.arange(b)
        for step in range(self.bits + 1):
            radius, s = divmod(step, m)
            width = self.segments[s][1]
            spent[active] += n_masks(width, radius)
            if (asking := active[spent[active] <= enough]).size and radius <= width:
                own = self.segment(queries[asking], s)
                by = np.argsort(own, kind="stable")
                asking, own, flips = asking[by], own[by], masks(width, radius)
                for flip in flips:
                    spent[asking] += self.counts[s][own ^ flip]
                few = spent[asking] <= enough
                look_up(asking[few], own[few], flips, s, step)
                settle()
            take_all(active[spent[active] > enough], step)
            active = active[(limit[active] > step) & (spent[active] <= enough)]
            if not len(active):
                break
        if not kept:
            return (np.zeros(0, np.int64),) * 3
        q, at, apart = best(kept)
        return q + first, at, apart


def flat(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in chunks]).view(np.uint64).reshape(-1, words)


def finder(bits: int, k: int):
    """For ``mapInArrow`` over rows sorted by ``place, asks, least``: the codes of a place, then its queries."""
    words = -(-bits // 64)

    def run(batches):
        place, held, asking, n_asking, shard, ids = None, [], [], 0, None, None

        def found():
            """Of the queries that wait."""
            nonlocal held, asking, n_asking, shard, ids
            if held:
                table, held = pa.Table.from_batches(held), []
                ids = table.column("ids").combine_chunks()
                shard = Shard(flat(table.column("code"), words), ids.value_lengths().to_numpy(), bits)
                del table
            if shard and asking:
                codes = pa.Table.from_batches(asking).column("code").combine_chunks()
                q, at, apart = shard.nearest(flat(codes, words), k)
                for i in range(0, len(q), 10_000):
                    x = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays([codes.take(pa.array(q[x])), ids.take(pa.array(at[x])), pa.array(apart[x])], ["query", "ids", "distance"])
            asking, n_asking = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("place").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, (at, asks) = batch.slice(a, b - a), divmod(int(own[a]), 2)
                if at != place:
                    if asking:
                        yield from found()
                    place, held, shard, ids = at, [], None, None
                if not asks:
                    held.append(part.select(["code", "ids"]))
                    continue
                asking.append(part.select(["code"]))
                n_asking += b - a
                if n_asking >= TOGETHER:
                    yield from found()
        if asking:
            yield from found()

    return run


def search(base: DataFrame, queries: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k rows of ``base(vec_id, embedding)`` nearest to each of
    ``queries(query_id, embedding)``, by Hamming distance and then id; a query that is in ``base`` finds itself.
    ``hot``: codes of a shard at most, about; an index of long codes holds fewer."""
    scratch = Scratch(base.sparkSession)
    bits = longest(base, queries)
    words = -(-bits // 64)
    ids = base.select("vec_id", code("embedding", words).alias("code")).where("code is not null")
    # The limit on the row number is applied before the shuffle too: k rows for each code and task.
    order = W.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last())
    members = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    least = F.expr("transform(array_sort(collect_list(struct(n, vec_id))), x -> x.vec_id)")
    codes = scratch.write(members.groupBy("code").agg(least.alias("ids")), "codes")
    asked = scratch.write(queries.select("query_id", code("embedding", words).alias("query")).where("query is not null"), "asked")
    open_ = scratch.write(asked.select("query").distinct(), "open")
    n, n_open = codes.count(), open_.count()
    size = max(1, min(hot, INDEX_BYTES // (40 * words + 40)))
    shards = max(1, -(-n // size))
    # A table of few shards is copied oftener, as it is small; a block of few queries isn't worth its copy.
    blocks = max(1, min(max(COPIES, min(64, size // max(1, n))), -(-n_open // BLOCK)))
    copies = F.expr(f"explode(transform(sequence(0, {blocks - 1}), b -> cast(pmod(xxhash64(code), {shards}) as int) * {blocks} + b)) as place")
    dealt = codes.select(copies, F.lit(False).alias("asks"), "code", "ids")
    to_all = F.expr(f"explode(transform(sequence(0, {shards - 1}), s -> s * {blocks} + cast(pmod(xxhash64(query), {blocks}) as int))) as place")
    dealt = dealt.unionByName(open_.select(to_all, F.lit(True).alias("asks"), F.col("query").alias("code")), allowMissingColumns=True)
    dealt = dealt.repartitionById(shards * blocks, "place").sortWithinPartitions("place", "asks", F.expr("get(ids, 0)").asc_nulls_last())
    kind = T.StructType([T.StructField("query", open_.schema["query"].dataType), T.StructField("ids", codes.schema["ids"].dataType), T.StructField("distance", T.LongType())])
    found = dealt.mapInArrow(finder(bits, k), kind)
    # A code's ids follow each other in one distance, so k codes in the order of distance and least id hold the k nearest ids.
    pairs = found.select("query", "distance", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", F.col("vec_id").asc_nulls_last()))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    out = asked.join(ranked, "query").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")
    out = scratch.write(out, "nearest")
    scratch.close(out)
    return out

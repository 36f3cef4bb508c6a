"""Operator 1, mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a fixed hashed order and cut into blocks. With weight q of D units,
block i (from 1) is released at slot floor((i-1)D/q) and due by slot ceil(iD/q); at each slot the
released block that is due first goes out. As the weights fill all slots, every block meets its due
slot, and each source's share stays within less than one block of its target at every slot. The
schedule repeats after D slots, so one period is computed and a block's slot follows by arithmetic.
When a source runs out, a new phase starts at zero lag with the weights of the sources that are left,
in the same proportions: no row is dropped or repeated. The bound of one block holds in each phase, against
the weights of the sources that are live in it; over phases a source's lags add up, one block a phase at most.

Sources that the weights don't name, and null sources, share the rest weight as one source. Rows with
equal or null ids are kept and ordered arbitrarily among themselves. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BLOCK_DOCS = 16
MAX_UNITS = 1000
REST = "*"
#: Units of each source of the corpus; the rest weight is that of REST.
TARGETS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, REST: 4}


def period(units: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of ``sum(units)`` slots, by earliest due block among those released."""
    total = sum(units.values())
    done = dict.fromkeys(units, 0)
    slots: dict[str, list[int]] = {k: [] for k in units}
    for t in range(total):
        open_ = [(-(-(done[k] + 1) * total // q), k) for k, q in units.items() if done[k] < q and done[k] * total // q <= t]
        _, k = min(open_)
        slots[k].append(t)
        done[k] += 1
    return slots


def phases(units: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[dict]]:
    """For each source, its phases: first block, first slot, period, slots in a period."""
    if sum(units.values()) > MAX_UNITS or min(units.values(), default=1) < 1:
        raise ValueError(f"weights are whole units of 1 or more, {MAX_UNITS} in all at most")
    done = dict.fromkeys(units, 0)
    out: dict[str, list[dict]] = {k: [] for k in units}
    base = 0
    while True:
        live = {k: q for k, q in units.items() if done[k] < blocks.get(k, 0)}
        if not live:
            return out
        total, slots = sum(live.values()), period(live)
        ends = {}
        for k, q in live.items():
            last = blocks[k] - done[k] - 1
            ends[k] = last // q * total + slots[k][last % q]
            out[k].append({"block": done[k], "slot": base, "period": total, "at": slots[k]})
        length = min(ends.values()) + 1
        for k, q in live.items():
            done[k] += length // total * q + sum(s < length % total for s in slots[k])
        base += length


def mix(docs: DataFrame, units: Mapping[str, int] = TARGETS, block_docs: int = BLOCK_DOCS, carry: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """``doc_id, source, block, slot, position`` and the columns of ``carry`` (as struct ``row``), a row for each of ``docs``.

    ``position`` orders the mixture: the slot's place and the document's place in its block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = F.coalesce(F.when(F.col("source").isin([k for k in units if k != REST]), F.col("source")), F.lit(REST))
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", source.alias("_group"), F.xxhash64("doc_id", F.lit(seed)).alias("_order"), *row)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are told apart by their place, so that they are no single key of the range.
    order = ("_group", "_order", "doc_id", "_tie")
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie")
    # Within a partition the increasing id numbers the sorted rows: no window over a source is needed.
    rows = scratch.write(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ordered")
    parts = rows.groupBy("_group", "_part").agg(F.count("*").alias("n"), F.min("_seq").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.write(parts.select("_group", "_part", (before - F.col("first")).alias("_shift"), "n"), "parts")
    counts = {r[0]: r[1] for r in parts.groupBy("_group").agg(F.sum("n")).collect()}  # a row for each named source
    if REST not in units and REST in counts:
        raise ValueError(f"rows of other sources need a weight {REST!r}")
    plan = phases(units, {k: -(-c // block_docs) for k, c in counts.items()})
    schema = T.StructType([T.StructField("_group", T.StringType()), *[T.StructField(k, T.ArrayType(T.LongType())) for k in ("blocks", "slots", "periods", "counts")], T.StructField("at", T.ArrayType(T.ArrayType(T.LongType())))])
    table = spark.createDataFrame([(k, [p["block"] for p in ps], [p["slot"] for p in ps], [p["period"] for p in ps], [len(p["at"]) for p in ps], [p["at"] for p in ps]) for k, ps in plan.items()], schema)
    # The plan has a row for each named source and MAX_UNITS numbers for each phase at most.
    placed = rows.join(parts.drop("n"), ["_group", "_part"]).join(F.broadcast(table), "_group")
    placed = placed.withColumn("_i", F.col("_seq") + F.col("_shift")).withColumn("block", F.expr(f"_i div {block_docs}"))
    placed = placed.withColumn("_p", F.expr("size(filter(blocks, x -> x <= block)) - 1")).withColumn("_b", F.expr("block - blocks[_p]"))
    slot = F.expr("slots[_p] + (_b div counts[_p]) * periods[_p] + at[_p][cast(_b % counts[_p] as int)]")
    return placed.withColumn("slot", slot).withColumn("position", F.expr(f"slot * {block_docs} + _i % {block_docs}")).select("doc_id", "source", "block", "slot", "position", *(["row"] if carry else []))


def in_order(docs: DataFrame, units: Mapping[str, int] = TARGETS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs``, all rows and columns, in the order of the mixture: sorted files of ascending ranges."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source")
    mixed = mix(packed, units, block_docs, carry=("_row",))
    return mixed.orderBy("position").select("row._row.*")

"""Sharding by balanced label propagation: equal texts gather in a shard while the shards' row counts stay even.

Documents of equal text are linked through their group. Every linked document starts in a shard drawn from its id. In each
round a group's documents want the shard that holds most of the group, or, where that is full, the open shard that holds most
of the rest. A move from shard a to b is granted up to a quota: as many as want to go from b to a, and b's free capacity on
top. Quotas are met by comparing a hash with the granted share, group by group where groups are small and document by document
where they are large. Documents without a link have no edge to cut: they fill up the shards at the end, together with what is
over a shard's size, so that the law ``rows`` holds exactly: each shard has the floor or ceiling of N / shards rows.

Rounds are joins on the group with counts that are aggregated before they are shuffled; only flows between shards (at most
shards^2 numbers) reach the driver. Ranks come from counts of bounded buckets and ranks inside them, so no task sees more than
a bucket; large groups are salted over buckets.

Null texts have size 16, checksum 0 and are one group with empty texts. Null or repeated ids are rows like any other. No
rows: no result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import checkpoint

SHARDS, ROUNDS, OPEN = 40, 5, 0.01
#: Rows a bucket of the final order has about, and the rows from which a group is spread over SALTS buckets.
BUCKET_ROWS, SALTS, LARGE = 4096, 64, 128


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group of equal texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    return rows.withColumn("group", F.xxhash64("hash", "text_crc32", "size")).drop("hash")


def of(values: list[float], index: Column) -> Column:
    """The value of a shard; the list has one number a shard."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)


def wanted(linked: DataFrame, free: list[float], capacity: float) -> DataFrame:
    """(group, top, second): the shard that holds most of a group, and the open one that does; ties by hash."""
    held = linked.groupBy("group", "shard").agg(F.count("*").alias("held"))
    order = F.struct("held", F.xxhash64("group", "shard"))
    is_open = of(free, F.col("shard")) > OPEN * capacity
    return held.groupBy("group").agg(F.max_by("shard", order).alias("top"), F.max_by(F.when(is_open, F.col("shard")), F.when(is_open, order)).alias("second"))


def quotas(flows: dict[tuple[int, int], int], free: list[float]) -> dict[tuple[int, int], float]:
    """The share of each flow that is granted: what comes back the other way, and a part of the free capacity."""
    shares = {}
    for to in range(len(free)):
        net = {a: max(n - flows.get((to, a), 0), 0) for (a, b), n in flows.items() if b == to}
        more = min(1.0, max(free[to], 0.0) / max(sum(net.values()), 1))
        for a, extra in net.items():
            shares[a, to] = (flows[a, to] - extra + more * extra) / flows[a, to]
    return shares


def propagate(linked: DataFrame, capacity: float, shards: int, step: int) -> DataFrame:
    sizes = [0] * shards
    for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect():
        sizes[r.shard] = r.n
    free = [capacity - s for s in sizes]
    aims = checkpoint(wanted(linked, free, capacity))
    open_top = of(free, F.col("top")) > OPEN * capacity
    aim = F.when(F.col("shard") == F.col("top"), F.col("shard")).when(open_top, F.col("top")).otherwise(F.coalesce("second", "shard"))
    moving = linked.join(aims, "group").withColumn("wanted", aim)
    flows = {(r.shard, r.wanted): r["rows"] for r in moving.where("shard <> wanted").groupBy("shard", "wanted").agg(F.count("*").alias("rows")).collect()}
    if not flows:
        return linked
    share = linked.sparkSession.createDataFrame([(a, b, float(s)) for (a, b), s in quotas(flows, free).items()], "shard int, wanted int, share double")
    luck = F.pmod(F.when(F.col("n") > LARGE, F.xxhash64("doc_id", F.lit(step))).otherwise(F.xxhash64("group", F.lit(step))), F.lit(1 << 20)) / float(1 << 20)
    goes = F.coalesce(luck < F.col("share"), F.lit(False))
    return moving.join(F.broadcast(share), ["shard", "wanted"], "left").withColumn("shard", F.when(goes, F.col("wanted")).otherwise(F.col("shard"))).select(*linked.columns)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """With ``rank`` from 0 in each shard along group and id, gapless."""
    bits = min(max((n // BUCKET_ROWS).bit_length(), 8), 20)
    salt = F.when(F.col("n") > LARGE, F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SALTS))).otherwise(0).cast("int")
    placed = checkpoint(rows.withColumn("bucket", F.shiftrightunsigned("group", 64 - bits).cast("int")).withColumn("salt", salt))
    keys = ["shard", "bucket", "salt"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpoint(counts.select(*keys, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy(*keys).orderBy("group", "doc_id", "size")
    return placed.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, keys).withColumn("rank", F.col("offset") + F.col("inside"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = checkpoint(sized(docs))
    groups = checkpoint(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    total = rows.count()
    sizes = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    every = rows.join(groups, "group", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    every = checkpoint(every.withColumn("shard", F.when(F.col("n") > 1, first).otherwise(shards)))  # shard number ``shards``: the rest
    linked = every.where("n > 1")
    for step in range(rounds):
        linked = checkpoint(propagate(linked, total / shards, shards, step + 3))
    placed = checkpoint(ranked(every.where("n = 1").unionByName(linked), total))
    held = [0] * (shards + 1)
    for r in placed.groupBy("shard").agg(F.count("*").alias("rows")).collect():
        held[r.shard] = r["rows"]
    kept = [min(h, s) for h, s in zip(held, sizes)]
    over = [0, *accumulate(h - k for h, k in zip(held, kept))]  # rows over the sizes of the shards before
    ends = list(accumulate(s - k for s, k in zip(sizes, kept)))  # of each shard's part of the rest
    rest = F.col("rank") + F.when(F.col("shard") == shards, over[shards]).otherwise(of(over[:shards], F.least("shard", F.lit(shards - 1))) - of(kept, F.least("shard", F.lit(shards - 1))))
    fills = F.col("rank") >= of([*kept, 0], F.col("shard"))
    to = F.when(fills, F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("rest")))).otherwise(F.col("shard"))
    slot = F.when(fills, F.col("rest") - of([0, *ends], F.col("to")) + of([*kept, 0], F.col("to"))).otherwise(F.col("rank"))
    out = placed.withColumn("rest", rest).withColumn("to", to.cast("int")).withColumn("slot", slot.cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

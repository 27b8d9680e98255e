"""Placement in a weighted tree of regions, racks and shards by hash draws.

At each level every child of the node reached draws ln(u) / weight, u in (0, 1) from a hash of
the id and the child's name, and the greatest draw wins; the weight of an inner node is the
sum of its shards'. A draw depends on its own child's weight alone, so when weights change
rows move only into nodes whose weight grew or out of those whose weight fell. A new shard
comes as a region of its own and takes rows into itself only.

Everything is column expressions. Slots number the rows of a shard from 0 without gaps: rows
are counted by shard and range of a hash, the counts are summed up over the ranges, and each
range is numbered by itself, so no task holds a shard. A null id is placed as the empty
text; ties and repeated rows take slots of their own in any order; the other columns pass
through, and columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import fresh, partitions

# Region -> rack -> shard -> weight.
Topology = dict[str, dict[str, dict[int, float]]]
EIGHT: Topology = {
    "region-0": {"rack-0": {0: 1.0, 1: 1.0}, "rack-1": {2: 1.0, 3: 1.0}},
    "region-1": {"rack-0": {4: 1.0, 5: 1.0}, "rack-1": {6: 1.0, 7: 1.0}},
}


def grown(topology: Topology, shard: int, weight: float = 1.0) -> Topology:
    """The tree with one more shard in a region of its own."""
    return topology | {f"region-{len(topology)}": {"rack-0": {shard: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    """ln(u) / weight with u from the first 13 hex digits of an md5: 52 bits, never 0."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + name))), 1, 13), 16, 10).cast("double")
    return F.log((bits + 1.0) / float(2**52 + 1)) / F.lit(float(weight))


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def place(key: Column, node: dict, path: str = "") -> Column:
    """The shard that the descent from a node of the tree ends at."""
    names = list(node)
    below = [
        place(key, node[name], f"{path}/{name}") if isinstance(node[name], dict) else F.lit(int(name)) for name in names
    ]
    if len(names) == 1:
        return below[0]
    draws = F.array(*(_draw(key, f"{path}/{name}", _weight(node[name])) for name in names))
    # Held in a one-element array, so that the draws of a level are made once.
    pick = F.transform(F.array(draws), lambda d: F.array_position(d, F.array_max(d)).cast("int"))[0]
    chosen = F.transform(F.array(pick), lambda i: _case(i, below))
    return chosen[0]


def _case(index: Column, values: list[Column]) -> Column:
    out = F.when(index == 1, values[0])
    for i, value in enumerate(values[1:], 2):
        out = out.when(index == i, value)
    return out


def assign(docs: DataFrame, topology: Topology, doc_id: str = "doc_id", shard: str = "shard") -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.withColumn(shard, place(key, topology))


def number(rows: DataFrame, shard: str = "shard", doc_id: str = "doc_id", slot: str = "slot") -> DataFrame:
    """All rows with their place in the shard, gapless from 0."""
    spark = rows.sparkSession
    bucket, start, count, order = (fresh(rows, x) for x in ("_bucket", "_start", "_count", "_order"))
    # 32 bits of a hash order a shard's rows; buckets are ranges of it, so their number does
    # not change the slots.
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 8), 16, 10).cast("long")
    of = F.floor(bits * (4 * partitions(spark)) / F.lit(float(2**32))).cast("int")
    counts = rows.select(shard, of.alias(bucket)).groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard, bucket).orderBy(order, doc_id)
    numbered = rows.withColumn(order, bits).withColumn(bucket, of).withColumn(slot, F.row_number().over(inside) - 1)
    joined = numbered.join(starts, [shard, bucket])
    return joined.withColumn(slot, (F.col(start) + F.col(slot)).cast("long")).drop(bucket, start, order)

"""Order-respecting de-duplication on two keys.

Rows are taken in order; a row stays iff no row that stayed before it shares its id or
its pair. That is the greedy matching of a bipartite graph whose edges are the rows, and
it is computed in rounds: the rows that come first under both of their keys stay, rows
sharing a key with them go, and the rest play the next round. (Blelloch, Fineman, Shun:
"Greedy sequential maximal independent set and matching are parallel on average", 2012.)

Rounds settle most rows at once, but a chain of conflicts takes a round a link. So where rounds
settle little, three further steps follow. (1) A row that comes first under one key and second
under the other stays iff the first row of that other key goes; such links make a forest, which is
followed to its roots, inside blocks of the order first and then by doubling. (2) What is left is
split into connected components, which cannot influence each other: those of bounded size are
walked in order inside a task, many of them side by side. (3) If that settles little as well, the
rows that come first in the order, which depend on no others, are walked in a task; so every turn
settles a block of rows whatever the conflicts. A rest of bounded size is walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import runtime
from postmill.operators.components import components

_ORDER, _ID, _PAIR = "_o", "_i", "_p"
# Rows that one task walks in order; a row costs some hundred bytes there.
WALKED_ROWS = 100_000
ROUNDS = 4


def greedy_dedup(
    rows: DataFrame,
    order: list[str],
    id_key: str,
    pair_key: str,
    hot_min_rows: int = runtime.HOT_MIN_ROWS,
    walked_rows: int = WALKED_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The rows that stay. `order` must be unique over the rows; keys compare null as null.

    Only (order, id, pair) travels; whole rows join back at the end on the unique order. An
    order without value, or one that a row which stays shares with another, is an error.
    """
    # A single number keeps the minima in hash aggregates; a struct has to be sorted.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(order)])
    edges = rows.select(
        place.alias(_ORDER), F.struct(F.col(id_key)).alias(_ID), F.struct(F.col(pair_key)).alias(_PAIR)
    )
    # Of rows with both keys equal only the first can stay: either it stays and blocks the
    # rest, or what blocks it blocks them too. Copies collapse before the shuffle.
    collapsed = edges.groupBy(_ID, _PAIR).agg(
        F.min(_ORDER).alias(_ORDER), F.max(F.col(_ORDER).isNull()).alias("_null")
    )
    collapsed, left, nulls = runtime.cut_and_count(collapsed, F.count_if("_null"))
    if nulls:
        raise ValueError("the order must be unique and never null")
    edges = collapsed.drop("_null")
    kept: list[DataFrame] = []
    played = 0
    while left > walked_rows:
        before = left
        winners = runtime.cut_lineage(_first_on_both_keys(edges))
        kept.append(winners.select(_ORDER))
        edges, left = _without_keys(edges, winners, left, hot_min_rows)
        if left == before:
            raise ValueError("the order must be unique and never null")
        played += 1
        if played < rounds and before - left >= before // 8:
            continue
        played = 0
        for step in (_chained, _split, _first_block):
            if left <= walked_rows:
                break
            before = left
            stay, edges, left = step(edges, left, walked_rows, hot_min_rows)
            kept.append(stay)
            if left <= before // 2:
                break
    if left:
        kept.append(_walked(edges.withColumn("_part", F.lit(0).cast("long"))))
    if not kept:
        return rows.limit(0)
    stay = kept[0]
    for more in kept[1:]:
        stay = stay.unionByName(more)
    stay, expected = runtime.cut_and_count(stay)
    marked = rows.withColumn(_ORDER, place)
    if marked.select(_ORDER).join(stay, _ORDER, "left_semi").count() != expected:
        raise ValueError("the order must be unique and never null")
    return marked.join(stay, _ORDER, "left_semi").select(rows.columns)


def _first_on_both_keys(edges: DataFrame) -> DataFrame:
    """Edges that are the minimum under their id and under their pair.

    The two minima are small aggregates and meet on the order, which is unique, so a key
    holding any share of the rows costs one row per task.
    """
    by_id = edges.groupBy(_ID).agg(F.min(_ORDER).alias(_ORDER))
    by_pair = edges.groupBy(_PAIR).agg(F.min(_ORDER).alias(_ORDER))
    return by_id.join(by_pair, _ORDER).select(_ORDER, _ID, _PAIR)


def _without_keys(edges: DataFrame, winners: DataFrame, left: int, hot_min_rows: int) -> tuple[DataFrame, int]:
    """(the edges that share no key with a winner, their number)."""
    rest = edges
    for key in (_ID, _PAIR):
        hot = runtime.hot_keys(edges, key, left, hot_min_rows)
        if hot is not None and rest is not edges:
            rest = runtime.cut_lineage(rest)
        rest = runtime.split_by_membership(rest, winners.select(key), key, hot)
    return runtime.cut_and_count(rest)


def _with_minima(edges: DataFrame, left: int, hot_min_rows: int, *minima: tuple) -> DataFrame:
    """The edges with the least orders under their keys: (key, {name: order or null of a row}).
    Minima are combined before their shuffle."""
    for key, wanted in minima:
        least = edges.groupBy(key).agg(*(F.min(c).alias(name) for name, c in wanted.items()))
        edges = runtime.cut_lineage(runtime.skew_join(edges, least, key, runtime.hot_keys(edges, key, left, hot_min_rows)))
    return edges


def _chained(edges: DataFrame, left: int, walked_rows: int, hot_min_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(orders that stay, the edges still open, their number) by links between rows.

    A row that is first under one key and not under the other takes the other, unless it is
    taken already; so rows behind it under that key go. If it is the second there, it stays iff
    the first goes.
    """
    own = F.col(_ORDER)
    flagged = _with_minima(edges, left, hot_min_rows, (_ID, {"_f_id": own}), (_PAIR, {"_f_pair": own}))
    first_id, first_pair = own == F.col("_f_id"), own == F.col("_f_pair")
    placed = _with_minima(
        flagged, left, hot_min_rows,
        (_ID, {"_second_id": F.when(~first_id, own), "_taken_id": F.when(first_pair & ~first_id, own)}),
        (_PAIR, {"_second_pair": F.when(~first_pair, own), "_taken_pair": F.when(first_id & ~first_pair, own)}),
    )
    to = F.when(first_pair & (own == F.col("_second_id")), F.col("_f_id")).when(
        first_id & (own == F.col("_second_pair")), F.col("_f_pair")
    )
    links = placed.select(own.alias("node"), to.alias("to"), F.lit(True).alias("odd")).filter("to IS NOT NULL")
    links = runtime.cut_lineage(_shortened(links, left // max(walked_rows, 1000) + 1))
    ends = _followed(links, walked_rows)
    roots = placed.filter(first_id & first_pair).select(own)
    follow = ends.join(roots, ends["to"] == roots[_ORDER], "left_semi").filter("NOT odd").select(F.col("node").alias(_ORDER))
    stay = runtime.cut_lineage(roots.union(follow))
    winners = runtime.cut_lineage(placed.join(stay, _ORDER, "left_semi").select(_ORDER, _ID, _PAIR))
    behind = F.coalesce(own > F.col("_taken_id"), F.lit(False)) | F.coalesce(own > F.col("_taken_pair"), F.lit(False))
    rest = runtime.cut_lineage(placed.filter(~behind).select(_ORDER, _ID, _PAIR))
    return stay, *_without_keys(rest, winners, left, hot_min_rows)


def _shortened(links: DataFrame, blocks: int) -> DataFrame:
    """Links (node, to, odd) followed as far as the block of the order goes that holds the node;
    `to` is always before the node, and `odd` tells whether the two differ."""
    dealt = links.repartitionByRange(blocks, "node").sortWithinPartitions("node")
    return dealt.mapInArrow(_shorten, links.schema)


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, tuple] = {}
    for batch in batches:
        targets, odds = [], []
        for node, to, odd in zip(*(batch.column(c).to_pylist() for c in ("node", "to", "odd")), strict=True):
            further, more = seen.get(str(to), (to, False))
            seen[str(node)] = further, odd != more
            targets.append(further)
            odds.append(odd != more)
        columns = [batch.column("node"), pa.array(targets, batch.column("to").type), pa.array(odds, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "to", "odd"])


def _followed(links: DataFrame, walked_rows: int) -> DataFrame:
    """Links to the roots. Only nodes that others lead to are followed: a bounded number in one
    walk, more by doubling the steps each time."""
    heads, n = runtime.cut_and_count(
        links.join(links.select(F.col("to").alias("node")).distinct(), "node", "left_semi")
    )
    moved = n
    while moved and n > walked_rows:
        heads, _, moved = runtime.cut_and_count(_led_on(heads, heads), F.count_if("moved"))
        heads = heads.drop("moved")
    if moved:
        heads = runtime.cut_lineage(_shortened(heads, 1))
    return _led_on(links, heads).drop("moved")


def _led_on(links: DataFrame, heads: DataFrame) -> DataFrame:
    """The links, each with that of the node it leads to behind it, and whether there is one."""
    far = heads.select(F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
    joined = links.join(far, links["to"] == far["_node"], "left")
    return joined.select(
        "node", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
        F.col("_node").isNotNull().alias("moved"),
    )


def _split(edges: DataFrame, left: int, walked_rows: int, hot_min_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(orders that stay in components of at most so many edges, the other edges, their number).

    Keys are nodes by their hash: if hashes of different keys met, two components would be
    walked as one, which gives the same rows.
    """
    ends = {"a": F.xxhash64(F.lit("id"), _ID), "b": F.xxhash64(F.lit("pair"), _PAIR)}
    hashed = runtime.cut_lineage(edges.withColumns(ends))
    labels = components(hashed).withColumnsRenamed({"node": "a", "component": "_part"})
    parted = runtime.cut_lineage(hashed.join(labels, "a").drop("a", "b"))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > walked_rows).select("_part")
    rest, left = runtime.cut_and_count(parted.join(large, "_part", "left_semi").drop("_part"))
    return _walked(parted.join(large, "_part", "left_anti")), rest, left


def _first_block(edges: DataFrame, left: int, walked_rows: int, hot_min_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(orders that stay in the first block of the order, the later edges still open, their number)."""
    blocks = left // max(walked_rows, 1) + 1
    dealt = runtime.cut_lineage(
        edges.repartitionByRange(blocks, _ORDER).withColumn("_part", F.spark_partition_id().cast("long"))
    )
    first = dealt.filter("_part = 0")
    stay = runtime.cut_lineage(_walked(first))
    winners = runtime.cut_lineage(first.join(stay, _ORDER, "left_semi").select(_ORDER, _ID, _PAIR))
    rest = runtime.cut_lineage(dealt.filter("_part > 0").drop("_part"))
    return stay, *_without_keys(rest, winners, left, hot_min_rows)


def _walked(parted: DataFrame) -> DataFrame:
    """Orders of the edges that stay, each `_part` walked in order on its own."""
    keyed = parted.select("_part", _ORDER, F.to_json(_ID).alias(_ID), F.to_json(_PAIR).alias(_PAIR))
    dealt = keyed.repartition("_part").sortWithinPartitions("_part", _ORDER)
    return dealt.mapInArrow(_walk, T.StructType([keyed.schema[_ORDER]]))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, ids, pairs = None, set(), set()
    for batch in batches:
        stays = []
        for own, one, two in zip(*(batch.column(c).to_pylist() for c in ("_part", _ID, _PAIR)), strict=True):
            if own != part:
                part, ids, pairs = own, set(), set()
            free = one not in ids and two not in pairs
            if free:
                ids.add(one)
                pairs.add(two)
            stays.append(free)
        yield batch.select([_ORDER]).filter(pa.array(stays, pa.bool_()))

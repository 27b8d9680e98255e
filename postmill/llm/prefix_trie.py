"""Prefix trie of conversations by ROLLUP over positional turn columns.

Turns are numbered and cut into blocks of eight columns. A turn's column holds a 128-bit hash of
its position, role and text and the words of its text; a node is known by its depth and the
exclusive or of the hashes on its path. A block carries the node it starts from, so one

    GROUP BY block, <prior node>, ROLLUP (t1, ..., t8)

over all blocks of all conversations aggregates every prefix of every length together:
grouping_id tells how many of the columns a row of the result still has, and rows whose last
column is null are prefixes that no conversation has. Aggregates are combined before their
shuffle, so a first turn that all conversations share costs one row a task.

Sums over subtrees need no walk down the tree. A conversation owns the nodes of which it is the
least member; these are the end of its path. The nodes of a subtree are what its members own,
except that its own least member may own nodes above it, whose words are known from the path.
So the words of distinct nodes, and the leaves, are sums over members, taken by a second ROLLUP
once the first has told what each conversation owns.

A conversation of any length is spread over many tasks: turns are numbered in range partitions,
which hold at most one continued conversation each, blocks are built in stretches of 512, and
what a block starts from is a running exclusive or inside its stretch plus one row a stretch.
Ids of the conversations that end at a node are joined in runs of at most 4096, and the hash over
all of them is carried along sorted runs, never holding them together.

Turns are ordered by number, null first; of equal numbers by a hash of role and text. Null role
or text is empty. Rows without conversation id belong to none. Repeated rows are repeated turns.
An empty table gives no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import partitions, text_or_empty, written

COLUMNS = 8
STRETCH = 512
# Ids are distinct, so a run of ids holds at most two to this power of them.
RUN_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "x", "y"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of every turn, pos from 1, as a written table."""
    role, text = text_or_empty("role"), text_or_empty()
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    # Equal rows are one row with their number, so that any range can be cut in two.
    counted = narrow.groupBy(narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    spread = counted.repartitionByRange(partitions(conversations.sparkSession), F.col("conv_id"), *order)
    spread = written(spread.withColumn("part", F.spark_partition_id()))
    totals = spread.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a part can have begun in an earlier one.
    offsets = totals.withColumn("offset", F.sum("n").over(earlier)).filter("offset > 0").drop("n")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    before = F.col("before") + F.coalesce("offset", F.lit(0))
    return written(
        placed.select("conv_id", F.explode(F.sequence(before + 1, before + F.col("n"))).alias("pos"), "digest", "words")
    )


def rebuilt(turns: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Turns after every conversation took its first h turns, h = crc32(id) % shared, from the
    conversation whose id is its own less the remainder by `family`. A conversation without
    turns has one row without digest."""
    lengths = written(turns.groupBy("conv_id").agg(F.max("pos").alias("length")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = lengths.select("conv_id", h.alias("h"), base.alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    missing = F.col("h") - F.least("h", F.coalesce("base_length", F.lit(0)))
    short = convs.filter("h > 0").join(bases, "base", "left").select("conv_id", missing.alias("missing")).filter("missing > 0")
    heads = turns.filter(F.col("pos") < shared).withColumnRenamed("conv_id", "base")
    taken = convs.filter("h > 0").join(heads, "base").filter("pos <= h").select("conv_id", "pos", "digest", "words")
    own = turns.filter(F.col("pos") > h).join(short, "conv_id", "left")
    own = own.withColumn("pos", F.col("pos") - F.coalesce("missing", F.lit(0))).select(taken.columns)
    none = convs.select(
        "conv_id", F.lit(1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")
    )
    return taken.union(own).union(none)


def blocks_of(turns: DataFrame, columns: int = COLUMNS, stretch: int = STRETCH) -> DataFrame:
    """A row for every block of a conversation: its prior node (px, py), the words before it,
    t1 to t8, the end it reaches (depth, ex, ey) and its own words; a written table."""
    pos, digest = F.col("pos"), F.col("digest")
    block = F.floor((pos - 1) / columns)
    turn = F.struct(F.xxhash64(pos, digest).alias("x"), F.xxhash64(digest, pos, F.lit(1)).alias("y"), "words")
    keyed = turns.select(
        "conv_id", F.floor(block / stretch).alias("stretch"), block.alias("block"), "words",
        F.when(digest.isNotNull(), F.struct("pos", turn.alias("turn"))).alias("turn"),
    )
    xor = lambda c: F.bit_xor(F.coalesce(c, F.lit(0).cast("long")))
    # A stretch has a bounded number of turns and serves the grouping and the window after it.
    grouped = (
        keyed.repartition("conv_id", "stretch").groupBy("conv_id", "stretch", "block")
        .agg(
            F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("words").alias("words"),
            xor(F.col("turn.turn.x")).alias("bx"), xor(F.col("turn.turn.y")).alias("by"),
        )
    )
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = written(
        grouped.select(
            "*", F.bit_xor("bx").over(inside).alias("ix"), F.bit_xor("by").over(inside).alias("iy"),
            F.sum("words").over(inside).alias("iw"),
        )
    )
    totals = running.groupBy("conv_id", "stretch").agg(
        F.bit_xor("bx").alias("sx"), F.bit_xor("by").alias("sy"), F.sum("words").alias("sw")
    )
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "stretch", F.bit_xor("sx").over(earlier).alias("cx"), F.bit_xor("sy").over(earlier).alias("cy"),
        F.sum("sw").over(earlier).alias("cw"),
    ).filter("stretch > 0")
    joined = running.join(carried, ["conv_id", "stretch"], "left")
    zero = F.lit(0).cast("long")
    px, py = (F.coalesce(a, zero).bitwiseXOR(F.coalesce(b, zero)) for a, b in (("ix", "cx"), ("iy", "cy")))
    return written(
        joined.select(
            "conv_id", "block", px.alias("px"), py.alias("py"),
            (F.coalesce("iw", zero) + F.coalesce("cw", zero)).alias("ahead"),
            *(F.get("turns", F.lit(i))["turn"].alias(f"t{i + 1}") for i in range(columns)),
            (F.col("block") * columns + F.size("turns")).alias("depth"),
            px.bitwiseXOR(F.col("bx")).alias("ex"), py.bitwiseXOR(F.col("by")).alias("ey"), "words",
        )
    )


def prefixes(blocks: DataFrame, aggregates: str) -> DataFrame:
    """(depth, x, y, parent's ux and uy, words, ahead: words above it) and the aggregates of
    every node, by ROLLUP over the turn columns of all blocks."""
    turns = [c for c in blocks.columns if c[0] == "t" and c[1:].isdigit()]
    grouped = blocks.sparkSession.sql(
        f"""SELECT block, px, py, {', '.join(turns)}, min(ahead) AS ahead,
              {len(turns)} - bit_count(grouping_id()) AS held, {aggregates}
            FROM {{blocks}} GROUP BY block, px, py, ROLLUP ({', '.join(turns)})""",
        blocks=blocks,
    )
    present = sum((F.col(t).isNotNull().cast("int") for t in turns), F.lit(0))
    nodes = grouped.filter((present == F.col("held")) & ((F.col("held") > 0) | (F.col("block") == 0)))
    last = F.coalesce(*reversed(turns))

    def path(prior: str, part: str) -> Column:
        out = F.col(prior)
        for turn in turns:
            out = out.bitwiseXOR(F.coalesce(F.col(turn)[part], F.lit(0).cast("long")))
        return out

    above = sum((F.coalesce(F.col(t)["words"], F.lit(0)) for t in turns), F.col("ahead")) - F.coalesce(last["words"], F.lit(0))
    own = set(grouped.columns) - {"block", "px", "py", "ahead", "held", *turns}
    shaped = nodes.select(
        (F.col("block") * len(turns) + F.col("held")).alias("depth"), path("px", "x").alias("x"), path("py", "y").alias("y"),
        last["x"].alias("lx"), last["y"].alias("ly"),
        F.coalesce(last["words"], F.lit(0)).alias("words"), above.alias("ahead"), *sorted(own),
    )
    return shaped.withColumns({"ux": F.col("x").bitwiseXOR(F.col("lx")), "uy": F.col("y").bitwiseXOR(F.col("ly"))}).drop("lx", "ly")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of (depth, x, y, conv_id): SHA-256 over a node's ids in
    ascending order, comma-joined."""
    runs = ends.groupBy(*_NODE, F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    schema = pa.schema([(c, pa.int64()) for c in _NODE] + [("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
                if (depth, x, y) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, x, y), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], schema=schema)

    ordered = runs.repartition(*_NODE).sortWithinPartitions(*_NODE, "run")
    return ordered.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, columns: int = COLUMNS, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    blocks = blocks_of(rebuilt(numbered(conversations)), columns, stretch)
    nodes = written(prefixes(blocks, "min(conv_id) AS conv_id"))
    above = [(F.col("depth") - 1).alias("depth"), F.col("ux").alias("x"), F.col("uy").alias("y")]
    children = written(nodes.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children")))
    owned = (
        nodes.join(children, _NODE, "left").groupBy("conv_id")
        .agg(F.sum("words").alias("owned"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    )
    convs = blocks.groupBy("conv_id").agg(
        F.sum("words").alias("total"), F.max(F.struct("block", "depth", F.col("ex").alias("x"), F.col("ey").alias("y"))).alias("end")
    )
    convs = written(convs.join(owned, "conv_id", "left").fillna(0, ["owned", "leaf"]))
    weighed = blocks.join(convs.drop("end"), "conv_id")
    sums = prefixes(
        weighed,
        """min(struct(conv_id, total, owned)) AS least, count(*) AS n_convs, sum(total) AS total,
           sum(owned) AS owned, sum(leaf) AS n_leaves""",
    )
    ends = ends_digests(convs.select("end.depth", "end.x", "end.y", "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    told = sums.join(children, _NODE, "left").join(ends, _NODE, "left").join(parents, ["depth", "ux", "uy"], "left")
    repeated = F.col("total") - F.col("n_convs") * F.col("ahead")
    distinct = F.col("owned") - F.col("least.owned") + F.col("least.total") - F.col("ahead")
    return told.select(
        F.col("least.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (repeated - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

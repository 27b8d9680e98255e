"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each of 64 permutations gives a set its least and its greatest value, so 128 signature
values cost half the hash evaluations; bands of four values make candidates. A pair of
similarity 0.8 shares none of the 32 bands with probability (1 - 0.8^4)^32, about 5e-8.

1. Texts with equal shingle sets are one class, found by a digest in an aggregate that is
   combined before its shuffle. Only the class's least id goes on, so thousands of exact
   copies cost one row.
2. Every bucket of a band elects a hub, the member that shares most buckets, and its members
   are compared with the hub alone: candidates grow with the members, not with their square.
   Pairs whose signatures rule a link out (probability below 1e-9 for a true pair) stop here;
   for the others the full sets give the common size and the shingles that the hub lacks.
3. A member x that its hub does not link can still be linked with another member y. Their
   common size is at most the lesser common size with the hub plus the shingles both have
   and the hub lacks. These are ranked from the rarest among the hub's members; x meets only
   those y that share one with enough others ranked behind it in both, or that pass the bound
   without any, so a shingle that most members hold pairs few of them. The pairs left are
   counted on what the hub lacks, then confirmed on their full sets.
4. Members whose signature rules their hub out meet the other members of the bucket, behind
   the same screens, where these are at most 32. Texts that share no more than a passage can
   crowd a bucket, so the members of larger ones are joined by prefixes of their full sets: a
   set's shingles are put in one order for all, and two sets that could be linked share one
   within a first part of each, whose length follows from the least common size, shorter for
   the smaller set. What they share beyond that place must still suffice. Any order finds all
   links; this one puts shingles of rare slots first, by a table of counts of fixed size, so
   that each task cuts prefixes on its own and only these leave it. A shingle that one component
   alone holds pairs nothing and goes before the join.
5. Members that already are one component never meet again.

No cap cuts any of this off: both ways of step 4 find every link between members.

Nulls and texts without words have no shingles and are linked with nothing. Rows that share
an id are one document, kept or dropped together; rows with a null id stay single and kept.
Tables without rows give none. Other columns are not carried by `near_duplicates` and pass
unchanged through `keep_one`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from postmill.llm.common import fresh, written
from postmill.llm.components import components
from postmill.llm.shingles import mix, shingle_set
from postmill.runtime import fits_broadcast

PERMUTATIONS, BAND_ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
# Of 128 signature values a pair at 0.8 has about 102 equal; the deviation is about 4.5.
SCREEN_EQUAL = 72
# Members of a bucket, its hub aside, that are paired with each other.
PAIRED_MEMBERS = 32
# Counters by which the shingles of crowded buckets are ordered, whatever their number.
SLOTS = 1 << 18


@functools.lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    for i, by in enumerate(_multipliers()):
        values = shingles * by
        values ^= values >> np.uint64(29)
        out[i] = values.min(), values.max()
    return out.T.ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different for equal values in different bands."""
    rows = values.reshape(BANDS, BAND_ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys


def _sketch(width: int):
    @F.arrow_udf("n long, digest binary, payload binary")
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, digests, payloads = [], [], []
        for text in texts:
            own = shingle_set(text.as_py(), width)
            sizes.append(len(own))
            if not len(own):
                digests.append(None)
                payloads.append(None)
                continue
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            values = signature(own)
            payloads.append(band_keys(values).tobytes() + (values >> np.uint64(40)).astype(np.uint8).tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(payloads, pa.binary())],
            ["n", "digest", "payload"],
        )

    return sketch


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(payloads: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_py(), np.int64, BANDS) for x in payloads], pa.list_(pa.int64()))


@F.arrow_udf(T.IntegerType())
def _equal(left: pa.Array, right: pa.Array) -> pa.Array:
    """How many of the signature values of two payloads are equal."""
    if not len(left):
        return pa.array([], pa.int32())
    a, b = (
        np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)[:, 8 * BANDS :] for x in (left, right)
    )
    return pa.array((a == b).sum(1).astype(np.int32))


@F.arrow_udf(T.StructType([T.StructField("common", T.LongType()), T.StructField("novel", T.BinaryType())]))
def _against(hubs: pa.Array, others: pa.Array) -> pa.Array:
    """Size of the intersection of two packed sets, and what the second adds to the first."""
    common, novel = [], []
    for hub, other in zip(hubs, others, strict=True):
        one, two = np.frombuffer(hub.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
        added = two[np.isin(two, one, assume_unique=True, invert=True)]
        common.append(len(two) - len(added))
        novel.append(added.tobytes())
    return pa.StructArray.from_arrays([pa.array(common, pa.int64()), pa.array(novel, pa.binary())], ["common", "novel"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _unpacked(packed: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_py(), np.int64) for x in packed], pa.list_(pa.int64()))


def _set_of(width: int):
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.as_py(), width).tobytes() for x in texts], pa.binary())

    return packed


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the shingles of the packed sets of a task fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for packed in batch.column(0):
            np.add.at(counts, np.frombuffer(packed.as_py(), np.uint64) % SLOTS, 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """At least the number of sets that hold a shingle, by its slot; of fixed size."""
    counted = sets.select("packed").mapInArrow(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found, out = counted.toArrow(), np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _prefix(counts: np.ndarray, percent: int):
    """The first shingles of packed sets, those of rare slots first, up to the place from which
    too few are left for a link."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def first(packed: pa.Array) -> pa.Array:
        out = []
        for one in packed:
            own = np.frombuffer(one.as_py(), np.uint64)
            order = np.argsort(counts[own % SLOTS], kind="stable")  # sets are sorted
            out.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]].view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return first


def _reaches(common, n, m, percent: int):
    """Whether sets of n and m members with so many in common have the similarity."""
    return (100 + percent) * common >= percent * (n + m)


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of class ids that signatures do not rule out."""
    a = classes.select(F.col("rep").alias("a"), F.col("payload").alias("p_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("payload").alias("p_b"))
    return pairs.join(a, "a").join(b, "b").filter(_equal("p_a", "p_b") >= SCREEN_EQUAL).select("a", "b")


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with set sizes, common size and what b adds. Only texts that occur in a
    pair leave the scan: their ids go to it by broadcast if they measure small, else by a join."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    # Rows with the same id hold the same text unless ids clash; the least text stands for it.
    own = texts.join(side, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sets = own.select("id", _set_of(width)(F.col("text").cast("binary")).alias("packed"))
    a = sets.select(F.col("id").alias("a"), F.col("packed").alias("s_a"))
    b = sets.select(F.col("id").alias("b"), F.col("packed").alias("s_b"))
    n_a, n_b = (F.floor(F.octet_length(x) / 8) for x in ("s_a", "s_b"))
    counted = pairs.join(a, "a").join(b, "b").withColumn("_c", _against("s_a", "s_b"))
    return written(counted.select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), "_c.common", "_c.novel"))


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(_reaches(F.col("common"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, output: str) -> DataFrame:
    """The rows with the component of `node`, which is the node itself where it has no link."""
    named = labels.select(F.col("node").alias(node), F.col("component").alias(output))
    return rows.join(named, node, "left").withColumn(output, F.coalesce(output, node))


def link_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((id, n, digest) of every row of (id, text), (digest, component) of every class)."""
    texts = docs.filter(F.col("id").isNotNull())
    sketched = docs.withColumn("_s", _sketch(width)(F.col("text").cast("binary"))).select("id", "_s.*")
    rows = written(sketched)
    classes = written(
        rows.filter("digest IS NOT NULL AND id IS NOT NULL")
        .groupBy("digest").agg(F.min("id").alias("rep"), F.max("payload").alias("payload"))
    )
    exploded = classes.select(F.explode(_bands("payload")).alias("key"), "rep").distinct()
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hits = written(exploded.join(shared, "key"))
    degrees = hits.groupBy("rep").agg(F.sum("members").alias("degree"))
    ranked = hits.join(degrees, "rep").select("key", F.struct(-F.col("degree"), "rep").alias("rank"))
    hubs = ranked.groupBy("key").agg(F.min("rank").alias("rank")).select("key", F.col("rank.rep").alias("a"))
    buckets = written(hits.join(hubs, "key").filter("rep <> a").select("key", "a", F.col("rep").alias("b")))

    pairs = written(buckets.select("a", "b").distinct())
    plausible = written(_screened(pairs, classes))
    compared = _compared(plausible, texts, width)
    links = _links(compared, percent)
    labels = written(components(links))

    unlike = written(_labelled(buckets.join(plausible, ["a", "b"], "left_anti"), labels, "b", "of_b"))
    left = written(
        _beside_hubs(compared, labels, percent)
        .union(_unlike_hubs(unlike, buckets, labels, texts, width, percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    more = _links(_compared(written(_screened(left, classes)), texts, width), percent)
    labels = written(components(links.union(more)))
    named = _labelled(classes.select("digest", "rep"), labels, "rep", "component")
    return rows, named.select("digest", "component")


def _beside_hubs(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, both compared with one hub, that could be linked."""
    both = _labelled(_labelled(compared, labels, "a", "of_a"), labels, "b", "of_b")
    open_hubs = both.filter("of_a <> of_b").select("a").distinct()
    near = written(
        both.join(open_hubs, "a", "left_semi")
        .select("a", "b", "of_b", F.col("n_b").alias("n"), F.col("common").alias("c"), "novel", (F.col("of_a") != F.col("of_b")).alias("open"))
    )
    carried = ["b", "of_b", "n", "c", "open"]
    side = lambda d, by, *keys: d.select(*keys, *(F.col(c).alias(f"{by}_{c}") for c in d.columns if c not in keys))
    # Of two open members the lesser is x, so that no pair comes twice.
    apart = (F.col("x_of_b") != F.col("y_of_b")) & (~F.col("y_open") | (F.col("x_b") < F.col("y_b")))
    bound = lambda shared: _reaches(F.least("x_c", "y_c") + shared, F.col("x_n"), F.col("y_n"), percent)
    # A link holds at least this share of either member, whatever the size of the other.
    alone = lambda more: 100 * (F.col("c") + more) >= percent * F.col("n")

    single = near.select("a", *carried, F.explode(_unpacked("novel")).alias("shingle"))
    held = (
        single.groupBy("a", "shingle")
        .agg(F.count(F.lit(1)).alias("holders"), F.max("open").alias("any_open"))
        .filter("holders > 1 AND any_open")
        .select("a", "shingle", "holders")
    )
    # Rarest first; the first shingle that two members share leaves both enough behind it.
    behind = W.partitionBy("a", "b").orderBy(F.desc("holders"), F.desc("shingle"))
    ranked = single.join(held, ["a", "shingle"]).withColumn("rest", F.row_number().over(behind))
    ranked = written(ranked.filter(alone(F.col("rest"))).drop("holders"))
    sharing = (
        side(ranked.filter("open"), "x", "a", "shingle").join(side(ranked, "y", "a", "shingle"), ["a", "shingle"])
        .filter(apart & bound(F.least("x_rest", "y_rest")))
        .select("a", "x_b", "y_b")
        .distinct()
    )
    members = near.select("a", "b", "n", "c", "novel")
    counted = sharing.join(side(members.withColumnRenamed("b", "x_b"), "x", "a", "x_b"), ["a", "x_b"]).join(
        side(members.withColumnRenamed("b", "y_b"), "y", "a", "y_b"), ["a", "y_b"]
    )
    sharing = counted.filter(bound(_against("x_novel", "y_novel")["common"]))
    inside = near.filter(alone(F.lit(0))).select("a", *carried)
    without = side(inside.filter("open"), "x", "a").join(side(inside, "y", "a"), "a").filter(apart & bound(F.lit(0)))
    ends = [F.col("x_b").alias("a"), F.col("y_b").alias("b")]
    return sharing.select(ends).union(without.select(ends))


def _unlike_hubs(
    unlike: DataFrame, buckets: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """Pairs of members of one bucket, one of them unlike the hub, that could be linked."""
    open_ = buckets.join(unlike.select("key").distinct(), "key", "left_semi")
    sizes = open_.groupBy("key").agg((F.count(F.lit(1)) > PAIRED_MEMBERS).alias("crowded"))
    sized = written(open_.join(sizes, "key"))
    few = _labelled(sized.filter("NOT crowded"), labels, "b", "of_y")
    joined = unlike.select("key", F.col("b").alias("x"), F.col("of_b").alias("of_x")).join(
        few.select("key", F.col("b").alias("y"), "of_y"), "key"
    )
    paired = joined.filter("x <> y AND of_x <> of_y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    crowded = written(sized.filter("crowded").select(F.col("b").alias("id")).distinct())
    return paired.union(_prefix_pairs(crowded, texts, labels, width, percent))


def _prefix_pairs(wanted: DataFrame, texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the wanted ids, of different components, that hold every link between
    them: sets that share a shingle within the prefixes that a link would need."""
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    own = texts.join(side, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    # One Python function a stage: each further one takes a worker more for every running task.
    sets = written(_labelled(own.select("id", _set_of(width)(F.col("text").cast("binary")).alias("packed")), labels, "id", "of"))
    n = F.floor(F.octet_length("packed") / 8).alias("n")
    # Spread out where it is made: of a column, Spark would filter empty ones by a second call.
    longer = written(sets.select("id", "of", n, F.posexplode(_prefix(_slot_counts(sets), percent)("packed")).alias("place", "shingle")))
    # Near copies share most of their prefixes; what only one component holds pairs nothing.
    mixed = longer.groupBy("shingle").agg((F.min("of") != F.max("of")).alias("mixed")).filter("mixed")
    longer = written(longer.join(mixed, "shingle", "left_semi"))
    behind = F.col("n") - F.col("place")
    # A set of at most the other's size shares at least 2p / (100 + p) of itself, any p / 100.
    shorter = longer.filter((100 + percent) * behind >= 2 * percent * F.col("n"))
    x = shorter.select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("id", "of", "n", "place")))
    y = longer.select("shingle", *(F.col(c).alias(f"y_{c}") for c in ("id", "of", "n", "place")))
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    met = x.join(y, "shingle").filter(
        smaller & (100 * F.col("x_n") >= percent * F.col("y_n")) & (F.col("x_of") != F.col("y_of"))
        & _reaches(left, F.col("x_n"), F.col("y_n"), percent)
    )
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row. Documents are linked whose
    sets of `width`-word shingles have a Jaccard similarity of `percent` / 100 or more;
    component_id is the least id reachable over links and kept marks its own row."""
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows, classes = link_components(plain, width, percent)
    joined = rows.join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the document with the least id in each component, all columns kept."""
    result = near_duplicates(docs, width, percent, doc_id, text)
    # Texts stay where they are read: the ids to drop go to them by broadcast if they measure small.
    dropped = written(result.filter("NOT kept").select(F.col(doc_id).alias(fresh(docs, "_dropped"))).distinct())
    side = F.broadcast(dropped) if fits_broadcast(dropped) else dropped
    return docs.join(side, docs[doc_id] == dropped[dropped.columns[0]], "left_anti")

"""The streaming table equals one batch, and a replayed batch changes nothing."""

import random
import re

import pytest
from test_greedy import sequential

from postmill.operators.joins import identity_keys
from postmill.streaming import ingest
from postmill.streaming.ingest import AcceptedKeys, incremental_ingest, keep_new

SCHEMA = "o long, title string, company string, job_id string"


def edges(seed, n=240):
    rng = random.Random(seed)
    return [(o, f"T{rng.randrange(40)}", f"C{rng.randrange(2)}", str(rng.randrange(80))) for o in range(n)]


def kept_in_order(rows):
    return sequential([(o, i, (t, c)) for o, t, c, i in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rows = edges(seed)
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 2))
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    incremental_ingest(stream, out, str(tmp_path / "state"), ["o"], buckets=16).awaitTermination()
    table = spark.read.parquet(out)
    expected = kept_in_order(rows)
    assert sorted(r.o for r in table.collect()) == expected
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"batch_id={n}" for n in range(3)]

    # Replay of the last batch sees only what came before it, although its keys are there.
    last = spark.createDataFrame(rows[cuts[-1]:], SCHEMA)
    accepted = AcceptedKeys(spark, f"{out}.keys", 16)
    for limit in (10**9, 0):
        again = keep_new(last, accepted, "2", ["o"], limit, hot_min_rows=1)
        assert sorted(r.o for r in again.collect()) == [o for o in expected if o >= cuts[-1]]
    assert keep_new(last, accepted, "3", ["o"]).count() == 0


@pytest.mark.parametrize("broken", ["write of postings", "write of keys", "after keys"])
def test_a_batch_that_breaks_off_is_replayed(spark, tmp_path, monkeypatch, broken):
    """The steps of a micro-batch in a stream that fails once and is started again."""
    rows = edges(5, 120)
    for a in (0, 60):
        spark.createDataFrame(rows[a : a + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["o"], buckets=8)
    real_add, real_keep = AcceptedKeys.add, ingest.keep_new

    def fail(*_):
        raise RuntimeError("broken off")

    def add(self, kept, batch):
        if batch == "1" and broken == "write of keys":
            fail()
        real_add(self, kept, batch)
        if batch == "1":
            fail()

    with monkeypatch.context() as patch:
        patch.setattr(AcceptedKeys, "add", add)
        if broken == "write of postings":
            patch.setattr(ingest, "keep_new", lambda b, a, n, o: fail() if n == "1" else real_keep(b, a, n, o))
        with pytest.raises(Exception, match="broken off"):
            start().awaitTermination()
    start().awaitTermination()
    assert sorted(r.o for r in spark.read.parquet(str(tmp_path / "out")).collect()) == kept_in_order(rows)


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    accepted = AcceptedKeys(spark, str(tmp_path / "keys"), 256)
    digested = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumns(identity_keys()).withColumns(ingest.digests())
    for batch in range(3):
        accepted.add(digested(edges(batch, 100)), str(batch))
    wanted = accepted.of(digested([(0, "T1", "C1", "7"), (1, "new", "new", "new")])).checkpoint()
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    df = accepted.among(wanted, "9")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    listed = re.search(r"bucket#\d+ IN \(([\d,]+)\)", pruned).group(1)
    assert 0 < len(listed.split(",")) <= 4
    assert "title" not in plan and "company" not in plan
    assert df.count() == 2


def test_key_folders_are_merged_and_still_know_their_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE_FOLDERS", 3)
    accepted = AcceptedKeys(spark, str(tmp_path / "keys"), 4)
    rows = edges(9, 60)
    digested = lambda part: spark.createDataFrame(part, SCHEMA).withColumns(identity_keys()).withColumns(ingest.digests())
    for batch in range(6):
        accepted.add(digested(rows[batch * 10 : batch * 10 + 10]), str(batch))
    assert accepted.log.folders() <= 4
    wanted = accepted.of(digested(rows)).checkpoint()
    assert accepted.among(wanted, "none").count() == wanted.count()
    last = accepted.of(digested(rows[50:])).checkpoint()
    only_last = last.join(accepted.of(digested(rows[:50])), "key", "left_anti")
    assert accepted.among(wanted, "5").count() == wanted.count() - only_last.count()
    before = accepted.log.versions()[-1]
    accepted.add(digested(rows[:10]), "0")  # added before, and merged since
    assert accepted.log.versions()[-1] == before

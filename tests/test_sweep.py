"""The streaming sweep against the batch clusters."""

import random

from pyspark.sql import functions as F

from palindra.operators import overlap
from palindra.plans.params import Params
from palindra.streaming import sweep

SCHEMA = f"file string, {sweep._ROW}, skip boolean"


def candidates(rng, files=3):
    out = []
    for f in range(files):
        for contig in sorted(rng.sample(range(9), rng.randrange(1, 4))):
            for _ in range(rng.randrange(0, 25)):
                lts = rng.randrange(0, 900)
                out.append((f"f{f}", contig, lts, lts + 5, rng.randrange(9), rng.randrange(9), 20, lts + 9, lts + rng.randrange(20, 60), 3, float(rng.randrange(80, 84)), rng.random() < 0.3))
    return list(dict.fromkeys(out))


def shuffled(rows, rng, bound):
    """Any order in which no row comes after one more than ``bound`` further on."""
    return sorted(rows, key=lambda r: (r[1], r[2] + rng.uniform(0, bound)))


def batch(spark, rows):
    found = overlap.best_per_cluster(overlap.clusters(spark.createDataFrame(rows, SCHEMA)))
    return sorted(tuple(r) for r in found.select("file", *sweep.COLUMNS).collect())


def test_any_order_within_the_bound_gives_the_batch_clusters(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        rows += [(f"{k}-{r[0]}", *r[1:]) for r in candidates(rng)]
    want, got, most, late = batch(spark, rows), [], 0, 0
    for file in sorted({r[0] for r in rows}):
        mine, work, at = shuffled([r for r in rows if r[0] == file], rng, 100), sweep.Sweep(100), 0
        while at < len(mine):
            part = mine[at : at + rng.randrange(1, 6)]
            at += len(part)
            got += [(file, *r) for r in work.add([(r[1:11], r[11]) for r in part], False)]
            late += len(got)
            reach = [r for r in work.window if r[0] < work.mark[0] or r[1] < work.mark[1] - 100]
            assert not reach
            most = max(most, len(work.window))
        got += [(file, *r) for r in work.add([], True)]
        assert not work.window and work.best is None
    assert sorted(got) == want and len(want) > 300 and late
    assert most < 25


def test_a_row_that_comes_too_late_is_an_error():
    work = sweep.Sweep(10)
    row = lambda contig, at: ((contig, at, 0, 0, 0, 0, 0, at + 5, 0, 90.0), False)
    assert work.add([row(0, 100)], False) == [] and work.add([row(0, 90)], False) == []
    assert [r[1] for r in work.add([row(0, 300)], False)] == [90, 100]
    for late in (row(0, 289),):
        try:
            work.add([late], False)
        except ValueError:
            break
    else:
        raise AssertionError("not told")


def test_the_stream_keeps_its_state_between_batches(spark, tmp_path):
    rng, bound = random.Random(6), 50
    rows = candidates(rng, files=4)
    want = batch(spark, rows)
    folder = tmp_path / "in"
    mixed = shuffled(rows, rng, bound)
    parts = [mixed[k : k + 40] for k in range(0, len(mixed), 40)]
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA).withColumn("ended", F.lit(False))
        if k == len(parts) - 1:
            df = sweep.with_ends(spark.createDataFrame(rows, SCHEMA)).where("ended").unionByName(df)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        query = sweep.start_sweep(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), bound)
        query.awaitTermination(120)
        if k == 0:
            first = spark.read.parquet(str(tmp_path / "out")).count()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("file", *sweep.COLUMNS).collect())
    assert got == want and first < len(want)
    assert sweep.disorder(Params()) == 1032

"""Both kernels of the edit distance against the full table."""

import random

import numpy as np
from pyspark.sql import functions as F

from palindra.operators import distance


def table(u, v):
    row = list(range(len(v) + 1))
    for i, a in enumerate(u, 1):
        new = [i]
        for j, b in enumerate(v, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def pairs(seed, count):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    out = [("", ""), ("", "ACG"), ("ACG", ""), ("N", "N"), ("A" * 64, "A" * 64), ("A" * 65, "A" * 63), ("C" * 128, "A" + "C" * 128), (draw(200), draw(30))]
    for _ in range(count):
        u = draw(rng.randrange(1, 210))
        v = list(u)
        for _ in range(rng.randrange(0, 12)):
            at, kind = rng.randrange(len(v) + 1), rng.random()
            if kind < 0.4:
                v.insert(at, rng.choice("ACGT"))
            elif at < len(v):
                v[at : at + 1] = [] if kind < 0.7 else [rng.choice("ACGT")]
        out.append((u, "".join(v)) if rng.random() < 0.8 else (u, draw(rng.randrange(1, 210))))
    return out


def test_kernels_equal_the_full_table():
    some = pairs(1, 150)
    us, vs = map(list, zip(*some, strict=True))
    want = np.array([table(u, v) for u, v in some])
    assert distance.bit_parallel(us, vs).tolist() == want.tolist()
    for share in (0.05, 0.2, 1.0):
        band = np.array([int(max(len(u), len(v)) * share) + 2 for u, v in some])
        assert distance.furthest(us, vs, band).tolist() == np.where(want <= band, want, band + 1).tolist()


def test_columns_equal_levenshtein(spark):
    rows = [(k, *x) for k, x in enumerate(pairs(2, 60))] + [(900, None, "A"), (901, "A", None)]
    df = spark.createDataFrame(rows, "k int, u string, v string").withColumn("band", F.lit(9).cast("long"))
    got = df.select("k", F.levenshtein("u", "v").alias("d"), distance.bit_distance(F.col("u"), F.col("v")).alias("bits"), distance.furthest_distance(F.col("u"), F.col("v"), F.col("band")).alias("near")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.bits == r.d and r.near == (None if r.d is None else min(r.d, 10))

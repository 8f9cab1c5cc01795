"""The columns of the mix that SQL can tell, against DuckDB; the flight against a plain cube method."""

import random

import duckdb
import numpy as np

from palindra.llm import mixing

#: Sizes, and targets by three rounds of sharing: no more are needed for the tables at hand, which the last line checks.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM '{path}/documents.parquet'),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1] AS weight, 1.5 * sum(source_size) OVER () AS all_ FROM s),
a AS (SELECT *, all_ * weight / sum(weight) OVER () > 2 * source_size AS full1 FROM w),
b AS (SELECT *, (all_ - sum(CASE WHEN full1 THEN 2 * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN full1 THEN 0 ELSE weight END) OVER () AS next1 FROM a),
c AS (SELECT *, full1 OR next1 > 2 * source_size AS full2 FROM b),
e AS (SELECT *, (all_ - sum(CASE WHEN full2 THEN 2 * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN full2 THEN 0 ELSE weight END) OVER () AS next2 FROM c),
t AS (SELECT *, CASE WHEN full2 THEN 2.0 * source_size ELSE next2 END AS target FROM e)
SELECT doc_id, size::BIGINT, source_size, target::DOUBLE FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE target <= 2.0 * source_size + 1e-6
"""


def test_sizes_and_targets_equal_their_sql(spark):
    path = "/root/testdata/sf0.01"
    want = sorted(duckdb.sql(SQL.format(path=path)).fetchall())
    rows = mixing.op2_mixing(spark, path).collect()
    got = sorted((r.doc_id, r.size, r.source_size, r.target) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 1000
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken.setdefault((r.source_size, r.target), []).append((r.taken, r.size))
    for (_, target), some in taken.items():
        assert abs(sum(t for t, _ in some) - target) <= max(s for _, s in some)


def plain_cube(size, chance, rng):
    """The flight by the null space of the balance constraints, from a singular value decomposition in every step."""
    p = np.array(chance, float)
    while True:
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if len(open_) <= 2:
            return p
        a = np.vstack([np.array(size, float)[open_], np.ones(len(open_))])
        u = np.linalg.svd(a)[2][-1]
        q = p[open_]
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        p[open_] = q + (up if rng.random() < down / (up + down) else -down) * u


def test_the_flight_does_as_a_plain_cube_method():
    """Both end with two open units at most, keep the balance sums, and change no unit's chance on average."""
    rng = random.Random(5)
    size, chance = [rng.randrange(1, 60) for _ in range(14)], [rng.uniform(0.1, 0.9) for _ in range(14)]
    sums = np.array([np.dot(size, chance), sum(chance)])
    means = []
    for fly in (lambda r: np.array(mixing.cube_flight(size, chance, r)), lambda r: plain_cube(size, chance, r)):
        ends = np.array([fly(random.Random(s)) for s in range(1500)])
        assert (((ends > 1e-6) & (ends < 1 - 1e-6)).sum(axis=1) <= 2).all()
        assert np.allclose(np.column_stack([ends @ size, ends.sum(axis=1)]), sums, atol=1e-5)
        means.append(ends.mean(axis=0))
    assert np.abs(means[0] - means[1]).max() < 0.07 and np.abs(means[0] - chance).max() < 0.05


def test_rows_without_an_id_fly_in_blocks(spark):
    rng = random.Random(6)
    rows = [(None, " ".join("w" for _ in range(rng.randrange(1, 2000))), "en", "s", 1) for _ in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), block=64).collect()
    assert len(got) == 1500 and abs(sum(r.taken for r in got) - got[0].target) <= 2000

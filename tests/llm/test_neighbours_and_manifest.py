"""Merkle manifests, hard negatives and vantage-point trees against brute force, and their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palindra.llm import merkle, metric, negatives, vantage

VECTORS = "vec_id long, embedding array<float>, label int, place string, score int"


def vectors(spark, rows):
    """(id, vector, label), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).withColumns({c: F.lit("x") for c in ("g", "block", "dim", "class", "query", "v", "bar")})


def sample(n=260, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim)) * 2
    x = (centre[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 0.4).astype(np.float32)
    x[40:90] = x[40]  # a large group of equal vectors
    rows = [(k, x[k].tolist(), int(rng.integers(0, 3))) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (301, [nan] * dim, 1), (302, [inf, *[0.0] * (dim - 1)], 0), (303, [None, *[1.0] * (dim - 1)], 0), (304, [], 0), (305, [0.0] * dim, 1), (306, x[3].tolist(), None)]
    rows += [(7, x[9].tolist(), 2), (8, x[8].tolist(), rows[8][2]), (None, x[20].tolist(), 1), (None, x[21].tolist(), 1), (307, [1.0, 2.0], 1), (308, [2.0, 1.0], 2), (320, [3.0, 1.0], 1)]
    return rows


def usable(rows, zero=True):
    return [r for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and (zero or any(r[1]))]


LAST = 1 << 63


def brute_negatives(rows, anchors, scale=256):
    rows = [(i, [int(np.floor(scale * float(c))) for c in v], label) for i, v, label in usable(rows) if label is not None]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    order = lambda r: (-r[1], LAST if r[0] is None else r[0])
    out = []
    for i, v, label in rows:
        if i is None or not anchors(i):
            continue
        scored = [(j, dot(v, w), other) for j, w, other in rows if len(w) == len(v)]
        for p, ps, _ in sorted([r for r in scored if r[2] == label and r[0] != i], key=order)[:5]:
            fit = sorted([r for r in scored if r[2] != label and 80 * ps <= 100 * r[1] <= 100 * ps], key=order)[:5]
            out += [(i, p, k + 1, n, ps, ns) for k, (n, ns, _) in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = sample()
    want = brute_negatives(rows, lambda i: i % 4 == 0)
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 4 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 100
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "AT_ONCE", 64)
    again = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 4 == 0)
    assert sorted(map(tuple, again.collect()), key=str) == want


def test_hard_negatives_of_few_rows_and_none(spark):
    assert negatives.hard_negatives(vectors(spark, []).limit(0), F.col("vec_id") % 4 == 0).collect() == []
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.8, 0.1], 1), (4, [-1.0, 0.0], 1), (3, [0.85, 0.3], None)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 4 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_products_of_large_components_are_exact():
    x, y = np.array([[1 << 40, -3]]), np.array([[1 << 20, 5], [-(1 << 22), 7]])
    assert negatives.products(x, y).tolist() == [[(1 << 60) - 15, -(1 << 62) - 21]]
    big = np.array([[1 << 53, 1 << 53]])
    assert negatives.products(big, big).tolist() == [[(1 << 63) - 1]]


def test_what_is_not_served_holds_nothing(spark):
    """Every candidate that reaches a query's bar lies in a cell and at a distance that its group is served."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 5)) * 0.2 + rng.normal(size=5) * 4 for _ in range(6)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>").select(F.size("v").alias("dim"), F.lit(0).alias("class"), "vec_id", F.lit(0).cast("long").alias("label"), "v", (F.col("vec_id") % 50 == 0).alias("query"))
    cells, n, asked = metric.fit(df, "<f8")
    rows = metric.assign(df, cells).cache()
    asking = metric.groups(rows, cells, asked, 4)
    bars, at = [], {}
    for r in asking.collect():
        for k, i in enumerate(np.frombuffer(r.ids, np.int64).tolist()):
            bars.append((r.g, k, float(np.sort(x @ x[i])[-9])))
            at[r.g, k] = i
    reach = {}
    for r in metric.served(asking, spark.createDataFrame(bars, "g long, at long, bar double"), cells).collect():
        reach[r.g, r.part] = r.low, r.high
    placed = {r.vec_id: (r.place, r.dist) for r in rows.collect()}
    for g, k, bar in bars:
        for i in np.flatnonzero(x @ x[at[g, k]] >= bar).tolist():
            low, high = reach[g, placed[i][0]]
            assert low <= placed[i][1] <= high
    assert len(reach) < len({g for g, _, _ in bars}) * len(cells.pivots[5])


def brute_nearest(rows, asked, k):
    rows, out = usable(rows, zero=False), []
    for i, v, _ in rows:
        if i is None or not asked(i):
            continue
        scored = []
        for j, w, _ in rows:
            if j != i and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w, strict=True):
                    s += float(np.float32(a)) * float(np.float32(b))
                scored.append((-s, LAST if j is None else j))
        out += [(i, n + 1, None if j == LAST else j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_vantage_points_are_exact_at_one(spark, monkeypatch):
    rows = sample()
    want = brute_nearest(rows, lambda i: i % 5 == 0, 20)
    monkeypatch.setattr(vantage, "LEAF", 4)
    for shard, group in ((4096, 1024), (24, 7)):
        monkeypatch.setattr(vantage, "GROUP", group)
        got = vantage.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, relax=1.0, shard=shard)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert vantage.nearest(vectors(spark, []).limit(0), F.col("vec_id") % 5 == 0).collect() == []
    with pytest.raises(ValueError):
        vantage.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, relax=0.5)


def test_vantage_points_leave_out_more_when_relaxed_and_keep_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells, ids = metric.Cells({64: 1.000001}, {}, "<f4"), np.arange(3000)
    order, bounds = vantage.build(cells.lifted(x))
    assert sorted(order.tolist()) == ids.tolist() and len(bounds) == vantage._inner(3000)
    best = np.argsort(-(x[:150].astype(float) @ x.T.astype(float)) + 9 * (ids[:150, None] == ids), axis=1)[:, :20]
    share = {}
    for relax in (1.0, vantage.RELAX, 50.0):
        group = metric.Group("<f4", 64, np.zeros(150, np.int64).tobytes(), ids[:150].tobytes(), np.zeros(150, np.int64).tobytes(), x[:150].tobytes())
        work = vantage._Search(0, group, [], 20, cells, relax)
        work.take(ids[order], None, x[order], bounds.tobytes())
        found = set(zip(work.lists.at.tolist(), work.lists.name.tolist(), strict=True))
        assert len(found) == len(work.lists.at)
        share[relax] = np.mean([(q, i) in found for q in range(150) for i in best[q].tolist()])
    assert share[1.0] == 1.0 and share[vantage.RELAX] >= 0.95 and share[50.0] < share[vantage.RELAX]


def test_the_query_finds_nine_tenths_of_the_nearest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want = {(q, i) for q, _, i, _ in brute_nearest([tuple(r) for r in rows], lambda i: i % 20 == 0, 20)}
    got = vantage.op13_vantage(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 25 * 20
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.95 * len(want)


# op 11


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows, fanout=3):
    """{row: (leaf, subroot, root, proof, folded, verified)} by plain loops over lists of nodes."""
    leaf = {k: digest(*map(field, (r[0], r[2], r[3], r[4], r[1]))) for k, r in enumerate(rows)}
    proof = {k: [] for k in leaf}

    def tree(nodes):
        """nodes: (members, digest); returns the root and notes the siblings."""
        while len(nodes) > 1:
            above = []
            for s in range(0, len(nodes), fanout):
                run = nodes[s : s + fanout]
                for n, (members, _) in enumerate(run):
                    for k in members:
                        proof[k].append((n, [d for m, (_, d) in enumerate(run) if m != n]))
                above.append(([k for members, _ in run for k in members], digest(*[d for _, d in run])))
            nodes = above
        return nodes[0]

    tops, subroot = [], {}
    for source in sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted([k for k, r in enumerate(rows) if r[2] == source], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        tops.append(tree([([k], leaf[k]) for k in mine]))
        subroot |= dict.fromkeys(mine, tops[-1][1])
    root, out = tree(tops)[1], []
    for k, r in enumerate(rows):
        text = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        d = digest(*map(field, (r[0], r[2], r[3], r[4], text)))
        for n, run in proof[k]:
            d = digest(*run[:n], d, *run[n:])
        out.append((r[0], leaf[k], subroot[k], root, digest(*[d for _, run in proof[k] for d in run]), d, d == root))
    return sorted(out, key=str)


def books(seed=5, n=90):
    rng = np.random.default_rng(seed)
    rows = [(k, "\n".join(["wörter"] * int(rng.integers(1, 4))), [None, "a", "b", "Ü", "", "hot", "hot", "hot"][rng.integers(0, 8)], "en" if k % 3 else None, int(rng.integers(0, 99))) for k in range(n)]
    return rows + [(None, "no id\n", "a", "en", 5), (None, None, None, None, None), (4, "again", "a", "de", 1), (4, "again", "a", "de", 1), (200, "", "lone", "en", None), (201, "x\n" * 5000, "hot", "en", 3)]


def written(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumns({c: F.lit("x") for c in ("leaf", "group_no", "index", "proof")})
    df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_the_manifest_equals_plain_loops(spark, tmp_path, monkeypatch, levels):
    """Also with superblocks so small that they are reduced several times."""
    rows = books()
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], levels))
    got = merkle.op11_merkle(spark, written(spark, rows, tmp_path, "docs"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {v[-1] for v in want} == {True, False}


def test_manifests_of_one_leaf_and_of_none(spark, tmp_path):
    one = [(9, "only\none", "s", "en", 8)]
    got = merkle.op11_merkle(spark, written(spark, one, tmp_path, "one")).collect()
    assert list(map(tuple, got)) == brute_manifest(one) and got[0].leaf == got[0].subroot == got[0].root
    df = spark.createDataFrame(one, "doc_id long, text string, source string, lang string, n_chars long").limit(0)
    df.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op11_merkle(spark, f"{tmp_path}/none").collect() == []


def test_any_change_of_a_field_is_seen(spark):
    rows = spark.createDataFrame([(k, f"text {k}", "s" if k % 4 else "t") for k in range(40)], "doc_id long, text string, source string")
    leaves = rows.withColumn("leaf", merkle.leaf_digest(F.col("doc_id"), F.col("text"))).withColumn("other", merkle.leaf_digest(F.col("doc_id"), F.concat("text", F.lit("!"))))
    proofs = merkle.manifest(leaves, carry=("other",)).withColumn("none", F.lit(None).cast("string"))
    assert all(r.verified for r in merkle.verify(proofs).collect())
    assert not any(r.verified for r in merkle.verify(proofs, "other").collect())
    assert not any(r.verified or r.folded_root for r in merkle.verify(proofs, "none").collect())


def test_top_products_prune_blocks_by_length_before_they_are_sent(spark, monkeypatch):
    """Many blocks of falling length: exact, and the short ones meet no query."""
    from palindra.llm import topk

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)) * np.linspace(4, 0.01, 600)[:, None]
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 16)
    sent = []
    meet = topk._meet
    monkeypatch.setattr(topk, "_meet", lambda pairs, *a: (sent.append(pairs.count()), meet(pairs, *a))[1])
    got = topk.top_products(vectors(spark, rows), F.col("vec_id") % 15 == 0).collect()
    ints = np.floor(x.astype(np.float32).astype(float) * 1024).astype(np.int64)
    want = set()
    for q in range(0, 600, 15):
        scores = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(sent) < 0.8 * 15 * 4

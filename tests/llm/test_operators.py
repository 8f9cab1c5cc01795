"""The data-pipeline operators against brute force, and their edge cases."""

import hashlib
import json
import math
import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from palindra.llm import chat, embedding, graph, html_text, langid, lattice, mixing, run_index, sharding, simhash, suffix, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(id, text, lang, source), with an extra column whose name clashes with inner ones."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], DOCS + ", size int").withColumns({c: F.lit("x") for c in ("pack", "print", "key", "copies", "chance")})


WORDS = "the of and to in is it was that for on are with as his they be at one have this from or had by hot but some what there".split()
DEUTSCH = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()


def corpus(spark, n=60, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = WORDS if k % 3 else DEUTSCH
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))), "en" if k % 3 else "de", f"s{k % 4}" if k % 7 else None))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    for k in range(8):
        rows.append((n + k, rows[k][1][:40] + " " + passage + " " + rows[k + 9][1][:50], "en", "s0"))
    rows += [(n + 10, rows[5][1], "en", "s1"), (n + 11, rows[5][1] + " more", "en", "s1"), (n + 12, None, None, None), (n + 13, "", "en", "s0"), (n + 14, " \n\t ", None, "s2"), (n + 15, "12345 67 !!", "en", "s1"), (3, rows[3][1], "de", "s3"), (None, "a row without a key", "en", "s0"), (n + 16, "x" * 30_000, None, "s1"), (n + 17, "é" * 200 + " ü" * 90, None, "s1")]
    return documents(spark, rows)


def local(df):
    return sorted(df.select("doc_id", "text", "lang", "source").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))


def empty(spark):
    return documents(spark, []).limit(0)


# op 9


def brute_capacity(sizes, shards):
    def parts(c):
        n, fill = 1, 0
        for s in sizes:
            if s > c:
                return math.inf
            if fill + s > c:
                n, fill = n + 1, 0
            fill += s
        return n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if parts(c) <= shards)


def test_minimax_partition():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randrange(1, 40) if rng.random() < 0.9 else rng.randrange(40, 200) for _ in range(rng.randrange(1, 30))]
        shards = rng.randrange(1, 9)
        best = brute_capacity(sizes, shards)
        assert sharding.smallest_capacity(np.array(sizes), shards) == best
        cut = sharding.minimax_cuts(np.array(sizes), shards)
        assert (np.diff(cut) >= 0).all() and cut.max() < shards
        assert max(np.bincount(cut, sizes)) <= best


def test_sharding(spark):
    df = corpus(spark)
    rows = sharding.shard_documents(df, shards=5).collect()
    assert len(rows) == df.count() and {r.law for r in rows} == {"bytes"}
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for k, x in groups.items() if k != (8, 0)) and len(groups[8, 0]) <= 2  # null is not empty
    hot = documents(spark, [(k, "same text", "en", "s") for k in range(500)] + [(600, None, None, None)])
    rows = sharding.shard_documents(hot, cells=64).collect()
    assert len({r.shard for r in rows if r.size > 8}) == 1 and sorted(r.slot for r in rows if r.size > 8) == list(range(500)) or len(rows) == 501
    assert sharding.shard_documents(empty(spark)).count() == 0


# op 2


def test_target_shares():
    assert mixing.target_shares([100, 100], [3, 1], 1.5, 2.0) == [200.0, 100.0]
    assert mixing.target_shares([0, 50], [3, 1], 1.5, 2.0) == [0.0, 75.0]
    assert mixing.target_shares([], [], 1.5, 2.0) == []


def test_cube_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 200).astype(float).tolist()
    for seed in range(20):
        p = np.array(mixing.cube_flight(sizes, [0.3] * 200, random.Random(seed), True))
        assert set(p) <= {0.0, 1.0} and abs(p.sum() - 60) <= 2 and abs(p @ sizes - 0.3 * sum(sizes)) <= 100
    mean = np.mean([mixing.cube_flight(sizes[:12], [0.4] * 12, random.Random(s), True) for s in range(3000)], axis=0)
    assert abs(mean - 0.4).max() < 0.05


def test_mixing(spark):
    df = corpus(spark, 400)
    rows = mixing.mix_sources(df, block=32).collect()
    again = mixing.mix_sources(df.repartition(7), block=32).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == df.count()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for x in by.values():
        assert sum(r.size for r in x) == x[0].source_size and abs(sum(r.taken for r in x) - x[0].target) <= 150
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_of_equal_sizes_and_keys(spark):
    """Ties in size over several blocks; a hot key and null keys are no large block."""
    even = documents(spark, [(k, "four words are here", "en", "a" if k % 2 else "b") for k in range(3000)])
    rows = mixing.mix_sources(even, block=64).collect()
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        assert len(mine) == 1500 and abs(sum(r.taken for r in mine) - mine[0].target) <= 8
    hot = documents(spark, [(7, "one two three", "en", "a")] * 900 + [(None, "one two", "en", "a")] * 300 + [(k, "a b c d e", "en", "b") for k in range(100, 500)])
    rows = mixing.mix_sources(hot.repartition(5), block=16).collect()
    assert len(rows) == 1600 and sum(r.doc_id == 7 for r in rows) == 900 and sum(r.doc_id is None for r in rows) == 300
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(hot.repartition(2), block=16).collect()))
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10 and all(r.taken <= 2 * r.size for r in mine)


# op 3


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<|end|>", "<|text|>\\<|turn|>", None, "", "[\\INST]", "\\\\n", "<\\|end|>", "é🙂\n<<SYS>>"]
    rows = [(k, t, r, x) for k, x in enumerate(nasty) for t, r in enumerate(["user", "assistant"])]
    rows += [(50, 0, "assistant", "first"), (50, 1, None, "no role"), (51, 1, "user", "b"), (51, 0, "system", "a"), (51, 2, "assistant", "c"), (52, 0, "user", "x"), (52, 0, "user", "x"), (None, 0, "user", "y"), (53, 0, "a<|text|>b", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    for k, x in enumerate(nasty):
        assert [(p.role, p.text) for p in got[k].parsed] == [("user", x or ""), ("assistant", x or "")] and got[k].loss_text == (x or "") and got[k].valid
        assert sum(s.loss for s in got[k].segments) == 1 and "".join(s.text for s in got[k].segments) == got[k].formatted
    assert (got[50].valid, got[50].first_bad, got[51].valid, got[52].first_bad, got[None].n_turns) == (False, 0, True, 1, 1)
    assert got[53].parsed[0].role == "a<|text|>b"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_query_equals_its_sql(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", None), (2, 0, "assistant", "\\x")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, chat.op3_chat(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = [c for c in chat.op3_chat(spark, str(tmp_path)).columns]
    assert got == sorted(con.execute(f"select {', '.join(names)} from ({chat.ORACLE})").fetchall())


# op 8


def plain_print(text):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def plain_components(ids, linked):
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def test_simhash(spark):
    df = corpus(spark).where("doc_id is not null")
    rows = local(df)
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    linked = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if (x ^ y).bit_count() <= 3]
    want = plain_components([i for i, _ in prints], linked)
    got = simhash.simhash_groups(df).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("n, bits", [(300, 40), (1500, 12), (900, 64)])
def test_large_buckets(n, bits):
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    prints = np.array(list({centre ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(0, 5))) for _ in range(n)}), np.uint64)
    a, b = simhash._near(prints, 3)
    linked = [(i, j) for i, j in combinations(range(len(prints)), 2) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    assert plain_components(range(len(prints)), zip(a.tolist(), b.tolist(), strict=True)) == plain_components(range(len(prints)), linked) and len(a) < len(prints)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1150)] + [(2000, k) for k in range(1500, 1600)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == plain_components(ids, [p for p in links if p[0] != p[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op 4 and op 6


def vectors(spark, n=120, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[40:70] = x[0] + rng.normal(size=(30, dim)) * 0.12
    x[70:75] = x[3]
    x[75] = x[3] * 2
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    rows += [(500, None), (501, [0.0] * dim), (502, [math.nan] + [1.0] * (dim - 1)), (503, [None] + [1.0] * (dim - 1)), (504, [math.inf] * dim), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (7, rows[7][1])]
    return rows, spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])).withColumns({"n": F.lit(1), "dim": F.lit(2), "block": F.lit(3)})


def usable(v, zero):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_links(spark, block):
    rows, df = vectors(spark)
    want, linked = Counter(), []
    for (a, x), (b, y) in combinations(rows, 2):
        if usable(x, False) and usable(y, False) and len(x) == len(y):
            x, y = np.array(x), np.array(y)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                want[a] += 1
                want[b] += 1
                linked.append((a, b))
    parts = plain_components({i for i, _ in rows}, linked)
    got = embedding.near_vectors(df, block=block).collect()
    assert len(got) == len(rows) and sum(want.values()) > 300
    per = Counter(i for i, _ in rows)
    for r in got:
        assert r.component_id == parts[r.vec_id] and r.kept == (r.vec_id == r.component_id)
        assert r.n_links == want[r.vec_id] / per[r.vec_id]
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_top_products(spark):
    rows, df = vectors(spark)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if usable(v, True)]
    want = set()
    for q, x in ints:
        if q % 10 == 0 or q == 506:
            scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ints if i != q and len(y) == len(x)))[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    got = topk.top_products(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 506)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_products(df.limit(0), F.lit(True)).count() == 0


# op 5


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies, many of them, and would like you to accept every single one.</div>
    <article><h1>A &lt;title&gt;</h1><p><b>Short.<br><p>One&nbsp;two
    three</p><form>Search <input></form><blockquote>Said</blockquote><div class="advert">Buy now!</div></article><section id="comments"><p>I liked it very much and will come back to read the rest of it tomorrow.</p></section><footer>&copy; us</footer>"""
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<p>" + "word " * 50_000), (5, "x", "<<<>"), (1, "u", page)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[1] == "A <title>\nShort.\nOne two three\nSaid" and got[2] == got[3] == "" and len(got[4].split()) == 50_000
    assert html_text.extract_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string").limit(0)).count() == 0


ARTICLE = "<h1>A long walk</h1><p>" + "The road begins at the old mill and follows the river for six miles. " * 3 + "</p><p>Yes.</p><p>" + "At the bridge it turns north and climbs through fields of barley. " * 2 + "</p>"


@pytest.mark.parametrize("frame", ['<body class="has-sidebar comments-open">{}</body>', '<html class="no-js cookie-ok"><body>{}</body></html>', '<article class="post share-on">{}</article>', '<div class="content-with-sidebar">{}</div>', '<div id="page-search-off"><div class="post-content">{}</div></div>', '<div class="article-side-left">{}</div>', "<div class=widget>{}</div>", "<select><option>One<div>{}</div>"])
def test_html_names_of_layouts(frame):
    want = "A long walk\n" + " ".join(["The road begins at the old mill and follows the river for six miles."] * 3) + "\nYes.\n" + " ".join(["At the bridge it turns north and climbs through fields of barley."] * 2)
    tree = html_text.train()
    assert html_text.main_text(frame.format(ARTICLE), tree).endswith(want)
    around = '<nav><a href="/">Home</a></nav>' + frame.format(ARTICLE) + '<div class="relatedPosts"><p>Ten more walks that our readers liked best</p></div><footer>All rights reserved by us</footer>'
    assert html_text.main_text(around, tree).endswith(want)


@pytest.mark.parametrize("broken", ["<a ", "<a \"'>", '<p class=">', "<div>x", "</p><b>", "<dt>a<dd>b", "<svg>", "<button>", "<!--", "<a<", "<x ='"])
def test_html_takes_linear_time(broken):
    import time

    began = time.process_time()
    html_text.blocks(broken * (400_000 // len(broken)) + ">")
    assert time.process_time() - began < 10


def test_html_against_a_plain_reading_of_pages(spark):
    """The pages have one article each, which a plain reading finds by its tags."""
    import html as reference
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(reference.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_tree_fits_its_table():
    tree = html_text.train()
    for page in html_text.LABELLED:
        found = html_text.blocks(page)
        assert html_text.classify(tree, html_text.features(found)).tolist() == [b.keep for b in found]


# op 7


def plain_repeats(rows, window):
    first, out = {}, {}
    for i, b in rows:
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], i), i)
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, pack", [(1 << 14, 1 << 20), (2, 3000)])
def test_repeats(spark, hot, pack):
    df = corpus(spark).where("doc_id is not null")
    want = plain_repeats([(r.doc_id, (r.text or "").encode()) for r in local(df)], 50)
    got = {}
    for r in suffix.remove_repeats(df, hot=hot, pack=pack, index=20_000).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[1] for v in want.values() for x in v) > 2000
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_packs_that_a_task_has_send_together():
    """A bucket gets one message of a task's packs, not one of each: else messages grow as packs times buckets."""
    rng, buckets = np.random.default_rng(4), 8
    packs = [rng.integers(97, 107, 3000).astype(np.uint8) for _ in range(12)]
    names, squeeze = ["pack", "ids", "sizes", "data"], zstandard.ZstdCompressor()
    cells = [(k, np.array([k]).tobytes(), np.array([3000]).tobytes(), squeeze.compress(b.tobytes())) for k, b in enumerate(packs)]
    batch = pa.record_batch([pa.array(x) for x in zip(*cells, strict=True)], names)
    rows = [r for out in suffix._seen(50, buckets)(iter([batch])) for r in out.to_pylist()]
    assert len(rows) <= buckets
    got = set()
    for r in rows:
        parts, keys, counts = (suffix._unplaned(zstandard.ZstdDecompressor().decompress(r[c]), t) for c, t in (("parts", "<i8"), ("keys", "<u8"), ("counts", "<u2")))
        parts = parts.reshape(-1, 3)
        assert len(keys) == len(counts) == parts[:, 2].sum()
        got |= set(zip(np.repeat(parts[:, 0], parts[:, 2]).tolist(), keys.tolist(), strict=True))
    want = {(k, x) for k, b in enumerate(packs) for x in suffix.anchors(b, np.array([0, 3000]), 50)[1].tolist()}
    assert got == want


def test_repeats_of_rows_without_a_key(spark):
    """A null key is behind every other, and rows without one are no earlier documents of each other."""
    rng = random.Random(9)
    shared, other = ("".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2))
    rows = [(None, shared + "one", None, None), (4, "head " + shared, None, None), (None, other + "two", None, None), (None, other + "three", None, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove_repeats(documents(spark, rows)).collect())
    assert got == [("4", 0), ("None", 0), ("None", 0), ("None", 90)]


def test_run_index_statistics_of_foreign_patterns():
    rng = np.random.default_rng(6)
    for _ in range(8):
        base = rng.integers(1, 4, 150).astype(np.uint8)
        segments = np.array([np.where(rng.random(80) < 0.03, 4, base[s : s + 80]) for s in rng.integers(0, 70, 10)], np.uint8)
        segments[0, :20], segments[1, 60:] = 0, 0
        patterns = np.concatenate([segments[:3], np.where(rng.random((4, 80)) < 0.05, 5, segments[3:7]).astype(np.uint8)])
        texts, index = [bytes(s) for s in segments], run_index.RunIndex(segments, 50)
        for column, length, _ in index.statistics(patterns):
            for p, n in zip(patterns, length, strict=True):
                rest = bytes(p[column:]).split(b"\0")[0]
                best = max(k for k in range(len(rest) + 1) if any(rest[:k] in t for t in texts))
                assert n == best


# op 1


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.load()


def all_paths(text, v):
    number, _, _, found = lattice.Units(v).of([text])

    def walk(at, end):
        if at == end:
            yield (), 0.0
            return
        for e in range(found.first[at], found.first[at] + found.count[at]):
            for rest, p in walk(at + found.length[e], end):
                yield (int(found.piece[e]), *rest), p + float(found.log_p[e])

    paths = {(): 0.0}
    for s, e in zip(found.start[number], found.end[number], strict=True):
        paths = {(*a, *b): p + q for a, p in paths.items() for b, q in walk(s, e)}
    return paths


def test_samples_follow_the_lattice(vocabulary):
    text = "an end"
    paths = all_paths(text, vocabulary)
    assert abs(sum(map(math.exp, paths.values())) - 1) < 1e-9
    n = 4000
    found = lattice.sample_chunk(list(range(n)), [text] * n, vocabulary, 3, 5)
    first, weighted = Counter(), Counter()
    for samples in found:
        keys = [tuple(s[0].tolist()) for s in samples]
        assert len(set(keys)) == len(keys) == 3 and [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        first[keys[0]] += 1
        for key, s in zip(keys, samples, strict=True):
            assert abs(s[1] - paths[key]) < 1e-9
            weighted[key] += math.exp(s[1] - s[3])
    for key, p in paths.items():
        assert abs(first[key] / n - math.exp(p)) < 0.03 and abs(weighted[key] / n - math.exp(p)) < 0.03


def test_all_segmentations_of_a_short_text(vocabulary):
    paths = all_paths("no", vocabulary)
    samples = lattice.sample_chunk([1], ["no"], vocabulary, 50, 2)[0]
    assert {tuple(s[0].tolist()) for s in samples} == set(paths) and all(s[3] == 0.0 for s in samples)


def test_encoding_round_trip(spark, vocabulary):
    texts = ["", None, " ", "a  b\n\n c\t", "▁ ▁▁x▁", "日本語 🙂 é ​", "x" * 5000, "<s> </s> <0x0A>", "the same", "the same"]
    df = documents(spark, [(k if k < 9 else 8, t, None, None) for k, t in enumerate(texts)])
    rows = lattice.decode_documents(lattice.encode_documents(df)).collect()
    assert all(r.round_trip and r.text == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in rows)
    once = {(r.doc_id, r["sample"], tuple(r.ids)) for r in rows}
    again = {(r.doc_id, r["sample"], tuple(r.ids)) for r in lattice.encode_documents(df.repartition(5)).collect()}
    assert once == again and len([r for r in rows if r.doc_id == 8]) == 6
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    assert all(model.decode(list(r.ids)) == r.text for r in rows if r.doc_id in (3, 5, 8))
    assert lattice.encode_documents(empty(spark)).count() == 0


def test_encoding_query_returns_ids_and_text(spark, tmp_path, vocabulary):
    texts = ["", "a  b", "日本語 🙂", "the same words again"]
    documents(spark, [(k, t, None, None) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lattice.op1_sentencepiece(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}
    assert all(r.n_pieces == len(r.ids) and r.text == texts[r.doc_id] and lattice.decode(np.array(r.ids, np.int64), vocabulary) == r.text for r in rows)


# op 10


def plain_language(text, profiles, size):
    grams = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = [0, *map(ord, word), 0]
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                g = padded[k : k + n]
                if n == 1 and g[0] == 0 or n == 3 and g[1] == 0 or not any(g):
                    continue
                grams[sum(c << 21 * (n - 1 - x) for x, c in enumerate(g))] += 1
    top = sorted(grams, key=lambda g: (-grams[g], g))[:size]
    if not top:
        return "und", 0.0
    away = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(top)) for lang, p in profiles}
    lang = min(sorted(away), key=away.get)
    return lang, 1 - away[lang] / (len(top) * size)


def test_languages(spark):
    df = corpus(spark)
    profiles = langid.learn_profiles(df.where("lang is not null and text is not null"), 50)
    assert [x for x, _ in profiles] == ["de", "en"]
    got = langid.identify(df, profiles, 50, carry=("lang", "text")).collect()
    assert len(got) == df.count()
    for r in got:
        lang, score = plain_language(r.text, profiles, 50)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9
    held = [r for r in got if r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in langid.identify(df, []).collect()} == {"und"} and langid.learn_profiles(empty(spark)) == []


# the pipeline


def test_pipeline(spark, tmp_path):
    df = corpus(spark).drop("pack", "print", "key", "copies", "chance", "size")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, str(tmp_path)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.select(*corpus_pipeline.COLUMNS).columns
        assert kept[-1] <= {r.doc_id for r in before.select("doc_id").collect()}
    assert 75 not in kept[0] and 70 not in kept[1] and docs.where("not round_trip").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[-1]
    none = documents(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def jaccard(a, b, k=5):
    runs = []
    for text in (a, b):
        words = text.lower().split()
        runs.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    return len(runs[0] & runs[1]) / len(runs[0] | runs[1])


def test_pipeline_near_copies_by_five_words(spark):
    """Near copies against brute force over all pairs; what is not similar, or only shares an id, stays."""
    rng, rows = random.Random(5), []
    vocabulary = [f"w{k}" for k in range(4000)]
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        for _ in range(rng.randrange(1, 7)):  # edits of single words
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((2 * k + 1, " ".join(words)))
    rows += [(0, "another text under a taken id"), (None, "a text without an id"), (None, "a second one without an id")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.simhash(spark, docs, "").collect()]
    assert set(kept) <= set(rows) and {x for x in rows if len(x[1]) < 40} <= set(kept)
    gone = [x for x in rows if x not in kept]
    assert all(any(jaccard(x[1], y[1]) >= 0.8 for y in kept) for x in gone)
    pairs = [(x, y) for x, y in combinations(rows, 2) if jaccard(x[1], y[1]) >= 0.8]
    caught = sum(x in gone or y in gone for x, y in pairs)
    assert len(pairs) >= 30 and caught >= 0.9 * len(pairs)


def test_pipeline_language_floor(spark):
    rng = random.Random(3)
    clean = [(k, " ".join(rng.choice(WORDS if k % 2 else DEUTSCH) for _ in range(60)), "en" if k % 2 else "de", "s") for k in range(40)]
    short = [(100, "it was the that", None, "s"), (101, "das ist nicht für sie", None, "s"), (None, "this is for the one with it", None, "s")]
    junk = [(200, "".join(rng.choice("qwzxjkvpy") for _ in range(300)), None, "s"), (201, "это русский текст о хлебе и воде", None, "s"), (202, "zzv qqj xkq " * 20, None, "s")]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, documents(spark, clean + short + junk), "").collect()}
    assert kept == {r[0] for r in clean + short}
    wrong = [(300, " ".join(DEUTSCH[:25]), "en", "s"), (301, " ".join(WORDS[:25]), None, "s")]
    langs = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, documents(spark, clean + wrong), "").collect()}
    assert langs[300] == "de" and langs[301] == "en" and all(langs[r[0]] == r[2] for r in clean)
    unlabelled = documents(spark, [(r[0], r[1], None, r[3]) for r in clean])
    assert corpus_pipeline.language_id(spark, unlabelled, "").count() == len(clean)


def test_pipeline_keeps_rows_without_id(spark):
    rows = [(None, "the first row without an id has words", "en", "a"), (None, "one more row that has none either", "en", "a"), (7, "a row with an id", "en", "a"), (7, "and a different row with it", "en", "a")]
    docs = documents(spark, rows)
    for stage in (corpus_pipeline.simhash, corpus_pipeline.suffix_array):
        assert sorted(r.text for r in stage(spark, docs, "").collect()) == sorted(r[1] for r in rows)
    mixed = [r.text for r in corpus_pipeline.mix(spark, docs, "").collect()]
    assert set(mixed) <= {r[1] for r in rows} and all(mixed.count(t) <= 2 for t in mixed)


def test_embedding_links_beside_a_null_key(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (6, [1.0, 0.01, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.01]), (9, [0.0, 0.0, 1.0])]
    found = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found)
    assert got == [("5", 2, "5"), ("6", 2, "5"), ("9", 0, "9"), ("None", 0, "None"), ("None", 2, "5")]


def test_embedding_links_of_large_and_small_components(spark):
    rows = [(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-200, 2e-200]), (4, [-1e308, 1e308]), (5, [1e-310, -1e-310]), (6, [3.0, 1.0])]
    found = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6)]


def test_top_products_of_large_components_and_null_keys(spark):
    rows = [(0, [1e7, 1e7]), (1, [1e7, -1e7]), (2, [1e300, 1.0]), (None, [1e7, 1e7]), (3, [1e7, 1e7]), (4, [-1e300, 0.0]), (5, [1.0, 2.0])]
    found = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    most, square = (1 << 63) - 1, 2 * (1024 * 10**7) ** 2
    assert square > most
    got = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])]
    assert got == [(2, most), (3, most), (None, most), (5, 3 * 1024 * 1024 * 10**7), (1, 0), (4, -most)]


def test_simhash_of_rows_without_a_key(spark):
    rows = [(None, "alone without a key"), (9, "the same words in both rows"), (None, "the same words in both rows"), (4, "quite another text of words")]
    found = simhash.simhash_groups(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("4", "4"), ("9", "9"), ("None", "9"), ("None", "None")]


LONG = "The road begins at the old mill and follows the river for six miles. " * 4
KEPT = " ".join(LONG.split())


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article><h1>T</h1><p>{LONG}</p><section id="alert-systems"><p>{LONG}</p><p>Yes.</p></section></article>', ["T", KEPT, KEPT, "Yes."]),
        (f'<article><div class="sharing-economy"><p>{LONG}</p><p>Ok.</p></div></article>', [KEPT, "Ok."]),
        (f'<article><p>{LONG}</p><p class="copyright-law">Short law.</p></article>', [KEPT, "Short law."]),
        (f'<article><p>{LONG}</p><p class="notice">Mind the gap.</p><p>{LONG}</p></article>', [KEPT, "Mind the gap.", KEPT]),
        ("<body><p>Hello.</p></body>", ["Hello."]),
        (f"<div>Daily news of the valley since nineteen hundred and two for you</div><h1>Snow</h1><p>{LONG}</p><p>{LONG}</p>", ["Snow", KEPT, KEPT]),
        (f"<article><p>Let <math><mi>x</mi><annotation>x</annotation></math> be {LONG}</p></article>", [f"Let x be {KEPT}"]),
        (f'<article><p>{LONG}</p><div class="site-notice"><p>Closed today.</p></div></article><div class="sidebar-content"><p>{LONG}</p></div><div class="footerLinks">All rights</div>', [KEPT]),
        (f"<article><p>{LONG}</p><ul><li><a>One more road</a><li><a>Mills to see</a><li><a>Rivers by length</a></ul><p>{LONG}</p></article>", [KEPT, KEPT]),
    ],
)
def test_html_keeps_the_text_of_articles_whatever_their_names(page, want):
    assert html_text.main_text(page, html_text.train()).split("\n") == want


def test_html_link_density_and_words_decide():
    def used(node):
        return set() if node.feature < 0 else {html_text.FEATURES[node.feature]} | used(node.low) | used(node.high)

    tree = html_text.train()
    assert html_text.FEATURES[tree.feature] == "density"
    assert {"words", "words before", "words after", "density after"} <= used(tree)
    right, n = html_text.held_out()
    assert n > 200 and right >= 0.9 * n

"""The inverted-repeat engine against plain Python readings of its rules."""

import gzip
import io
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_xdrop
from palindra.cli import STAGES, main, parse
from palindra.functions import packed, sequence
from palindra.functions.running import before
from palindra.operators import extension, overlap, repeats, tsd, xdrop
from palindra.plans import pipeline
from palindra.plans.params import Params
from palindra.sources import fasta, gff, sinks

SCHEMA = "file string, contig_no long, seqid string, seq string"
PAIR = dict(zip("ACGT", "TGCA", strict=True))


def rc(s):
    return "".join(PAIR.get(c, c) for c in reversed(s))


def brute_seeds(s, p):
    """Maximal inverted repeats by comparing every pair of bases."""
    n, found = len(s), set()
    match = lambda i, j: s[i] in PAIR and s[j] == PAIR[s[i]]
    for d in range(2 * n - 1):
        i = max(0, d - n + 1)
        while i < n and 0 <= d - i:
            if not match(i, d - i):
                i += 1
                continue
            z = i
            while z + 1 < n and d - z - 1 >= 0 and match(z + 1, d - z - 1):
                z += 1
            length, b = z - i + 1, d - z
            if p.seed <= length <= p.max_arm and p.min_distance <= b - i <= p.max_distance:
                found.add((i, b, length))
            i = z + 1
    return found


def random_sequence(rng, n, specials=0.02):
    s = "".join(rng.choice("ACGT") for _ in range(n))
    for _ in range(3):
        a, k = rng.randrange(n), rng.randrange(4, 30)
        s = s[:a] + rc(s[max(0, a - 40) : max(0, a - 40) + k]) + s[a:]
    return "".join("N" if rng.random() < specials else c for c in s)[:n]


def test_seeds_equal_brute_force_in_tiles_and_by_join(spark):
    rng, p = random.Random(4), Params(seed=4, max_arm=12, min_distance=0, max_distance=60)
    rows = [("f", k, f"c{k}", random_sequence(rng, 150)) for k in range(12)] + [("f", 12, "p", "ACGT" * 12), ("f", 13, "at", "AT" * 30), ("f", 14, "short", "ACG"), ("f", 15, "empty", "")]
    want = {(k, *x) for _, k, _, s in rows for x in brute_seeds(s, p)}
    contigs = spark.createDataFrame(rows, SCHEMA)
    for found in (repeats.seeds(contigs, p, size=37), repeats.seeds_by_join(contigs, p)):
        got = [tuple(r) for r in found.select("contig_no", "a", "b", "len").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def brute_matches(s, k, low, high, inverted):
    """Pairs (a, b) of k-mers of ``s`` by comparing all of them."""
    at = [i for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    return {(a, b) for a in at for b in at if low <= b - a <= high and s[a : a + k] == (rc(s[b : b + k]) if inverted else s[b : b + k])}


def brute_runs(s, k, low, high, inverted):
    pairs, turn = brute_matches(s, k, low, high, inverted), -1 if inverted else 1
    found = set()
    for a, b in pairs:
        if (a - 1, b - turn) not in pairs:
            n = 0
            while (a + n + 1, b + turn * (n + 1)) in pairs:
                n += 1
            found.add((a, b + min(0, turn * n), k + n))
    return found


@pytest.fixture(scope="module")
def repetitive(spark):
    """Contigs with special bases, tandem repeats longer than several tiles, a short and an empty one."""
    rng = random.Random(12)
    seqs = [random_sequence(rng, 150) for _ in range(6)] + ["ACGT" * 30, "AT" * 60, "A" * 100, "ACG" * 40 + "N" + "ACG" * 20, "ACG", ""]
    lines = "".join(rng.choices("ACGT", k=50))
    seqs += [lines * 3, lines + rc(lines) + lines]
    rows = [("f", k, f"c{k}", s) for k, s in enumerate(seqs)]
    return rows, spark.createDataFrame([*rows, ("f", None, "x", lines * 3), (None, 99, "y", lines * 3), ("f", 98, "z", None)], SCHEMA)


BANDS = [(4, -6, 60, True), (5, 1, 40, False), (4, -20, 15, False), (35, -6, 120, True), (33, 1, 200, False)]


@pytest.mark.parametrize("k, low, high, inverted", BANDS)
def test_maximal_repeats_of_tiles_equal_brute_force(spark, repetitive, k, low, high, inverted):
    rows, contigs = repetitive
    want = {(n, *x) for _, n, _, s in rows for x in brute_runs(s, k, low, high, inverted)}
    for size in (37, repeats.TILE):
        got = [tuple(r) for r in repeats.maximal_repeats(contigs, k, low, high, inverted, size).select("contig_no", "a", "b", "len").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("k, low, high, inverted", BANDS)
def test_match_counts_of_tiles_equal_brute_force(spark, repetitive, k, low, high, inverted):
    rows, contigs = repetitive
    want = {n: (len(x), sum(b - a for a, b in x)) for _, n, _, s in rows if (x := brute_matches(s, k, low, high, inverted))}
    for size in (37, repeats.TILE):
        assert {r.contig_no: (r.n, r.distance) for r in repeats.match_counts(contigs, k, low, high, inverted, size).collect()} == want


def test_kmer_counts_equal_brute_force_and_move_no_rows_of_kmers(spark, repetitive, capsys):
    rows, contigs = repetitive
    more = [s for s in ("ACGTTGCA" * 5, rows[0][3].lower()) if s]
    contigs = contigs.unionByName(spark.createDataFrame([("f", 100 + i, "m", s) for i, s in enumerate(more)], SCHEMA))
    texts = [r.seq.upper() for r in contigs.select("seq").collect() if r.seq]
    for k in (1, 4, 20, 31, 33):
        want = Counter(w for s in texts for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k]))
        got = [tuple(r) for r in repeats.kmer_counts(contigs, k).select("kmer", "n").collect()]
        assert len(got) == len(want) and dict(got) == want
    repeats.kmer_counts(contigs, 20).explain()
    assert "HashAggregate" not in capsys.readouterr().out


def test_seed_extensions_equal_the_seeds(spark, repetitive, capsys):
    _, contigs = repetitive
    p = Params(seed=4, max_arm=12, min_distance=0, max_distance=60)
    want = {(r.contig_no, r.a, r.b, r.len, r.len) for r in repeats.seeds(contigs.where("file IS NOT NULL AND contig_no IS NOT NULL"), p).collect()}
    assert {(r.contig_no, r.a, r.b, r.len, r.n) for r in repeats.seed_extensions(contigs, p, 37).collect()} == want and want
    repeats.seed_extensions(contigs, p).explain()
    assert "Join" not in capsys.readouterr().out


def test_arms_are_the_seeds_extended_where_they_are_found(spark, repetitive, capsys):
    _, contigs = repetitive
    p = Params(seed=4, max_arm=12, min_distance=0, max_distance=60)
    for size in (37, repeats.TILE):
        rows = lambda df: sorted(map(tuple, df.collect()))
        got, want = rows(extension.arms(contigs, p, size)), rows(extension.extend(repeats.seeds(contigs, p, size), contigs, p, size))
        assert got == want and want
    pipeline.stages(contigs, p)["arms"].explain()
    assert "Join" not in capsys.readouterr().out


def test_common_prefix_takes_few_steps(spark):
    """Prefixes of long strings: one comparison a bit of the length, not one a letter."""
    s = "ACGT" * 10_000
    df = spark.createDataFrame([(1, s, s), (2, s, s[:30_001] + "C" + s), (3, s, "C"), (4, s, ""), (5, None, s), (6, s + "N", s + "N"), (7, "NA", "NA")], "k int, a string, b string")
    began = time.time()
    got = {r.k: r.n for r in df.select("k", sequence.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {1: 40_000, 2: 30_001 + (s[30_001] == "C"), 3: 0, 4: 0, 5: None, 6: 40_000, 7: 0}
    assert time.time() - began < 10


def test_repeats_shuffle_no_kmers(spark, repetitive, capsys):
    """A shuffled k-mer takes some hundred times what its base takes."""
    _, contigs = repetitive
    for found in (repeats.maximal_repeats(contigs, 5, 1, 40, False), repeats.maximal_repeats(contigs, 5, 1, 40), repeats.seeds_by_join(contigs, Params())):
        found.explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and "Generate" not in plan


def test_long_seeds_compare_beyond_packed_words(spark):
    arm = "".join(random.Random(1).choices("ACGT", k=40))
    other = arm[:35] + ("A" if arm[35] != "A" else "C") + arm[36:]
    rows = [("f", 0, "a", arm + "C" * 30 + rc(arm)), ("f", 1, "b", arm + "C" * 30 + rc(other))]
    p = Params(seed=36)
    got = [(r.contig_no, r.a, r.len) for r in repeats.seeds(spark.createDataFrame(rows, SCHEMA), p).collect()]
    assert got == [(0, 0, 40)]


def flanks(seed, count):
    """Pairs with replaced, inserted and deleted bases, and special ones."""
    rng = np.random.default_rng(seed)
    us, vs = [], []
    for _ in range(count):
        n = int(rng.integers(1, 70))
        u = rng.integers(0, 4, n)
        v = u.copy()
        for _ in range(int(rng.integers(0, 6))):
            at, kind = int(rng.integers(0, len(v))), rng.random()
            v = np.insert(v, at, rng.integers(0, 4))[:n] if kind < 0.3 else np.append(np.delete(v, at), rng.integers(0, 4)) if kind < 0.6 else np.where(np.arange(n) == at, rng.integers(0, 4), v)
        us.append("".join("ACGTN"[c] if rng.random() > 0.02 else "N" for c in u))
        vs.append("".join("ACGT"[c] for c in v))
    return us, vs


def coded(us, vs):
    width = max(map(len, us))
    code = lambda strings, special: np.array([["ACGT".find(c) if c in "ACGT" else special for c in s] + [special] * (width - len(s)) for s in strings], np.uint8)
    return code(us, 4), code(vs, 5), np.array([len(s) for s in us])


def test_xdrop_batch_equals_plain_loops():
    us, vs = flanks(2, 400)
    i, j = xdrop.batch(*coded(us, vs))
    assert [(a, b) for a, b in zip(i, j, strict=True)] == [plain_xdrop.extend(u, v)[:2] for u, v in zip(us, vs, strict=True)]


#: Scores of a match, a mismatch, an insertion and a deletion, and the drop.
SCORES = [(2, -6, -3, -5, 5), (2, -1, -2, -4, 8), (3, -2, -2, -2, 6), (1, -1, -1, -2, 4), (4, -3, -7, -2, 12), (2, -2, -3, -3, 40)]


@pytest.mark.parametrize("match,mismatch,insertion,deletion,drop", SCORES)
def test_xdrop_batch_equals_plain_loops_under_any_scores(match, mismatch, insertion, deletion, drop):
    us, vs = flanks(match - 10 * mismatch, 350)
    p = Params(match=match, mismatch=mismatch, insertion=insertion, deletion=deletion, xdrop=drop)
    i, j = xdrop.batch(*coded(us, vs), *p.scoring())
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [plain_xdrop.extend(u, v, *p.scoring())[:2] for u, v in zip(us, vs, strict=True)]


def score_of(u, v, p):
    """The score of aligning all of ``u`` with all of ``v``, by the full table; special bases equal nothing."""
    row = [j * p.insertion for j in range(len(v) + 1)]
    for a in u:
        new = [row[0] + p.deletion]
        for j, b in enumerate(v):
            new.append(max(row[j] + (p.match if a == b and a in "ACGT" else p.mismatch), row[j + 1] + p.deletion, new[j] + p.insertion))
        row = new
    return row[-1]


@pytest.mark.parametrize("match,mismatch,insertion,deletion,drop", SCORES)
def test_xdrop_ends_score_what_the_full_table_says(match, mismatch, insertion, deletion, drop):
    """The best end has the score of an alignment up to there, and with a wide drop none scores higher."""
    p = Params(match=match, mismatch=mismatch, insertion=insertion, deletion=deletion, xdrop=400)
    us, vs = flanks(7, 25)
    drop, half, unit, edges = p.scoring()
    scale = 1 + match % 2
    i, j = xdrop.batch(*coded(us, vs), drop, half, unit, edges)
    for u, v, a, b in zip(us, vs, i.tolist(), j.tolist(), strict=True):
        best = plain_xdrop.extend(u, v, drop, half, unit, edges)[2]
        assert best == scale * score_of(u[:a], v[:b], p)
        assert best >= scale * max(score_of(u[:x], v[:x], p) for x in range(len(u) + 1))


def test_scores_that_gain_by_differing_are_refused():
    for bad in ({"mismatch": 2}, {"insertion": 1}, {"deletion": 3}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert Params().scoring() == (5, 1, 4, (1, 1, 1))
    assert Params(mismatch=-6).scoring() == (5, 1, 4, (2, 1, 1))
    assert Params(match=1).scoring() == (10, 1, 1, (6, 7, 7))


def test_xdrop_bridges_one_special_base():
    assert plain_xdrop.extend("ACGTACGTAC" + "N" + "ACGTTGCAAC", "ACGTACGTAC" + "N" + "ACGTTGCAAC") == (21, 21, 38)


def plain_element(s, p):
    """Candidates of one contig by the rules, one at a time: (a, b, len, lts, lte, rts, rte, tsd, skip, sim)."""
    n, out = len(s), []
    base = lambda k: s[k] if 0 <= k < n else "N"
    for a, b, length in sorted(brute_seeds(s, p)):
        room = p.max_arm - length
        li = lj = ri = rj = 0
        if room > 0 and a > 0:
            size = min(room, a, n - (b + length) + 1)
            u, v = "".join(base(a - 1 - k) for k in range(size)), "".join(PAIR.get(base(b + length + k), "x") for k in range(size))
            li, lj, _ = plain_xdrop.extend(u, v, *p.scoring())
        if room > 0 and n - (a + length) > 0 and b - 1 > 0:
            size = min(room, n - (a + length), b - 1)
            u, v = "".join(base(a + length + k) for k in range(size)), "".join(PAIR.get(base(b - 1 - k), "x") for k in range(size))
            ri, rj, _ = plain_xdrop.extend(u, v, *p.scoring())
        if not p.min_arm <= length - 2 + ri + lj <= p.max_arm:
            continue
        lts, lte, rts, rte = a - li, a + length - 1 + ri, b - rj, b + length - 1 + lj
        l0, r0 = max(0, lts - p.vicinity), max(rts, rte - p.vicinity)
        left, right = s[l0 : min(lte, lts + p.vicinity) + 1], s[r0 : min(n - 1, rte + p.vicinity) + 1]
        found = []
        for x in range(len(left)):
            for y in range(len(right)):
                same = lambda i, j: left[i] == right[j] != "N"
                if x and y and same(x - 1, y - 1):
                    continue
                m = 0
                while x + m < len(left) and y + m < len(right) and same(x + m, y + m):
                    m += 1
                if p.min_tsd <= m < p.max_tsd:
                    found.append((abs(lts - (l0 + x + m - 1)) + abs(rte - (r0 + y)), r0 + y, left[x:].replace("N", "[") + "~", l0 + x, m))
        rte0, size = rte, 0
        if found:
            _, q, _, x, size = min(found)
            lts, rte = x + size, q - 1
        skip = size == 0 or rte <= rts or lte <= lts or rte0 <= rts
        sim = None
        if not skip:
            u, v = s[lts:lte], rc(s[rts + 1 : rte0 + 1])
            row = list(range(len(v) + 1))
            for i, c in enumerate(u, 1):
                row, last = [i], row
                for j, d in enumerate(v, 1):
                    row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            sim = 100.0 * (1.0 - row[-1] / max(len(u), len(v)))
            skip = sim < p.similar
        out.append((a, b, length, lts, lte, rts, rte, size, skip, sim))
    return out


def plain_overlaps(rows):
    """The best row of each cluster of one file's single contig, by a sweep."""
    rows = sorted(rows, key=lambda r: (r[3], r[5], r[0], r[1], r[2]))
    out, best, start, end = [], None, None, None
    for k, r in enumerate(rows):
        if k == 0:
            start, end, best = r[3], r[6], None if r[8] else r
            continue
        if r[8]:
            continue
        if start <= r[6] and end >= r[3]:
            end = max(end, r[6])
            best = r if best is None or best[9] < r[9] else best
        else:
            if best:
                out.append(best)
            start, end, best = r[3], r[6], r
    return out + ([best] if best else [])


def test_whole_search_equals_a_plain_reading(spark):
    rng, rows, want = random.Random(8), [], []
    p = Params(seed=8, max_arm=40, max_distance=200, min_distance=4, similar=70.0)
    for k in range(14):
        arm, site = "".join(rng.choice("ACGT") for _ in range(25)), "".join(rng.choice("ACGT") for _ in range(5))
        other = arm[:12] + rng.choice("ACGT") + arm[13:]
        s = random_sequence(rng, 60, 0.01) + site + arm + random_sequence(rng, 50, 0.01) + rc(other) + site + random_sequence(rng, 40, 0.01)
        s = s[45:] if k % 3 == 0 else s
        rows.append((f"file{k}", 0, "c", s))
        want += [(f"file{k}", *r[3:8], round(r[9], 9)) for r in plain_overlaps(plain_element(s, p))]
    contigs = spark.createDataFrame(rows, SCHEMA)
    stages = pipeline.stages(contigs, p, size=64)
    got = [(r.file, r.lts, r.lte, r.rts, r.rte, r.tsd, round(r.sim, 9)) for r in stages["best"].collect()]
    assert sorted(got) == sorted(want) and len(got) > 10
    passed = {(r.file, r.a, r.b, r.len, r.lts, r.rte, r.tsd, r.skip) for r in stages["compared"].collect()}
    assert passed == {(f, r[0], r[1], r[2], r[3], r[6], r[7], r[8]) for f, _, _, s in rows for r in plain_element(s, p)}


def test_skipped_first_row_bridges_two_clusters(spark):
    rows = [("f", 0, 0, 50, 0, 9, 9, 5, True, 1.0), ("f", 0, 2, 20, 3, 9, 9, 5, False, 90.0), ("f", 0, 40, 60, 41, 9, 9, 5, False, 95.0), ("g", 0, 2, 20, 3, 9, 9, 5, False, 90.0), ("g", 0, 40, 60, 41, 9, 9, 5, False, 90.0)]
    df = spark.createDataFrame(rows, "file string, contig_no long, lts long, rte long, rts long, a long, b long, len long, skip boolean, sim double")
    got = sorted((r.file, r.lts) for r in overlap.best_per_cluster(overlap.clusters(df, bucket=16)).collect())
    assert got == [("f", 40), ("g", 2), ("g", 40)]


def test_first_wins_on_equal_similarity(spark):
    rows = [("f", 0, 5, 30, 6, 1, 9, 5, False, 90.0), ("f", 0, 7, 31, 8, 2, 9, 5, False, 90.0)]
    df = spark.createDataFrame(rows, "file string, contig_no long, lts long, rte long, rts long, a long, b long, len long, skip boolean, sim double")
    assert [r.lts for r in overlap.best_per_cluster(overlap.clusters(df)).collect()] == [5]


def test_declarative_duplications_equal_batched(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 28))), "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 28)))) for k in range(60)]
    p = Params()
    df = spark.createDataFrame(rows, "k int, left string, right string").withColumns({c: F.lit(v).cast("long") for c, v in (("left_start", 10), ("right_start", 90), ("lts", 20), ("rte", 100))})
    got = {r.k: (r.p, r.q, r.m) for r in tsd.best_of_candidates(tsd.candidates(df, 2, 11), ["k"], p).collect()}
    fixed = [np.full(len(rows), v) for v in (10, 90, 20, 100)]
    batch = tsd.best_batch([r[1] for r in rows], [r[2] for r in rows], *fixed, 2, 11)
    assert got == {k: (a, b, m) for k, a, b, m in zip(range(60), *(x.tolist() for x in batch), strict=True) if m}


def test_no_duplication_is_sought_at_one(spark):
    arm = "".join(random.Random(5).choices("ACGT", k=30))
    contigs = spark.createDataFrame([("f", 0, "c", arm + "ACCA" * 5 + rc(arm))], SCHEMA)
    row = pipeline.find_elements(contigs, Params(min_tsd=1)).collect()[0]
    assert (row.tsd1_start, row.tsd1_stop) == (row.full_start, row.full_start - 1) and row.sim == 100.0


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one x\r\nacgt\r\nNN\r\n>one\tdup\nAC\n\n>;;3\n")
    (tmp_path / "b.fastq").write_text("@r1 d\nacgtn\n+\nIIIII\n@r2\nAC\n+r2\nII\n")
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "m.txt").write_text(f"  {tmp_path}/a.fa \n\n{tmp_path}/b.fastq\n{tmp_path}/empty.fa\n")
    paths = fasta.read_manifest(spark, str(tmp_path / "m.txt"))
    got = sorted((r.file[-4:], r.contig_no, r.seqid, r.seq) for r in fasta.read_sequences(spark, paths).collect())
    assert got == [("a.fa", 0, "one", "ACGTNN"), ("a.fa", 1, "one", "AC"), ("a.fa", 2, ";;3", ""), ("astq", 0, "r1", "ACGTN"), ("astq", 1, "r2", "AC")]


def test_gff_and_tsv(spark, tmp_path):
    six = [f"s\tx\ty\t{k}\t{k + 5}\t.\t+\t.\ttir_similarity=91.5" for k in range(1, 7)]
    (tmp_path / "x.gff").write_text("\n".join(["##gff", *six, "###", *six[:4], "# end", "short\tline"]) + "\n")
    rows = sorted(gff.read_gff(spark, str(tmp_path / "x.gff")).collect(), key=lambda r: r.record)
    assert [(r.full_start, r.tsd2_stop, r.sim, r.n_features, r.bad) for r in rows] == [(1, 11, 91.5, 6, False), (None, None, None, 4, True)]
    elements = spark.createDataFrame([("f/a.fa", "s2", *range(12), 90.625), ("f/a.fa", "s1", *range(12), 100.0)], "file string, seqid string, " + ", ".join(f"{c} long" for c in pipeline.COORDINATES) + ", sim double")
    text = sinks.to_tsv(elements).splitlines()
    assert text[0].split("\t") == sinks.HEADER and text[1].startswith("s1") and text[2].endswith("\t90.62")
    sinks.write_fragments(elements, str(tmp_path / "out"), ["f/a.fa", "g/a.fa", "f/b.c%=.fa"], suffix=".x.tsv")
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names[0].startswith("a-") and names[1:] == ["a.x.tsv", "b.c%=.x.tsv"]
    assert (tmp_path / "out/a.x.tsv").read_text() == sinks.to_tsv(elements) and (tmp_path / f"out/{names[0]}").read_text() == "\t".join(sinks.HEADER) + "\n"


@pytest.fixture(scope="module")
def fragments(spark, tmp_path_factory):
    """Two files with an element each, one of them gzipped, and one without any."""
    path, rng = tmp_path_factory.mktemp("fragments"), random.Random(12)
    draws = ["".join(rng.choices("ACGT", k=30)) for _ in range(3)]
    for k, arm in enumerate((draws[0], draws[2])):  # the second one's chance duplications leave it no arms
        text = f">c{k} words\nGGTAC{arm}{'ACCA' * 6}{rc(arm)}GGTACC\n"
        (path / f"{k}.fa.gz").write_bytes(gzip.compress(text.encode())) if k else (path / f"{k}.fa").write_text(text)
    (path / "2.fa").write_text(">c2\nACGT\n")
    return path


def test_command_line(spark, fragments, tmp_path, capsys, monkeypatch):
    paths = [str(fragments / n) for n in ("0.fa", "1.fa.gz", "2.fa")]
    want = {n: sinks.to_tsv(pipeline.find_elements(fasta.read_sequences(spark, n))) for n in paths}
    assert [t.count("\n") for t in want.values()] == [2, 2, 1]
    assert main([paths[1]]) == 0
    out, err = capsys.readouterr()
    assert out == want[paths[1]] and err.endswith("1 elements\n")
    monkeypatch.setattr("sys.stdin", io.StringIO("".join(f"  {p} \n\n" for p in paths)))
    assert main(["--batch", str(tmp_path / "out"), "--suffix", ".tsv"]) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"0.tsv": want[paths[0]], "1.fa.tsv": want[paths[1]], "2.tsv": want[paths[2]]}
    for stage, (_, _, columns) in STAGES.items():
        capsys.readouterr()
        assert main(["--stage", stage, paths[0]]) == 0
        out, err = capsys.readouterr()
        lines = out.splitlines()
        assert lines[0].split("\t") == columns and len(lines) > 1 and err.endswith(f"{len(lines) - 1} {stage}\n")
        if stage == "seeds":
            assert {tuple(map(int, x.split("\t")[1:])) for x in lines[1:]} == brute_seeds("GGTAC" + (fragments / "0.fa").read_text().split("GGTAC", 1)[1].split("\n")[0], Params())
    assert main([]) == 2


def test_tandem_repeats_take_no_memory():
    """Nearly every pair of k-mers matches; only what begins a run is held."""
    code = packed.codes("AT" * 4096)
    tracemalloc.start()
    a, _, _ = repeats.tile_seeds(code, np.array([0, len(code)]), np.array([0]), np.array([len(code)]), Params())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 0 and peak < 200e6


def test_multiset_diff(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in gff.multiset_diff(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_running_folds(spark):
    rng = random.Random(1)
    rows = [("k", x, rng.randrange(50)) for x in rng.sample(range(1000), 80)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    for how, fold in (("sum", sum), ("max", lambda v: max(v, default=None))):
        got = {r.x: r.out for r in before(df, "v", "out", ["g"], ["x"], F.floor(F.col("x") / 100), how).collect()}
        assert got == {x: fold([v for _, y, v in rows if y < x]) for _, x, _ in rows}


def test_scalar_functions(spark):
    row = spark.createDataFrame([("acgNx", "ACGTT", "ACGAT")], "a string, b string, c string").select(
        sequence.reverse_complement(F.col("b")), sequence.count_bases(F.col("a")), sequence.base_at(F.col("a"), F.lit(4)), sequence.common_prefix(F.col("b"), F.col("c")), sequence.base_code(F.lit("g")), sequence.base_code(F.lit("N")), sequence.similarity(F.col("b"), F.col("c"))
    ).first()
    assert tuple(row) == ("AACGT", 3, "N", 3, 2, None, 80.0)


def test_contigs_of_a_table_are_numbered_by_id(spark):
    ids = ["b", "a", "chromosome10", "chromosome1", "", None, "a"]
    df = spark.createDataFrame([(i, f"{'ACGT' * (k + 1)}", f"f{k % 2}") for k, i in enumerate(ids)], "name string, letters string, src string")
    got = [tuple(r) for r in fasta.contigs_of(df, "letters", "name").orderBy("contig_no").collect()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or "", "ACGT" * (k + 1)))
    assert got == [("table", n, ids[k], "ACGT" * (k + 1)) for n, k in enumerate(order)]
    by = sorted((r.file, r.contig_no) for r in fasta.contigs_of(df, "letters", "name", "src").collect())
    assert by == [(f, n) for f in ("f0", "f1") for n in range(4 if f == "f0" else 3)]


def test_the_search_leaves_no_table_in_the_cache(spark):
    spark.catalog.clearCache()
    contigs = spark.createDataFrame([("f", 0, "s", "ACGT" * 40)], SCHEMA)
    pipeline.find_elements(contigs).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_options():
    with pytest.raises(ValueError):
        Params(match=-4)
    assert parse(["-mis", "-6", "-mat", "3", "x.fa"])[0].scoring() == (10, 3, 9, (2, 1, 1))
    params, batch, threads, paths, stage, suffix = parse(["-seed", "15", "x.fa", "--batch", "out", "--threads", "3", "-similar", "70"])
    assert (params.seed, params.similar, batch, threads, paths, stage, suffix) == (15, 70.0, "out", 3, ["x.fa"], None, ".elements.tsv")
    for wrong in (["-seed"], ["-seed", "x"], ["--stage", "none"]):
        with pytest.raises(SystemExit):
            parse(wrong)


def test_empty_input(spark):
    assert pipeline.find_elements(spark.createDataFrame([], SCHEMA)).count() == 0
    assert extension.length_gate(extension.extend(repeats.seeds(spark.createDataFrame([], SCHEMA), Params()), spark.createDataFrame([], SCHEMA), Params()), Params()).count() == 0


def test_packed_sequences_come_back_and_are_small():
    rng = random.Random(12)
    for n in (0, 1, 3, 4, 5, 8, 9, 1001):
        for letters in ("ACGT", "ACGTN", "N"):
            s = "".join(rng.choice(letters) for _ in range(n))
            code = packed.codes(s)
            held = packed.pack(code)
            assert packed.size(held) == n and packed.unpack(held).tolist() == code.tolist() == [("ACGT".find(c)) % 5 for c in s]
            assert len(held) <= 7 + n / 4 + (n / 8 if "N" in letters else 0)


def test_tiles_hold_two_bits_a_base(spark):
    rng = random.Random(13)
    contigs = spark.createDataFrame([("f", 0, "s", "".join(rng.choice("ACGT") for _ in range(9000)))], SCHEMA)
    for r in repeats.tiles(contigs, Params(), 4096).collect():
        assert len(r.seq) < 0.26 * packed.size(r.seq) + 8

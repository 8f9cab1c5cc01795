"""Suffix order and common prefixes against a sort of suffixes."""

import random

import numpy as np
import pytest

from palindra.operators import repeats, suffixes
from palindra.plans.params import Params

SCHEMA = "file string, contig_no long, seqid string, seq string"


def plain(rows):
    """(file, contig, pos, rank, lcp) by sorting; a special base, and the end, is its place behind all letters."""
    out = []
    for file, number, _, seq in rows:
        letters = [("ACGT".index(c), 0) if c in "ACGT" else (4, k) for k, c in enumerate(seq.upper())] + [(4, len(seq))]
        order = sorted(range(len(seq)), key=lambda k: letters[k:])
        for rank, k in enumerate(order):
            lcp, j = 0, order[rank - 1]
            while rank and letters[k + lcp] == letters[j + lcp]:
                lcp += 1
            out.append((file, number, k, rank, lcp))
    return sorted(out)


@pytest.mark.parametrize("local", [0, 170, suffixes.LOCAL])
def test_the_order_equals_a_sort_of_suffixes(spark, local):
    """By all tasks, in arrays, and some contigs this way and some that."""
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    line = draw(130)
    seqs = ["", "A", "N", "ACGT" * 40, "A" * 90, "A" * 60 + "N" + "A" * 60, draw(200) + line + draw(9) + line + line, "NN" + draw(30) + "n" + line[:40] + "R" + line[:40], (draw(37) * 12)[:400], "acgtacgt" + line]
    rows = [(f"f{k % 2}", k // 2, "s", s) for k, s in enumerate(seqs)]
    found = suffixes.suffix_order(spark.createDataFrame(rows, SCHEMA), local=local)
    assert found.columns == ["file", "contig_no", "pos", "rank", "lcp"]
    assert sorted(map(tuple, found.collect())) == plain(rows)
    assert max(r[4] for r in plain(rows)) > 260


def test_pieces_of_a_long_contig(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_TOGETHER", 50)
    rng = random.Random(10)
    rows = [("f", 0, "s", "".join(rng.choice("ACGTN" if k % 90 < 2 else "ACGT") for k in range(333)))]
    for local in (0, suffixes.LOCAL):
        assert sorted(map(tuple, suffixes.suffix_order(spark.createDataFrame(rows, SCHEMA), local=local).collect())) == plain(rows)
    assert suffixes.suffix_order(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def pairs(s, least, low, high):
    """Maximal direct repeats by comparing every two places."""
    same, out = lambda i, j: s[i] == s[j] != "N", []
    for i in range(len(s)):
        for j in range(i + low, min(len(s), i + high + 1)):
            if i == 0 or not same(i - 1, j - 1):
                n = 0
                while j + n < len(s) and same(i + n, j + n):
                    n += 1
                if n >= least:
                    out.append((i, j, n))
    return out


def texts(rng):
    draw = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    line, back = draw(60), {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    turned = "".join(back[c] for c in reversed(line))
    return [draw(150, "AC"), "A" * 70, "ACACACAC" * 8, draw(40) + line + draw(20) + turned + "N" + line, draw(90, "ACGTN"), "", "ACGT" + turned + line + turned, "N" * 9]


def test_a_null_or_empty_sequence_has_no_suffixes(spark):
    rows = [("f", 0, "s", None), ("f", 1, "s", ""), ("f", 2, "s", "NN"), (None, 3, "s", "ACA")]
    got = {tuple(r) for r in suffixes.suffix_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("f", 2, 0, 0, 0), ("f", 2, 1, 1, 0), (None, 3, 0, 0, 0), (None, 3, 2, 1, 1), (None, 3, 1, 2, 0)}


def test_many_contigs_are_ordered_together():
    rng = random.Random(12)
    seqs = ["".join(rng.choice("AC" if k % 2 else "ACGTN") for _ in range(rng.randint(1, 120))) for k in range(60)] + ["A" * 700, "AC" * 300]
    code = suffixes.codes("N".join(seqs) + "N")
    edge = np.concatenate([[0], np.cumsum([len(s) + 1 for s in seqs])])
    order, lcp = suffixes.order_together(code, edge)
    of = np.searchsorted(edge, order, side="right") - 1
    got = [("f", int(k), int(o - edge[k]), int(i - (edge[k] - k)), int(n)) for i, (k, o, n) in enumerate(zip(of, order, lcp, strict=True))]
    assert sorted(got) == plain([("f", k, "", s) for k, s in enumerate(seqs)])


@pytest.mark.parametrize("local", [0, suffixes.LOCAL])
def test_intervals_give_all_maximal_pairs(spark, local):
    """Also in tandem repeats, across special bases and for very short lengths."""
    seqs = texts(random.Random(3))
    contigs = spark.createDataFrame([("f", k, "s", s) for k, s in enumerate(seqs)], SCHEMA)
    for least, low, high in ((3, 1, 400), (12, 5, 80)):
        got = sorted(tuple(r)[1:] for r in suffixes.repeats_of_intervals(contigs, least, low, high, inverted=False, local=local).collect())
        assert got == sorted((k, *x) for k, s in enumerate(seqs) for x in pairs(s, least, low, high)) and got
    with pytest.raises(ValueError):
        suffixes.repeats_of_intervals(contigs, 0, 1, 9)


@pytest.mark.parametrize("p", [Params(seed=5, min_distance=1, max_distance=90, max_arm=30), Params(seed=9, min_distance=10, max_distance=300, max_arm=80)])
@pytest.mark.parametrize("local", [170, suffixes.LOCAL])
def test_seeds_of_intervals_equal_those_of_tiles(spark, p, local):
    contigs = spark.createDataFrame([(f"f{k % 2}", k, "s", s) for k, s in enumerate(texts(random.Random(4)))], SCHEMA)
    want = sorted(tuple(r) for r in repeats.seeds(contigs, p).select("file", "contig_no", "a", "b", "len").collect())
    assert sorted(map(tuple, suffixes.seeds_of_intervals(contigs, p, local=local).collect())) == want and want

"""op1: what a draw gives does not hang on the order in which it visits the units of the texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from palindra.llm import lattice

TEXTS = ["the same words, the same words again\n\nand the rest", "", " ", "▁ a  b 日本語 🙂 é", "x" * 300, "the rest of the same words", None]

#: (doc_id, n_pieces, ids_crc32) of the samples of TEXTS.
EXPECTED = [
    (0, 18, 175503025),
    (0, 17, 2418228470),
    (0, 15, 3493821408),
    (1, 0, 0),
    (2, 1, 842209989),
    (2, 2, 4041854337),
    (3, 14, 847456166),
    (3, 14, 3784911618),
    (3, 15, 2262279115),
    (4, 105, 1562576193),
    (4, 107, 3185322932),
    (4, 106, 1035664358),
    (5, 7, 3128944374),
    (5, 10, 3749896620),
    (5, 10, 1975634003),
    (6, 0, 0),
]


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.load()


def test_a_draw_may_visit_units_in_any_order(vocabulary):
    unit, rows, counts, l = lattice.Units(vocabulary).of(TEXTS[:4])
    size = (l.end - l.start)[unit]
    walk = lattice.Walk(l, unit, np.repeat(np.arange(len(rows), dtype=np.uint64), counts), np.cumsum(size) - size)
    n = len(unit)
    assert sorted(l.by_unit.tolist()) == list(range(n)) and (np.diff(unit[l.by_unit]) >= 0).all()
    in_text = walk.draw(np.arange(n), l.start[unit], 2)
    assert (np.diff(in_text[0]) >= 0).all()
    for order in (l.by_unit, np.arange(n)[::-1]):
        for a, b in zip(walk.draw(order, l.start[unit[order]], 2), in_text, strict=True):
            assert (a == b).all()
    # places left free before an instance move what comes behind, and nothing else
    lead = np.zeros(n, np.int64)
    lead[[0, 3]] = 2, 5
    who, edge, begin = walk.draw(l.by_unit, l.start[unit[l.by_unit]], 2, lead)
    free = np.concatenate([begin[0] + np.arange(2), begin[3] + np.arange(5)])
    assert (np.delete(edge, free) == in_text[1]).all() and (np.delete(who, free) == in_text[0]).all()


def test_samples_are_those_of_each_text_alone(vocabulary):
    keys = list(range(len(TEXTS)))
    texts = [t or "" for t in TEXTS]
    together = lattice.sample_chunk(keys, texts, vocabulary, 4, 11)
    for k, t, found in zip(keys, texts, together, strict=True):
        alone = lattice.sample_chunk([k], [t], vocabulary, 4, 11)[0]
        assert [(s[0].tolist(), *s[1:]) for s in found] == [(s[0].tolist(), *s[1:]) for s in alone]


def test_samples_stay_as_they_were(vocabulary):
    """Checksums of ids taken before draws went by unit, with units that share a hash too."""
    batch = pa.record_batch([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], ["doc_id", "text"])
    before = lattice._BASE
    try:
        for lattice._BASE in (before, np.uint64(0)):
            found = [r for b in lattice._encode(vocabulary, 3, 11)(iter([batch])) for r in b.to_pylist()]
            assert [(r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in found] == EXPECTED
            assert all(r["text"] == (TEXTS[r["doc_id"]] or "") and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in found)
    finally:
        lattice._BASE = before


def test_spelling_is_that_of_bytes(vocabulary):
    ids = np.random.default_rng(1).integers(0, len(vocabulary.spelled_at) - 1, 5000).astype(np.int32)
    data, at = lattice.Spelling(vocabulary)(ids)
    assert data == lattice.decode_bytes(ids, vocabulary).tobytes()
    assert (np.diff(at) == np.diff(vocabulary.spelled_at)[ids]).all()
    assert lattice.Spelling(vocabulary)(ids[:0])[0] == b""

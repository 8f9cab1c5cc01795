"""Arms: seeds extended outward and inward, with the strings that later stages compare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.functions.packed import size as packed_size
from palindra.operators.repeats import CONTIG, TILE, joined, tile_seeds, tiles, together
from palindra.operators.xdrop import batch as extend_batch
from palindra.plans.params import Params

_RC = np.array([3, 2, 1, 0, 4], np.uint8)
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)
#: Seeds that are extended together, of tiles of about so many bases.
_BATCH, _BASES = 2048, 1 << 22


def _flanks(code: np.ndarray, at: np.ndarray, step: int, size: np.ndarray, inside: tuple[np.ndarray, np.ndarray], special: int, complement: bool) -> np.ndarray:
    """Rows of bases from ``at`` on in steps of ``step``, special from ``size`` on and outside a row's tile."""
    span = np.arange(int(size.max()) if len(size) else 0)
    place = at[:, None] + step * span
    ok = (span < size[:, None]) & (place >= inside[0][:, None]) & (place < inside[1][:, None])
    base = code[np.clip(place, 0, len(code) - 1)]
    base = np.where(ok & (base < 4), _RC[base] if complement else base, special)
    return base.astype(np.uint8)


def extend_seeds(code: np.ndarray, inside: tuple[np.ndarray, np.ndarray], shift: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """(li, lj, ri, rj) of seeds in contig coordinates: outward and inward reaches of both arms.

    Of each seed: where its tile stands in ``code`` (``inside``), what ``shift`` takes a contig's
    position there, and the contig's length ``n``. The outward flank of the right arm may run one
    base past the contig, onto a special one; its inward flank stops short of the contig's first base.
    """
    room = p.max_arm - length
    out_size = np.where((room > 0) & (a > 0), np.minimum(np.minimum(room, a), n - (b + length) + 1), 0)
    in_size = np.where((room > 0) & (n - (a + length) > 0) & (b - 1 > 0), np.minimum(np.minimum(room, n - (a + length)), b - 1), 0)
    flank = lambda at, step, size, special, complement: _flanks(code, at + shift, step, size, inside, special, complement)
    li, lj = extend_batch(flank(a - 1, -1, out_size, 4, False), flank(b + length, 1, out_size, 5, True), out_size, *p.scoring())
    ri, rj = extend_batch(flank(a + length, 1, in_size, 4, False), flank(b - 1, -1, in_size, 5, True), in_size, *p.scoring())
    return li, lj, ri, rj


def _extending(params: Params):
    """From tiles (file, contig_no, tile, n, start, seq) and the seeds of each, what ``extend`` gives."""

    def work(tiles_: list[tuple], seeds_: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, edge = joined([t[5] for t in tiles_])
        letters = _LETTERS[code].tobytes().decode()
        of_tile = np.repeat(np.arange(len(tiles_)), [len(x) for x in seeds_])
        table = np.concatenate(seeds_)
        n, start = (np.array([t[c] for t in tiles_], np.int64) for c in (3, 4))
        for s in range(0, len(table), _BATCH):
            a, b, length = table[s : s + _BATCH].T
            tile = of_tile[s : s + _BATCH]
            shift = edge[tile] - start[tile]
            li, lj, ri, rj = extend_seeds(code, (edge[tile], edge[tile + 1]), shift, n[tile], a, b, length, params)
            lts, lte, rts, rte = a - li, a + length - 1 + ri, b - rj, b + length - 1 + lj
            left, right, arm = [], [], []
            for x, y, z, w, d, m in zip(lts.tolist(), lte.tolist(), rts.tolist(), rte.tolist(), shift.tolist(), n[tile].tolist(), strict=True):
                left.append(letters[d + max(0, x - params.vicinity) : d + y + 1])
                right.append(letters[d + max(z, w - params.vicinity) : d + min(m - 1, w + params.vicinity) + 1])
                arm.append(letters[d + z + 1 : d + w + 1].translate(_COMPLEMENT)[::-1])
            fixed = [pa.array([tiles_[t][c] for t in tile.tolist()], kind) for c, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            numbers = [pa.array(v) for v in (a, b, length, li, lj, ri, rj, n[tile], lts, lte, rts, rte, length - 2 + ri + lj)]
            yield pa.record_batch([*fixed, *numbers, pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(arm, pa.string())], _NAMES)

    return work


def extend(seeds: DataFrame, contigs: DataFrame, params: Params, size: int = TILE, stretches: DataFrame | None = None) -> DataFrame:
    """Each seed with its reaches, arms and the strings around them; no row is dropped.

    Adds li, lj (outward: left, right arm), ri, rj (inward), n (contig length), the arms' ends
    lts, lte, rts, rte (inclusive), arm_length (what the length gate tests), left_text (from
    ``vicinity`` bases before the left arm to its end), right_text (around the right arm's outer
    end, ``vicinity`` either way but not before the arm) and right_arm (the right arm's reverse
    complement without its last base). Seeds meet their tile, not their contig.
    """

    work = _extending(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles_, seeds_, bases, many = [], [], 0, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "contig_no", "tile", "n", "start", "seq", "seeds")]
            for k in range(batch.num_rows):
                *tile, found = (c[k].as_py() for c in columns)
                tiles_.append(tile)
                seeds_.append(np.array([(s["a"], s["b"], s["len"]) for s in found], np.int64).reshape(-1, 3))
                bases, many = bases + packed_size(tile[5]), many + len(found)
                if bases >= _BASES or many >= _BATCH:
                    yield from work(tiles_, seeds_)
                    tiles_, seeds_, bases, many = [], [], 0, 0
        if tiles_:
            yield from work(tiles_, seeds_)

    stretches = tiles(contigs, params, size) if stretches is None else stretches
    grouped = seeds.groupBy(*CONTIG, "tile").agg(F.collect_list(F.struct("a", "b", "len")).alias("seeds"))
    return stretches.join(grouped, [*CONTIG, "tile"]).mapInArrow(run, _schema())


def arms(contigs: DataFrame, params: Params, size: int = TILE, stretches: DataFrame | None = None) -> DataFrame:
    """``extend`` of all ``seeds``: each tile is worked on where its seeds are found, so neither is dealt or sorted again."""
    work = _extending(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "contig_no", "tile", "n", "start", "seq", "own")]
            for s, e in together(columns[5]):
                *part, own = (c.slice(s, e - s).to_pylist() for c in columns)
                code, edge = joined(part[5])
                begin = edge[:-1] + np.array(own, np.int64) - np.array(part[4], np.int64)
                a, b, length = tile_seeds(code, edge, begin, np.full(e - s, size), params)
                tile = np.searchsorted(edge, a, side="right") - 1
                by = np.argsort(tile, kind="stable")
                shift = (np.array(part[4], np.int64) - edge[:-1])[tile]
                table = np.stack([a + shift, b + shift, length], axis=1)[by]
                found = np.flatnonzero(count := np.bincount(tile, minlength=e - s))
                ends = np.cumsum(count)
                if len(found):
                    yield from work([tuple(c[k] for c in part) for k in found.tolist()], [table[ends[k] - count[k] : ends[k]] for k in found.tolist()])

    stretches = tiles(contigs, params, size) if stretches is None else stretches
    return stretches.where(F.col("file").isNotNull() & F.col("contig_no").isNotNull()).mapInArrow(run, _schema())


def _schema() -> str:
    return "file string, contig_no long, tile long, " + ", ".join(f"{c} long" for c in _NAMES[3:16]) + ", left_text string, right_text string, right_arm string"


_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_NAMES = ["file", "contig_no", "tile", "a", "b", "len", "li", "lj", "ri", "rj", "n", "lts", "lte", "rts", "rte", "arm_length", "left_text", "right_text", "right_arm"]


def length_gate(arms: DataFrame, params: Params) -> DataFrame:
    return arms.where(F.col("arm_length").between(params.min_arm, params.max_arm))

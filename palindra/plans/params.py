"""Options of the element search."""

from __future__ import annotations

from dataclasses import dataclass, fields
from math import gcd

#: Command-line flag of each option.
FLAGS = {
    "seed": "-seed", "min_arm": "-mintirlen", "max_arm": "-maxtirlen", "min_distance": "-mintirdist", "max_distance": "-maxtirdist", "min_tsd": "-mintsd", "max_tsd": "-maxtsd",
    "vicinity": "-vic", "similar": "-similar", "xdrop": "-xdrop", "match": "-mat", "mismatch": "-mis", "insertion": "-ins", "deletion": "-del",
}


@dataclass(frozen=True)
class Params:
    """Defaults and meaning; lengths and distances in bases."""

    #: Shortest exact match that seeds a candidate.
    seed: int = 20
    min_arm: int = 10
    max_arm: int = 1000
    #: Distance between the starts of the two seed copies.
    min_distance: int = 10
    max_distance: int = 5000
    #: Lengths of a target site duplication: from ``min_tsd`` to below ``max_tsd``. At 1 or less none is sought.
    min_tsd: int = 2
    max_tsd: int = 11
    #: Half width of the flanks in which it is sought.
    vicinity: int = 13
    #: Least similarity of the arms in percent.
    similar: float = 80.0
    #: An extension stops this far below its best score.
    xdrop: int = 5
    match: int = 2
    mismatch: int = -2
    insertion: int = -3
    deletion: int = -3

    def __post_init__(self) -> None:
        if self.seed < 2 or self.seed > self.max_arm:
            raise ValueError("seed must be within 2 .. max_arm")
        if min(self._lost()) <= 0:
            raise ValueError("a match must score more than a mismatch, and half of it more than an insertion or a deletion")

    def _lost(self) -> tuple[int, int, int]:
        """Score that a mismatch, an insertion and a deletion lose against matches; doubled where a match is odd."""
        scale = 1 + self.match % 2
        half = scale * self.match // 2
        return 2 * half - scale * self.mismatch, half - scale * self.insertion, half - scale * self.deletion

    def scoring(self) -> tuple[int, int, int, tuple[int, int, int]]:
        """(drop, half a match, unit, distances): what a mismatch, an insertion and a deletion lose is their distance times
        the unit, which is the largest that makes whole distances."""
        lost, scale = self._lost(), 1 + self.match % 2
        unit = gcd(*lost)
        mismatch, insertion, deletion = (x // unit for x in lost)
        return scale * self.xdrop, scale * self.match // 2, unit, (mismatch, insertion, deletion)

    @property
    def band(self) -> tuple[int, int]:
        """Start distances of k-mer matches that can belong to a kept seed."""
        slack = self.max_arm - self.seed + 2
        return self.min_distance - slack, self.max_distance + slack

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

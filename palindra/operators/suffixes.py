"""Suffix order of contigs by prefix doubling, common prefixes of neighbours in it, and the maximal repeats that these
enclose.

Contigs of up to ``LOCAL`` letters are ordered many at a time in arrays, by the task that reads them: nothing of them
is shuffled. A longer one is ranked by all tasks together. Both ways give the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.functions.running import before
from palindra.functions.sequence import normalised, reverse_complement
from palindra.functions.packed import codes
from palindra.operators.repeats import CONTIG
from palindra.plans.params import Params
from palindra.sources.shared import written

#: Letters of the first key: 26 digits of base 5 fit into a long. Letters that a task takes together.
HEAD, _TOGETHER = 26, 1 << 18
#: The longest contig that one task orders; shorter ones are taken together. Arrays take about 150 bytes a letter.
LOCAL = 1 << 20
_KEYS = [*CONTIG, "pos"]
#: The place of no special base; keys and ranks are bucketed by shifts.
_NONE = -1
_CODE_SHIFT, _RANK_SHIFT = 50, 16
#: The rank of what follows a contig's last base: behind all others.
_END = 1 << 40


def heads(contigs: DataFrame) -> DataFrame:
    """(file, contig_no, pos, code, special, left) of every suffix: its first ``HEAD`` letters as digits, A to T from 0.

    A special base, or the contig's end, is a 4 that equals no other: ``special`` has its place if it is among
    the letters (else -1), and nothing after it counts. ``left`` is the letter before, 4 for a special one or none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in range(0, len(seq), _TOGETHER):
                    code = codes(seq[s : s + _TOGETHER + HEAD]).astype(np.int64)
                    m = min(_TOGETHER, len(seq) - s)
                    code = np.concatenate([code, np.full(m + HEAD - len(code), 4)]) if len(code) < m + HEAD else code
                    at = np.where(code == 4, np.arange(len(code)), len(code) + HEAD)
                    next_ = np.minimum.accumulate(at[::-1])[::-1][:m]
                    key, pos = np.zeros(m, np.int64), np.arange(m)
                    for k in range(HEAD):
                        key = key * 5 + np.where(pos + k <= next_, code[k : k + m], 0)
                    special = np.where(next_ < pos + HEAD, next_ + s, _NONE)
                    left = np.concatenate([codes(seq[s - 1]) if s else [4], code[: m - 1]]).astype(np.int64)
                    yield pa.record_batch([pa.array([file] * m, pa.string()), pa.array([number] * m, pa.int64()), pa.array(pos + s), pa.array(key), pa.array(special), pa.array(left)], [*_KEYS, "code", "special", "left"])

    rows = contigs.select("file", F.col("contig_no").cast("long").alias("contig_no"), normalised(F.col("seq")).alias("seq")).where(F.length("seq") > 0)
    return rows.mapInArrow(run, "file string, contig_no long, pos long, code long, special long, left long")


def _ranked(rows: DataFrame, within: list[str], key: list[str], bucket: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: how many of the rows of ``within`` have a smaller ``key``, and ``tied``: how many have this one.

    Equal keys are counted before anything is ordered, and the counts are summed by buckets of the
    key, so neither a long contig nor a frequent key is one task's.
    """
    counts = before(rows.groupBy(*within, *key).agg(F.count("*").alias("tied")), "tied", name, within, key, bucket, "sum")
    return rows.join(counts.select(*within, *key, "tied", F.col(name).cast("long").alias(name)), [*within, *key])


def suffix_order(contigs: DataFrame, keep=written, local: int = LOCAL) -> DataFrame:
    """(file, contig_no, pos, rank, lcp): the place of each suffix among those of its contig, from 0, and how long
    a prefix it shares with the one before it (0 for the first).

    A < C < G < T < special bases and the end, which equal nothing and are ordered by their place. A null or empty
    sequence has no suffixes. (file, contig_no) names one contig. ``keep`` holds what is read several times.
    """
    text = contigs.select("file", F.col("contig_no").cast("long").alias("contig_no"), normalised(F.col("seq")).alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, code, edge in _gathered(batches, _TOGETHER):
            order, lcp = order_together(code, edge)
            of = np.searchsorted(edge, order, side="right") - 1
            pos, rank = order - edge[of], np.arange(len(order)) - (edge[of] - of)
            for s in range(0, len(order), _TOGETHER):
                own = pa.array(of[s : s + _TOGETHER])
                yield pa.record_batch([rows.column(0).take(own), rows.column(1).take(own), *(pa.array(x[s : s + _TOGETHER]) for x in (pos, rank, lcp))], [*_KEYS, "rank", "lcp"])

    short = text.where(F.length("seq").between(1, local)).mapInArrow(run, "file string, contig_no long, pos long, rank long, lcp long")
    long_ = keep(text.where(F.length("seq") > local))
    return short if long_.isEmpty() else short.unionByName(_order(long_, keep).drop("left"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of (file, contig_no, seq, ...) of about ``most`` letters, their codes with a 4 behind each, and where each begins, and the end."""
    for batch in batches:
        size = pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        end, start = np.cumsum(size), 0
        while start < len(end):
            done = int(end[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(end, done + most, side="right")))
            rows = batch.slice(start, stop - start)
            yield rows, codes("N".join(rows.column(2).to_pylist()) + "N"), np.concatenate([[0], end[start:stop] - done])
            start = stop


def order_together(code: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``code`` in the suffix order of each contig, one contig after another, and the prefix each shares with the one before.

    ``edge`` has where contigs begin, and the end; the last letter of each is a 4 that is not its own. Ranks are those of
    ``_order``: by the first ``HEAD`` letters, then, for what still ties, by the rank as many letters on.
    """
    total = len(code)
    wide, place = np.concatenate([code, np.full(HEAD, 4)]).astype(np.int64), np.arange(total)
    at = np.where(wide == 4, np.arange(total + HEAD), total + HEAD)
    next_ = np.minimum.accumulate(at[::-1])[::-1][:total]
    # digits of 16 + 8 + 2 letters; those behind a special base do not count
    two = wide[:-1] * 5 + wide[1:]
    four = two[:-2] * 5**2 + two[2:]
    eight = four[:-4] * 5**4 + four[4:]
    key = (eight[:total] * 5**8 + eight[8 : total + 8]) * 5**8 + eight[16 : total + 16]
    key = key * 5**2 + two[24 : total + 24]
    some = np.flatnonzero(next_ < place + HEAD)
    cut = 5 ** (HEAD - 1 - (next_ - place)[some])
    key[some] = key[some] // cut * cut
    del two, four, eight
    own = np.ones(total, bool)
    own[edge[1:] - 1] = False
    # 16 bits are sorted by their digits
    of = np.repeat(np.arange(len(edge) - 1, dtype=np.uint16 if len(edge) <= 1 << 16 else np.int64), np.diff(edge))
    # what has a special base, or its end, among its first letters is like no other
    alone = np.where(next_ < place + HEAD, next_, _NONE)
    sorted_ = np.flatnonzero(own)
    # stable, so equal keys with a special base, which is as far off in each, are in the order of its place
    sorted_ = sorted_[np.argsort(key[sorted_], kind="stable")]
    sorted_ = sorted_[np.argsort(of[sorted_], kind="stable")]
    k, o, c = key[sorted_], alone[sorted_], of[sorted_]
    rank = np.full(total + 1, total, np.int32)  # the end is behind all
    rank[sorted_] = _firsts(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (c[1:] != c[:-1])]))
    del alone, k, o, c, at
    rounds, width = [], HEAD
    ties = sorted_[_tied(rank[sorted_])]
    while len(ties):
        rounds.append(rank.copy())
        group, more = rank[ties].astype(np.int64), rank[ties + width].astype(np.int64)
        by = np.lexsort((more, group))
        ties, group, more = ties[by], group[by], more[by]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        new = group + _firsts(head | np.concatenate([[True], more[1:] != more[:-1]])) - _firsts(head)
        rank[ties] = new
        ties, width = ties[_tied(new)], 2 * width
    order = np.empty(len(sorted_), np.int64)
    order[rank[sorted_]] = sorted_
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(of[order[1:]] == of[order[:-1]]) + 1
    one, two = order[at], order[at - 1]
    # neighbours that tied in a round share as many letters, and go on behind these in the rounds before
    deep = np.flatnonzero(rounds[0][one] == rounds[0][two]) if rounds else np.zeros(0, np.int64)
    x, y = one[deep], two[deep]
    for n in range(len(rounds) - 1, -1, -1):
        step = np.where(rounds[n][x] == rounds[n][y], HEAD << n, 0)
        x, y = x + step, y + step
    shared = np.zeros(len(at), np.int64)
    shared[deep] = x - one[deep]
    # the rest is within the first letters of what follows, up to a special base there
    x, y = one + shared, two + shared
    u, v, rest = key[x], key[y], np.zeros(len(at), np.int64)
    powers = 5 ** np.arange(HEAD + 1, dtype=np.int64)
    for step in (16, 8, 4, 2, 1):
        more = rest + step
        cut = powers[HEAD - np.minimum(more, HEAD)]
        rest = np.where((more <= HEAD) & (u // cut == v // cut), more, rest)
    shared += np.minimum(rest, next_[x] - x)
    lcp[at] = shared
    return order, lcp


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each place the nearest one up to it where ``new`` is set; it is at the first."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def _tied(rank: np.ndarray) -> np.ndarray:
    """Which of the ranks, in order, equal a neighbour's."""
    same = np.concatenate([[False], rank[1:] == rank[:-1], [False]]) if len(rank) else np.zeros(1, bool)
    return same[1:] | same[:-1]


def _order(contigs: DataFrame, keep) -> DataFrame:
    """``suffix_order`` with ``left``, the letter before each suffix, by joins and counts over all tasks.

    Suffixes are ranked by their first ``HEAD`` letters; those that tie are ranked anew by the rank of the suffix as many
    letters on, which doubles the letters each time. What has its place takes no part any more, so a round costs
    what still ties, and there are as many as the logarithm of the longest repeat. Common prefixes come from the
    ranks of each round: neighbours that tied in one and not in the next share that many letters, and
    more as far as the suffixes that follow tied in the rounds before. Tables in the shared folder keep plans short.
    """
    first = keep(_ranked(keep(heads(contigs)), CONTIG, ["code", "special"], F.shiftright("code", _CODE_SHIFT), "rank").select(*_KEYS, "code", "special", "left", "rank", "tied"))
    # the latest ranks of all suffixes that ever tied, and those of each round that tied in it
    latest = first.where("tied > 1").select(*_KEYS, "rank")
    rounds, width = [keep(latest)], HEAD
    while not rounds[-1].isEmpty():
        tied = rounds[-1]
        at = tied.select(*CONTIG, F.col("pos").alias("own"), F.col("rank").alias("group"), (F.col("pos") + width).alias("pos"))
        at = at.join(latest.withColumnRenamed("rank", "newer"), _KEYS, "left").join(first.select(*_KEYS, "rank"), _KEYS, "left")
        at = at.select(*CONTIG, F.col("own").alias("pos"), "group", F.coalesce("newer", "rank", F.lit(_END)).alias("next"))
        again = _ranked(at, [*CONTIG, "group"], ["next"], F.shiftright("next", _RANK_SHIFT), "more").select(*_KEYS, (F.col("group") + F.col("more")).alias("rank"), "tied")
        again = keep(again)
        latest = keep(again.select(*_KEYS, "rank").unionByName(latest.join(again.select(*_KEYS), _KEYS, "left_anti")))
        rounds.append(keep(again.where("tied > 1").select(*_KEYS, "rank")))
        width *= 2
    order = keep(first.join(latest.withColumnRenamed("rank", "newer"), _KEYS, "left").select(*_KEYS, "code", "left", F.coalesce("newer", "rank").alias("rank")))
    lower = order.select(*CONTIG, (F.col("rank") + 1).alias("rank"), F.col("pos").alias("other"), F.col("code").alias("_other"))
    both = keep(order.join(lower, [*CONTIG, "rank"], "left").select(*_KEYS, "left", "rank", "other", _shared("code", "_other").cast("long").alias("lcp")))
    # those that share all of the first letters share more, from the widest round down
    pairs = both.where(F.col("lcp") == HEAD).withColumn("lcp", F.lit(0).cast("long"))
    for k in range(len(rounds) - 2, -1, -1):
        here = lambda c, name, k=k: rounds[k].select(*CONTIG, (F.col("pos")).alias(f"_{c}"), F.col("rank").alias(name))
        moved = pairs.withColumns({"_one": F.col("pos") + F.col("lcp"), "_two": F.col("other") + F.col("lcp")})
        moved = moved.join(here("one", "_x"), [*CONTIG, "_one"], "left").join(here("two", "_y"), [*CONTIG, "_two"], "left")
        pairs = moved.withColumn("lcp", F.col("lcp") + F.when(F.col("_x") == F.col("_y"), HEAD << k).otherwise(0)).drop("_one", "_two", "_x", "_y")
    # and the rest is within the first letters of what follows; a special base there ends it
    rest = lambda c: order.select(*CONTIG, F.col("pos").alias(f"_{c}"), F.col("code").alias(f"_c{c}"))
    pairs = pairs.withColumns({"_1": F.col("pos") + F.col("lcp"), "_2": F.col("other") + F.col("lcp")}).join(rest("1"), [*CONTIG, "_1"], "left").join(rest("2"), [*CONTIG, "_2"], "left")
    deep = pairs.select(*_KEYS, "left", "rank", (F.col("lcp") + _shared("_c1", "_c2")).cast("long").alias("lcp"))
    return both.where(F.col("lcp") < HEAD).select(*_KEYS, "left", "rank", "lcp").unionByName(deep)


def _shared(a: str, b: str) -> Column:
    """Leading digits that two codes share, none from a 4 on; a contig's end has no code."""
    digit = lambda c, k: F.expr(f"pmod({c} div {5 ** (HEAD - 1 - k)}L, 5L)")
    out = F.lit(HEAD)
    for k in range(HEAD - 1, -1, -1):
        out = F.when((digit(a, k) != digit(b, k)) | (digit(a, k) == 4), F.lit(k)).otherwise(out)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0)).otherwise(out)


class _Intervals:
    """Bottom-up over the common-prefix intervals of one run of neighbours that share ``least`` letters or more.

    An interval's members are sorted places by (strand, letter before). Where two parts meet at a depth, members with
    another letter before are maximal pairs of that length, and the smaller part moves into the larger.
    """

    def __init__(self, least: int, low: int, high: int, inverted: bool):
        self.least, self.low, self.high, self.inverted = least, low, high, inverted
        self.stack: list[list] = []
        self.last: dict | None = None
        self.found: list[tuple[int, int, int]] = []
        self.n = 0

    def add(self, pos: int, before_: int, lcp: int, n: int) -> None:
        """The next suffix of the run; ``n`` is where the second strand begins, less one."""
        self.n = n
        if self.last is not None:
            self._down(lcp)
        self.last = {(self.inverted and pos > n, before_): [pos]}

    def end(self) -> list[tuple[int, int, int]]:
        """The run's pairs (a, b, len)."""
        if self.last is not None:
            self._down(-1)
        out, self.found, self.last, self.stack = self.found, [], None, []
        return out

    def _down(self, depth: int) -> None:
        here = self.last
        while self.stack and self.stack[-1][0] > depth:
            at, held = self.stack.pop()
            here = self._meet(held, here, at)
        if self.stack and self.stack[-1][0] == depth:
            self.stack[-1][1] = self._meet(self.stack[-1][1], here, depth)
        elif depth >= self.least:
            self.stack.append([depth, here])

    def _meet(self, one: dict, two: dict, depth: int) -> dict:
        if sum(map(len, one.values())) < sum(map(len, two.values())):
            one, two = two, one
        for (strand, letter), few in two.items():
            for (other, theirs), many in one.items():
                # special bases, numbered from 4, equal nothing
                if (letter != theirs or letter >= 4) and (not self.inverted or strand != other):
                    self._pairs(few, strand, many, depth)
        for key, few in two.items():
            many = one.setdefault(key, [])
            if len(few) > len(many):
                many, few = few, many
            if len(few) > 32:
                many = sorted(many + few)
            else:
                for x in few:
                    insort(many, x)
            one[key] = many
        return one

    def _pairs(self, few: list[int], strand: bool, many: list[int], depth: int) -> None:
        for x in few:
            if self.inverted:
                # with a on the first strand and y on the second, b = 2 n + 1 - y - depth
                sums = 2 * self.n + 1 - depth
                for y in many[bisect_left(many, sums - self.high - x) : bisect_right(many, sums - self.low - x)]:
                    a, t = (y, x) if strand else (x, y)
                    self.found.append((a, sums - t, depth))
            else:
                for y in many[bisect_left(many, x + self.low) : bisect_right(many, x + self.high)]:
                    self.found.append((x, y, depth))
                for y in many[bisect_left(many, x - self.high) : bisect_right(many, x - self.low)]:
                    self.found.append((y, x, depth))


def repeats_of_intervals(contigs: DataFrame, least: int, low: int, high: int, inverted: bool = True, keep=written, local: int = LOCAL) -> DataFrame:
    """(file, contig_no, a, b, len): maximal exact repeats of ``least`` bases or more, ``low`` <= b - a <= ``high``.

    From the suffix order of each contig, inverted ones from that of the contig and its reverse complement behind a
    special base. Neighbours that share ``least`` letters are a run, which is read in order; its places are held
    and no matches of k-mers: the work is that of the order and of what it finds. Texts of up to ``local`` letters (both
    strands) are ordered and read by the task that has them, of longer ones each run goes to a task. ``least`` is 1 or more.
    """
    if least < 1:
        raise ValueError("least is 1 or more")
    if low < 1:
        raise ValueError("low is 1 or more: a repeat begins after its first copy")
    text = contigs.select("file", F.col("contig_no").cast("long").alias("contig_no"), normalised(F.col("seq")).alias("seq"))
    n = F.length("seq").cast("long")
    text = text.select(*CONTIG, (F.concat("seq", F.lit("N"), reverse_complement(F.col("seq"))) if inverted else F.col("seq")).alias("seq"), n.alias("n"))
    out = "file string, contig_no long, a long, b long, len long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for rows, code, edge in _gathered(batches, _TOGETHER):
            order, lcp = order_together(code, edge)
            deep = lcp >= least
            member = np.flatnonzero(deep | np.concatenate([deep[1:], [False]]))
            of = np.searchsorted(edge, order[member], side="right") - 1
            pos = order[member] - edge[of]
            before_ = code[np.maximum(order[member] - 1, 0)].astype(np.int64)
            letter = np.where((pos > 0) & (before_ < 4), before_, pos + 4)
            names = list(zip(*(rows.column(c).to_pylist() for c in (0, 1, 3)), strict=True))
            work, here = _Intervals(least, low, high, inverted), None
            for k, p, x, shared in zip(of.tolist(), pos.tolist(), letter.tolist(), lcp[member].tolist(), strict=True):
                if shared < least:
                    if here is not None:
                        found.add(names[here][:2], work.end())
                    here = k
                work.add(p, x, shared, names[k][2])
            if here is not None:
                found.add(names[here][:2], work.end())
            yield found.batch()

    short = text.where(F.length("seq").between(1, local)).mapInArrow(read, out)
    long_ = keep(text.where(F.length("seq") > local))
    return short if long_.isEmpty() else short.unionByName(_of_long(long_, least, low, high, inverted, keep).mapInArrow(_runs(least, low, high, inverted), out))


class _Found:
    """Repeats that a task has found and not given yet."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, name: tuple, pairs: list[tuple[int, int, int]]) -> None:
        self.rows += [(*name, *x) for x in pairs]

    def batch(self) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 4]
        columns = [pa.array([x[k] for x in self.rows], t) for k, t in enumerate(types)]
        self.rows = []
        return pa.record_batch(columns, [*CONTIG, "a", "b", "len"])


def _of_long(text: DataFrame, least: int, low: int, high: int, inverted: bool, keep) -> DataFrame:
    """Members of the runs of ``text``, those of a run together and in order."""
    order = keep(_order(text, keep))
    # only those that share enough with a neighbour: the members of runs, and the one that each run starts with
    deep = order.where(F.col("lcp") >= least)
    first = order.join(deep.select(*CONTIG, (F.col("rank") - 1).alias("rank")), [*CONTIG, "rank"], "left_semi").where(F.col("lcp") < least)
    members = keep(deep.unionByName(first.select(*deep.columns))).withColumn("mark", (F.col("lcp") < least).cast("long"))
    members = before(members, "mark", "earlier", CONTIG, ["rank"], F.shiftright("rank", _RANK_SHIFT), "sum").join(text.select(*CONTIG, "n"), CONTIG)
    # special bases are told apart by their place
    letter = F.when(F.col("left") < 4, F.col("left")).otherwise(F.col("pos") + 4).cast("long")
    rows = members.select(*CONTIG, (F.col("earlier") + F.col("mark")).cast("long").alias("run"), "rank", "pos", letter.alias("letter"), "lcp", "n")
    return rows.repartition(*CONTIG, "run").sortWithinPartitions(*CONTIG, "run", "rank")


def _runs(least: int, low: int, high: int, inverted: bool):
    """The repeats of ordered members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, work, found = None, _Intervals(least, low, high, inverted), _Found()
        for batch in batches:
            for file, number, group, _, pos, letter, lcp, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, number, group) != here:
                    if here is not None:
                        found.add(here[:2], work.end())
                    here = file, number, group
                    if len(found.rows) > 1 << 16:
                        yield found.batch()
                work.add(pos, letter, lcp, n)
        if here is not None:
            found.add(here[:2], work.end())
        yield found.batch()

    return run


def seeds_of_intervals(contigs: DataFrame, params: Params, keep=written, local: int = LOCAL) -> DataFrame:
    """Seeds from the common-prefix intervals of contigs and their reverse complements; ``repeats.seeds`` gives the same rows."""
    found = repeats_of_intervals(contigs, params.seed, max(1, params.min_distance), params.max_distance, True, keep, local)
    return found.where(F.col("len") <= params.max_arm)

"""The overlap sweep over candidates that arrive roughly in order: keyed state instead of a sort of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palindra.operators.overlap import ORDER
from palindra.plans.params import Params

#: Columns of a candidate, and those that order them.
COLUMNS = ["contig_no", *ORDER, "lte", "rte", "tsd", "sim"]
PLACE = ["contig_no", *ORDER]
_ROW = "contig_no long, lts long, rts long, a long, b long, len long, lte long, rte long, tsd long, sim double"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def disorder(params: Params) -> int:
    """How far an arm's start can lie from that of its seed: candidates made in the order of seeds are as far out of order."""
    return params.max_arm + params.vicinity + params.max_tsd + 8


class Sweep:
    """The state of one file's sweep, and what each batch of rows closes."""

    def __init__(self, bound: int):
        self.bound = bound
        #: Live rows not yet swept, and the least skipped row until the sweep has begun.
        self.window: list[tuple] = []
        self.ghost: tuple | None = None
        #: The greatest (contig, start) seen.
        self.mark = (-1, 0)
        self.begun = False
        #: The open cluster: its contig, how far it reaches, and its best row (none for a skipped first row).
        self.contig, self.reach = -1, -1
        self.best: tuple | None = None

    def add(self, rows: list[tuple], ended: bool) -> list[tuple]:
        """Takes (row, skip) pairs; returns the best rows of the clusters that nothing can join any more."""
        for row, skip in rows:
            if self._passed(row[0], row[1]):
                raise ValueError(f"contig {row[0]}, {row[1]} comes more than {self.bound} late")
            if not skip:
                self.window.append(row)
            elif not self.begun and (self.ghost is None or row[:6] < self.ghost[:6]):
                self.ghost = row
        self.mark = max([self.mark, *((row[0], row[1]) for row, _ in rows)])
        self.window.sort(key=lambda r: r[:6])
        out, swept = [], 0
        for row in self.window:
            if not ended and not self._passed(row[0], row[1]):
                break
            swept += 1
            out += self._sweep(row)
        del self.window[:swept]
        if self.begun and (ended or self._passed(self.contig, self.reach)):
            out += self._close()
        return out

    def _passed(self, contig: int, at: int) -> bool:
        """No row at or before this place can come any more."""
        return contig < self.mark[0] or (contig == self.mark[0] and at < self.mark[1] - self.bound)

    def _sweep(self, row: tuple) -> list[tuple]:
        if not self.begun:
            self.begun = True
            if self.ghost is not None and self.ghost[:6] < row[:6]:  # the file's first row bridges what it meets, and never wins
                self.contig, self.reach = self.ghost[0], self.ghost[7]
            self.ghost = None
        if row[0] == self.contig and row[1] <= self.reach:
            self.reach = max(self.reach, row[7])
            if self.best is None or row[9] > self.best[9]:
                self.best = row
            return []
        out = self._close()
        self.contig, self.reach, self.best = row[0], row[7], row
        return out

    def _close(self) -> list[tuple]:
        out, self.best = [self.best] if self.best is not None else [], None
        self.contig, self.reach = -1, -1
        return out


class _Processor(StatefulProcessor):
    def __init__(self, bound: int):
        self.bound = bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "begun boolean, mark_contig long, mark long, contig long, reach long")
        self.rows = handle.getListState("rows", f"kind string, {_ROW}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sweep = Sweep(self.bound)
        if self.core.exists():
            sweep.begun, *mark, sweep.contig, sweep.reach = self.core.get()
            sweep.mark = tuple(mark)
            for kind, *row in self.rows.get():
                if kind == "window":
                    sweep.window.append(tuple(row))
                else:
                    setattr(sweep, kind, tuple(row))
        new, ended = [], False
        for batch in rows:
            ended = ended or bool(batch["ended"].any())
            batch = batch[~batch["ended"]]
            ints = [batch[c].astype("int64").tolist() for c in COLUMNS[:-1]]
            new += zip(zip(*ints, batch["sim"].astype(float).tolist(), strict=True), batch["skip"].tolist(), strict=True)
        out = sweep.add(new, ended)
        held = [("window", *r) for r in sweep.window] + [(k, *r) for k in ("ghost", "best") if (r := getattr(sweep, k)) is not None]
        if ended:
            self.core.clear()
            self.rows.clear()
        else:
            self.core.update((sweep.begun, *sweep.mark, sweep.contig, sweep.reach))
            self.rows.put(held) if held else self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).assign(file=key[0])[["file", *COLUMNS]]

    def close(self) -> None:
        pass


def sweep_clusters(candidates: DataFrame, bound: int) -> DataFrame:
    """A stream of the best row of each overlap cluster, from a stream of candidates of (file, COLUMNS, skip, ended).

    Rows of a file may come in any order in which none comes after one whose start is more than ``bound``
    further on, or in a later contig; one that does is an error, as its cluster may have gone. A cluster
    leaves once the greatest start seen is more than ``bound`` past its end, or with the file's row of ``ended``,
    whose other columns don't matter. What is kept of a file are the rows of the last ``bound`` bases, the open
    cluster's best and reach. The rows are those of ``overlap.best_per_cluster``, a skipped first row counted likewise.
    """
    schema = f"file string, {_ROW}"
    return candidates.groupBy("file").transformWithStateInPandas(_Processor(bound), schema, "Append", "None")


def start_sweep(spark: SparkSession, folder: str, out: str, checkpoint: str, bound: int, files: int = 1):
    """A query that sweeps candidates from Parquet files as they arrive in ``folder`` and appends the best rows to ``out``."""
    rows = spark.readStream.schema(f"file string, {_ROW}, skip boolean, ended boolean").option("maxFilesPerTrigger", files).parquet(folder)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:  # a query keeps the settings that it starts with
        spark.conf.set(name, _PROVIDER)
        return sweep_clusters(rows, bound).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out)
    finally:
        spark.conf.set(name, before)


def with_ends(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``ended``, and a row that ends each file."""
    ends = candidates.select("file").distinct().withColumn("ended", F.lit(True))
    return candidates.withColumn("ended", F.lit(False)).unionByName(ends, allowMissingColumns=True)

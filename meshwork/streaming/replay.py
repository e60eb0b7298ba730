"""Editions replayed as a stream: records and closing markers arrive in any order and split, the change log comes out.

A marker says that a plan's edition is complete and how many keys it lists.  State is the latest edition
of a plan, dealt by a hash of the keys so that no plan is one task's; a marker is sent to every
share of its plan with the number of keys that the share is to hold.  An edition is compared once its marker, all its
records and the edition before it are there, so what comes out
does not depend on how rows were split into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import editions

RECORD = ("name", "isd", "cost_cents", "lat", "lon", "state")
#: ``n`` is the count of a marker, null for a record; ``turn`` an edition's number within its plan, from 1.
ROWS = "plan string, share int, turn int, step string, n long, rkey string, name string, isd string, cost_cents long, lat double, lon double, state string"
HELD = "turn int, step string, rkey string, name string, isd string, cost_cents long, lat double, lon double, state string"
MATCHED = "plan string, step string, rkey string, in_old boolean, in_new boolean, " + ", ".join(f"{s}_{c}" for s in "on" for c in ("name string", "isd string", "cost_cents long", "lat double", "lon double", "state string"))
#: Records of an edition that one share holds in a task's memory.
SHARE = 50_000
#: The state store that keeps lists beyond memory on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Edition(StatefulProcessor):
    """One share of a plan: the edition compared last, and what waits for its marker, its records or its turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getListState("current", HELD)
        self.waiting = handle.getListState("waiting", HELD)
        self.markers = handle.getListState("markers", "turn int, step string, n long")
        self.closed = handle.getValueState("closed", "turn int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed = self.closed.get()[0] if self.closed.exists() else 0
        markers = {t: (step, n) for t, step, n in self.markers.get()}
        waiting: dict[int, dict[str, tuple]] = {}
        for held in self.waiting.get():
            waiting.setdefault(held[0], {})[held[2]] = tuple(held)
        for batch in rows:
            # Arrow's nulls of whole numbers come as NaN; they are nulls again here.
            for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if r.turn <= closed:
                    continue  # an edition sent again
                if r.n is not None:
                    markers[int(r.turn)] = (r.step, int(r.n))
                else:
                    cents = None if r.cost_cents is None else int(r.cost_cents)
                    waiting.setdefault(int(r.turn), {}).setdefault(r.rkey, (int(r.turn), r.step, r.rkey, r.name, r.isd, cents, r.lat, r.lon, r.state))
        before = None
        while closed + 1 in markers and len(waiting.get(closed + 1, {})) >= markers[closed + 1][1]:
            if before is None:
                before = {held[2]: tuple(held) for held in self.current.get()}
            closed += 1
            step, _ = markers.pop(closed)
            now = waiting.pop(closed, {})
            if closed > 1:
                yield from self.compared(key[0], step, before, now)
            before = now
        self.put(self.markers, [(t, *m) for t, m in markers.items()])
        self.put(self.waiting, [held for edition in waiting.values() for held in edition.values()])
        if before is not None:
            self.put(self.current, list(before.values()))
            self.closed.update((closed,))

    @staticmethod
    def put(state, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    @staticmethod
    def compared(plan: str, step: str, old: dict, new: dict) -> Iterator[pd.DataFrame]:
        """Keys of either edition whose records are not equal."""
        out = []
        for k in sorted(old.keys() | new.keys()):
            o, n = old.get(k), new.get(k)
            if o is None or n is None or o[3:] != n[3:]:
                out.append((plan, step, k, o is not None, n is not None, *(o[3:] if o else [None] * len(RECORD)), *(n[3:] if n else [None] * len(RECORD))))
        if out:
            names = [c.strip().split()[0] for c in MATCHED.split(",")]
            yield pd.DataFrame(out, columns=names).astype({"o_cost_cents": "Int64", "n_cost_cents": "Int64"})

    def close(self) -> None:
        pass


def marked(records: DataFrame, steps: DataFrame, shares: int | None = None) -> DataFrame:
    """Rows of the stream, records and markers, from a table of records (``filing, plan, rkey`` and those of ``RECORD``) and
    the steps of filings (``id, plan, seq``): one marker for each filing and share, with the keys that the share holds.

    A key that stands twice in an edition counts once; which of its records is kept is open, as keys are unique.  Unless
    the number of shares is given, the largest edition decides, at ``SHARE`` records each; a stream keeps the number it began with.
    """
    if shares is None:
        largest = records.groupBy("filing").count().agg(F.max("count")).first()[0]
        shares = max(1, -(-(largest or 0) // SHARE))
    turns = steps.select(F.col("id").alias("filing"), F.col("plan").alias("__plan"), F.row_number().over(Window.partitionBy("plan").orderBy("seq")).alias("turn"))
    dealt = records.withColumn("share", F.pmod(F.xxhash64("rkey"), F.lit(shares)).cast("int"))
    rows = dealt.join(turns.drop("__plan"), "filing").select(
        "plan", "share", "turn", F.col("filing").alias("step"), F.lit(None).cast("long").alias("n"), "rkey", "name", F.col("isd").cast("string").alias("isd"), F.col("cost_cents").cast("long").alias("cost_cents"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "state")
    counted = dealt.groupBy("filing", "share").agg(F.count_distinct("rkey").alias("n"))
    every = turns.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    markers = every.join(counted, ["filing", "share"], "left").select(F.col("__plan").alias("plan"), "share", "turn", F.col("filing").alias("step"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows.unionByName(markers, allowMissingColumns=True)


def replay(rows: DataFrame) -> DataFrame:
    """A stream of ``ROWS`` to a stream of ``MATCHED``: keys that differ between an edition and the one before it.

    Rows sent again change nothing: within an edition a key is held once, and an edition that was compared is over.
    """
    return rows.groupBy("plan", "share").transformWithStateInPandas(Edition(), MATCHED, "Append", "None")


def change_log(matched: DataFrame) -> DataFrame:
    """The change log of ``MATCHED`` rows, by the rules of ``editions.project_changes``."""
    side = lambda s, there: F.when(F.col(there), F.struct(*[(F.col(f"{s}_{c}").cast("date") if c == "isd" else F.col(f"{s}_{c}")).alias(c) for c in RECORD])).alias(s)
    return editions.project_changes(matched.select("step", "rkey", side("o", "in_old"), side("n", "in_new")))


def run(rows: DataFrame, folder: str) -> DataFrame:
    """Replay a stream to its present end into ``folder``, and return the change log of all that came out so far.

    Run again with the same folder, it goes on where it stopped.
    """
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = replay(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/matched").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    return change_log(spark.read.schema(MATCHED).parquet(f"{folder}/matched"))

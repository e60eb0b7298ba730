"""The streamed replay equals the change log of whole editions, however its rows arrive."""

import datetime as dt
import random

from pyspark.sql import functions as F

from meshwork.operators import editions
from meshwork.streaming import replay

RECORDS = "filing string, plan string, rkey string, name string, isd date, cost_cents long, lat double, lon double, state string"
STEPS = "id string, plan string, seq int, previous string"
COLUMNS = ("step", "rkey", "kind", "what", "days", "old_cost", "cost")


def made(rng):
    steps, records, seq = [], [], 0
    for plan, n in (("alpha", 4), ("beta", 3), ("gamma", 1)):
        previous = None
        for e in range(n):
            seq += 1
            filing = f"{plan}-{e}"
            steps.append((filing, plan, seq, previous))
            previous = filing
            for k in range(30):
                if (plan, e) != ("beta", 1) and rng.random() < 0.7:  # the second of beta is empty
                    name = rng.choice(["Oak Hill Rebuild", "Oak Hill Rebuilt", "Quite Unlike Yjzvwk"])
                    records.append((filing, plan, f"K{k}", name, rng.choice([None, dt.date(2030, 1, 1 + e)]), rng.choice([None, 0, 100, 2_000_000_000_000]), 33.0, -81.0, rng.choice(["SC", None])))
    return steps, records


def batch_log(spark, steps, records):
    """The operator for whole editions."""
    s = spark.createDataFrame(steps, STEPS).filter("previous IS NOT NULL").select(F.col("id").alias("step"), "previous")
    r = spark.createDataFrame(records, RECORDS)
    matched = editions.match_unique(r.join(s, r["filing"] == s["previous"]), r.join(s, r["filing"] == s["step"]))
    return told(editions.project_changes(matched))


def told(log):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in COLUMNS)) for r in log.collect()), key=repr)


def feed(spark, rows, folder, parts):
    for part in parts:
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{folder}/rows")


def stream(spark, rows, folder):
    return replay.run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows"), folder)


def test_replay_equals_the_batch_for_any_split(spark, tmp_path):
    rng = random.Random(1)
    steps, records = made(rng)
    want = batch_log(spark, steps, records)
    assert {w[2] for w in want} == {"added", "removed", "changed"}
    rows = replay.marked(spark.createDataFrame(records, RECORDS), spark.createDataFrame(steps, STEPS), 3)
    sent = rows.collect()
    sent += rng.sample(sent, 40)  # rows sent twice
    rng.shuffle(sent)
    cuts = sorted(rng.sample(range(1, len(sent)), 3))
    parts = [sent[a:b] for a, b in zip([0, *cuts], [*cuts, len(sent)])]
    feed(spark, rows, tmp_path, parts[:2])
    some = told(stream(spark, rows, tmp_path))
    assert set(some) <= set(want) and len(some) < len(want)
    # Later rows, and all of the first edition once more: the run goes on where it stopped.
    feed(spark, rows, tmp_path, [*parts[2:], [r for r in sent if r.turn == 1]])
    assert told(stream(spark, rows, tmp_path)) == want


def test_replay_of_nothing(spark, tmp_path):
    rows = replay.marked(spark.createDataFrame([], RECORDS), spark.createDataFrame([], STEPS))
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    assert told(stream(spark, rows, tmp_path)) == []

"""State tables: late and repeated events, batches that run again, compactions that were cut off, and what a look-up reads."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators.snapshots import StateTable

SCHEMA = "book long, chunk int, seq long, text string, status string"


@pytest.fixture
def events():
    r = random.Random(5)
    return [(r.choice([None, 1, 1, 1, 2, 3]), r.randrange(4), r.choice([None, *range(40)]), r.choice([None, "a", "b", ""]), r.choice([None, "done", "flagged"])) for _ in range(200)]


def brute(events):
    out = {}
    for book, chunk, seq, *values in events:
        row = out.setdefault((book, chunk), [None, None, None])
        row[0] = max((x for x in (row[0], seq) if x is not None), default=None)
        for k, v in enumerate(values, 1):
            if seq is not None and v is not None:
                row[k] = max(row[k] or (seq, v), (seq, v))
    return {k: (seq, *[v and v[1] for v in values]) for k, (seq, *values) in out.items()}


def as_dict(df):
    rows = [((r.book, r.chunk), (r.seq, r.text, r.status)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def state(spark, path, parts=8):
    return StateTable(spark, f"file://{path}", spark.createDataFrame([], SCHEMA).schema, ("book", "chunk"), "seq", "book", parts)


@pytest.mark.parametrize("parts", [8, 0])
def test_current_and_lookup(spark, tmp_path, events, parts):
    t = state(spark, tmp_path, parts)
    assert as_dict(t.current()) == {} and t.lookup(1).collect() == []
    for k in range(4):
        t.append(spark.createDataFrame(events[50 * k : 50 * k + 50], SCHEMA), k)
        if k in (1, 2):
            t.compact(k)
    assert as_dict(t.current()) == brute(events)
    for book in (None, 1, 2, 3, 99):
        assert as_dict(t.lookup(book)) == {k: v for k, v in brute(events).items() if k[0] == book}


def test_replays_and_broken_snapshots(spark, tmp_path, events):
    t = state(spark, tmp_path)
    first, second = (spark.createDataFrame(e, SCHEMA) for e in (events[:100], events[100:]))
    t.append(first, 0)
    t.append(second, 1)
    t.append(second, 1)  # the batch runs again
    t.append(first, 2)  # the same events under another number
    t.compact(1)
    (tmp_path / "snapshot" / "_upto=1" / "_SUCCESS").unlink()  # as if cut off before its end
    assert as_dict(t.current()) == brute(events)
    t.compact(1)
    assert as_dict(t.current()) == brute(events)


def test_lookup_reads_its_part_alone(spark, tmp_path, events):
    t = state(spark, tmp_path)
    t.append(spark.createDataFrame(events, SCHEMA), 0)
    t.append(spark.createDataFrame(events[:9], SCHEMA), 1)
    t.compact(0)
    found = t.lookup(2)
    part = spark.range(1).select(t.part(F.lit(2))).first()[0]
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert len(scans) == 2 and all(f"= {part})" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scans)

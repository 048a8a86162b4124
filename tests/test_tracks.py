"""Streams with keyed state: late and early fixes, tracks that end, terrain that stays."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.streaming import residency, tracks

FIXES = "track_id long, fix_id long, ts timestamp, te int, tn int"
END = -1  # the track whose one fix, far in the future, moves the watermark past all others


def table(spark, rows, schema=FIXES):
    plain = schema.replace("ts timestamp", "ts long")
    return spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("ts")))


def streamed(spark, tmp_path, files, make, name):
    """The rows that ``make`` gives for a stream of ``files``, one a batch."""
    for df in files:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
    stream = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def walks(seed, steps=24, most=2, tracks_=3):
    rng = np.random.default_rng(seed)
    return [(t, 100 * t + k, 60 * k, int(e), int(n)) for t in range(tracks_) for k, (e, n) in enumerate(np.cumsum(rng.integers(-most, most + 1, (steps, 2)), axis=0))]


def in_files(spark, rows, seed=0):
    """Three files, rows dealt at random: most fixes come out of order, within an hour; then the end."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 3, len(rows))
    return [*(table(spark, [r for r, a in zip(rows, at) if a == k]) for k in range(3)), table(spark, [(END, 0, 10**7, 0, 0)])]


CASES = {
    "residency": (lambda s, idle: residency.residency_stream(s, 2, 1, "2 hours", idle), lambda d, idle: residency.residency_batch(d, 2, 1, idle)),
    "levels": (lambda s, idle: residency.lod_changes_stream(s, 4, "2 hours", idle), lambda d, idle: residency.lod_changes_batch(d, 4)),
    "generation": (lambda s, idle: residency.coverage_generation_stream(s, "2 hours", idle), lambda d, idle: residency.coverage_generation_batch(d)),
    "chunks": (lambda s, idle: residency.chunk_resolution_stream(s, 70, 8, "2 hours", idle), lambda d, idle: residency.chunk_resolution_batch(d, 70)),
}


@pytest.mark.parametrize("kind", CASES)
def test_fixes_out_of_order_give_the_batch_twins_events(spark, tmp_path, kind):
    stream, batch = CASES[kind]
    rows = walks(11, most=9 if kind == "chunks" else 2)
    got = streamed(spark, tmp_path, in_files(spark, rows), lambda s: stream(s, 1e9), f"order_{kind}")
    want = Counter(map(tuple, batch(table(spark, rows), None).collect()))
    assert Counter(r for r in got if r[0] != END) == want and len(want) > 20


def plain_residency(rows, radius, margin, idle):
    out = Counter()
    for t in {r[0] for r in rows}:
        held, due = set(), None
        for _, fix, ts, e, n in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1])):
            if due is not None and ts > due:
                out.update((t, None, *x, "expire") for x in held)
                held = set()
            due = ts + idle
            far = lambda x: max(abs(x[0] - e), abs(x[1] - n))  # noqa: B023,E731
            gone = {x for x in held if far(x) > radius + margin}
            new = {(i, j) for i in range(e - radius, e + radius + 1) for j in range(n - radius, n + radius + 1)} - held
            out.update([(t, fix, *x, "unload") for x in gone] + [(t, fix, *x, "load") for x in new])
            held = held - gone | new
        out.update((t, None, *x, "expire") for x in held)
    return out


def test_idle_tracks_end_and_start_anew(spark, tmp_path):
    rows = [(t, f, ts + (2_000 if f % 100 > 9 else 0) + (5_000 if f % 100 > 17 and t == 1 else 0), e, n) for t, f, ts, e, n in walks(12)]
    want = plain_residency(rows, 2, 1, 600)
    assert Counter(map(tuple, residency.residency_batch(table(spark, rows), 2, 1, 600.0).collect())) == want
    got = streamed(spark, tmp_path, in_files(spark, rows), lambda s: residency.residency_stream(s, 2, 1, "3 hours", 600.0), "idle_out")
    assert Counter(r for r in got if r[0] != END) == want
    assert sum(n for r, n in want.items() if r[4] == "expire") > 60


def test_an_ended_track_leaves_no_state(spark, tmp_path):
    make = lambda s: residency.residency_stream(s, 1, 0, "1 minute", 60.0)
    files = [table(spark, [(1, 1, 0, 0, 0)]), table(spark, [(2, 2, 500, 9, 9)]), table(spark, [(2, 3, 900, 9, 9)]), table(spark, [(END, 4, 10**7, 0, 0)])]
    got = streamed(spark, tmp_path, files, make, "ended")
    assert Counter(r[4] for r in got if r[0] == 1) == {"load": 9, "expire": 9}
    assert Counter(r[4] for r in got if r[0] == 2) == {"load": 18, "expire": 18}
    for name in ("tiles", "waiting"):  # nothing of tracks 1 and 2 is left
        state = spark.read.format("statestore").option("path", str(tmp_path / "ended" / "cp")).option("stateVarName", name).load()
        assert state.where("key.track_id > 0").count() == 0


def test_strips_are_what_a_move_uncovers(spark):
    rng = np.random.default_rng(13)
    pairs = [tuple(map(int, rng.integers(-6, 7, 4))) for _ in range(60)]
    square = lambda e, n, r: {(i, j) for i in range(e - r, e + r + 1) for j in range(n - r, n + r + 1)}
    steps = spark.createDataFrame([(k, 0, k, *p) for k, p in enumerate(pairs)], "track_id long, part long, k int, te int, tn int, pe int, pn int")
    got = Counter((r["k"], r["ei"], r["ni"]) for r in residency.strips(steps, 3).collect())
    want = Counter((k, *t) for k, (a, b, c, d) in enumerate(pairs) for t in square(a, b, 3) - square(c, d, 3))
    assert got == want
    assert all(sorted(tracks.entering((a, b), (c, d), 3)) == sorted(square(a, b, 3) - square(c, d, 3)) for a, b, c, d in pairs)
    # A walk of single steps at a reach of 50 makes rows for strips, not for squares of 10,201 tiles.
    walk = spark.createDataFrame([(1, k, k, k, 0) for k in range(40)], "track_id long, fix_id long, ts int, te int, tn int")
    rows = residency.stays(residency.moves(walk), 50)
    assert rows.count() == 101 * 101 + 39 * 101


def test_handoff_stream_ends_too(spark, tmp_path):
    schema = "track_id long, event_id long, ts timestamp, kind string, a int, b int"
    events = [("fix", 0, 0), *(("tile", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)), ("fix", 6, 0), ("chunk", -1, -1), ("chunk", 0, 0), ("fix", 40, 0)]
    rows = [(5, 100 + k, 60 * k, *e) for k, e in enumerate(events)]
    files = [table(spark, rows[1::2], schema), table(spark, rows[::2], schema), table(spark, [(END, 0, 10**7, "fix", 0, 0)], schema)]
    got = streamed(spark, tmp_path, files, lambda s: residency.handoff_stream(s, 1, 1, 6, 2, "1 hour", 3_600.0), "hand")
    batch = Counter(map(tuple, residency.handoff_batch(table(spark, rows, schema), 1, 1, 6, 2).collect()))
    own = Counter(r for r in got if r[0] == 5)
    assert Counter({r: n for r, n in own.items() if r[5] != "expire"}) == batch
    still = Counter()
    for (_, _, kind, a, b, action), n in batch.items():
        still[kind, a, b] += n if action == "load" else -n
    assert {r[2:5] for r in own if r[5] == "expire"} == {k for k, n in still.items() if n}


V = "vertex_id long, ei int, ni int, prow int, pcol int, ts timestamp"
T = "ei int, ni int, prow int, pcol int, h double, ts timestamp"


def draped(spark, tmp_path, batches, name, idle_ms=10**12):
    """``batches``: (vertices, terrain) of each batch, in order; both streams read one file a batch."""
    for v, t in batches:
        for side, rows, schema in (("v", v, V), ("t", t, T)):
            table(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / side))
    v, t = (spark.readStream.schema(table(spark, [], s).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / side)) for side, s in (("v", V), ("t", T)))
    q = tracks.drape_stream(v, t, 8, "10 seconds", idle_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    out = {}
    for r in spark.table(name).collect():
        out.setdefault(r["vertex_id"], []).append((r["h"], r["how"]))
    return out


def test_draping_by_region(spark, tmp_path):
    batches = [
        ([(1, 0, 0, 0, 0, 1)], [(0, 0, 0, 0, 50.0, 0), (0, 0, 0, 1, 70.0, 0)]),  # terrain is there
        ([(2, 0, 0, 0, 1, 1_000), (3, 0, 0, 9, 9, 1_000)], []),  # long after, it still is; vertex 3 has none: the mean of 50 and 70
        ([(4, 1, 1, 0, 0, 1_001)], []),  # tile (1, 1): its first failure
        ([], [(7, 7, 0, 0, 1.0, 1_002)]),  # terrain elsewhere in the region: the second
        ([], [(7, 7, 0, 1, 1.0, 1_003)]),
        ([], [(7, 7, 0, 2, 1.0, 1_004)]),  # the fourth: the last known height
        ([], [(1, 1, 0, 0, 90.0, 1_005), (0, 0, 9, 9, 30.0, 1_005)]),  # and then their own terrain
        ([(5, 20, 20, 0, 0, 1_006)], []),  # another region knows no height at all
    ]
    got = draped(spark, tmp_path, batches, "regions")
    assert got[1] == [(50.0, "terrain")] and got[2] == [(70.0, "terrain")]
    assert got[3] == [(60.0, "mean"), (30.0, "terrain")]
    assert got[4] == [(60.0, "last"), (90.0, "terrain")]
    assert 5 not in got and not any(math.isnan(h) for v in got.values() for h, _ in v)


def test_an_idle_region_forgets_its_terrain(spark, tmp_path):
    batches = [([], [(0, 0, 0, 0, 50.0, 0)]), ([(1, 0, 0, 0, 0, 5)], []), ([(9, 80, 80, 0, 0, 10_000)], []), ([(2, 0, 0, 0, 0, 10_001)], [])]
    got = draped(spark, tmp_path, batches, "forgets", idle_ms=60_000)
    assert got == {1: [(50.0, "terrain")]}

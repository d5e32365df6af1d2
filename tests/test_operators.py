"""Invariants of retention, listings, garbage collection, state, schedules, health."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from packlake.operators import files, health, legacy, listing, retention, schedule, state, store, verify
from packlake.schemas import MILESTONE_DAYS

NOW = datetime(2026, 8, 28, 12)


def aged(spark, ages):
    return spark.createDataFrame([("j", f"n{i:03}", NOW - timedelta(days=a), 1) for i, a in enumerate(ages)], "job string, name string, created timestamp_ntz, size bigint")


def ages_of(df, ages):
    return sorted(ages[int(r["name"][1:])] for r in df.collect())


def plain_bucket(days):
    """By counting the limits an age has passed, the years one by one."""
    limits = list(MILESTONE_DAYS)
    while limits[-1] <= days:
        limits.append(limits[-1] + 365)
    passed = sum(days >= x for x in limits)
    return passed - 1 if passed else None


def test_milestone_buckets(spark):
    days = sorted({x + d for x in (*MILESTONE_DAYS, 500, 1100, 2555, 4000) for d in (-2, 0, 3)} | {0})
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d bigint").orderBy("d").select(retention.bucket(F.col("d"))).collect()]
    assert got == [plain_bucket(d) for d in days]


def test_keepers_and_removals(spark):
    rng = random.Random(17)
    for _ in range(3):
        ages = sorted(rng.sample(range(1500), 25))
        keepers = sorted({max(x for x in ages if plain_bucket(x) == b) for b in map(plain_bucket, ages) if b is not None})
        rest = [x for x in ages if x not in keepers]
        assert ages_of(retention.milestone_keepers(aged(spark, ages), NOW), ages) == keepers
        assert ages_of(retention.removals_by_count(aged(spark, ages), NOW, 4), ages) == rest[4:]
        assert ages_of(retention.removals_by_age(aged(spark, ages), NOW, 45 * 86_400), ages) == [x for x in rest if x > 45]


def test_list_sized_counts_what_is_new(spark):
    snaps = spark.createDataFrame([("j", "a", NOW - timedelta(3), 1), ("j", "b", NOW - timedelta(2), 1), ("j", "c", NOW - timedelta(1), 1), ("k", "d", NOW, 1)], "job string, name string, created timestamp_ntz, size bigint")
    chunks = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, "x", 5), ("a", 3, "y", 7), ("b", 1, "y", 7), ("c", 1, "x", 5)], "name string, seq int, chunk string, size bigint")
    index = spark.createDataFrame([("p1", "x", 3), ("p2", "x", 4)], "pack string, chunk string, stored bigint")
    got = {r["name"]: (r["new_size"], r["new_stored"]) for r in listing.list_sized_stored(snaps, chunks, index).collect()}
    # a chunk that vanished is new again; an unknown chunk makes the stored size unknown; nothing new is 0
    assert got == {"a": (12, None), "b": (0, 0), "c": (5, 3), "d": (0, 0)}


def test_shrunk(spark):
    for sizes, hit in (([40, 100], 1), ([60, 100], 0), ([40], 0)):
        rows = [("j", f"n{i}", NOW - timedelta(hours=i), s) for i, s in enumerate(sizes)]
        assert listing.shrunk(spark.createDataFrame(rows, "job string, name string, created timestamp_ntz, size bigint")).count() == hit


def test_garbage_collection(spark):
    entries = spark.createDataFrame([("p1", "a", 10), ("p1", "b", 90), ("p2", "c", 80), ("p2", "d", 20), ("p3", "e", 5), ("p4", "c", 80)], "pack string, chunk string, stored bigint")
    live = spark.createDataFrame([("a",), ("c",)], "chunk string")
    plan = {r["pack"]: r["verdict"] for r in store.gc_plan(entries, live).collect()}
    assert plan == {"p1": "sparse", "p2": "keep", "p3": "dead", "p4": "dead"}
    assert [tuple(r) for r in store.repack_moves(entries, live, store.gc_plan(entries, live)).select("chunk", "pack").collect()] == [("a", "p1")]
    after = {tuple(r) for r in store.collect_garbage(entries, live, F.lit("new")).select("pack", "chunk").collect()}
    assert after == {("p2", "c"), ("p2", "d"), ("new", "a")}


def test_young_packs_stay(spark):
    packs = spark.createDataFrame([("old", NOW - timedelta(hours=2)), ("edge", NOW - timedelta(hours=1)), ("new", NOW)], "pack string, modified timestamp_ntz")
    assert [r["pack"] for r in store.old_enough(packs, F.lit(NOW).cast("timestamp_ntz")).collect()] == ["old"]


def test_pack_assignment_closes_after_the_filling_chunk(spark):
    rows = spark.createDataFrame([("d", i, 6) for i in range(7)] + [("e", 0, 100), ("e", 1, 1)], "destination string, seq bigint, stored bigint")
    got = sorted((r["destination"], r["seq"], r["pack_no"]) for r in store.assign_packs(rows, target=10).collect())
    assert [g[2] for g in got] == [0, 0, 1, 1, 2, 2, 3, 0, 1]


def test_fan_out(spark):
    stream = spark.createDataFrame([("a", "Data"), ("b", "Reference")], "chunk string, tag string")
    places = spark.createDataFrame([("x",), ("y",)], "destination string")
    held = spark.createDataFrame([("x", "a"), ("y", "b")], "destination string, chunk string")
    put, failed = store.fan_out(stream, places, held)
    assert [tuple(r) for r in put.collect()] == [("y", "a")] and [tuple(r) for r in failed.collect()] == [("x", "b")]
    assert store.known_everywhere(held).count() == 0


def test_changed_paths(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    changes = files.changed_paths(t([("a", "1"), ("b", "1"), ("d", "1")]), t([("a", "1"), ("b", "2"), ("c", "1")]))
    assert sorted(r["path"] for r in changes.collect()) == ["b", "c", "d"]
    row = files.changed_summary(changes, 2).first()
    assert (row["total"], row["paths"]) == (3, ["b", "c"])


def test_hard_links(spark):
    rows = spark.createDataFrame([("b", 1, 9, 2), ("a", 1, 9, 2), ("c", 1, 8, 1), ("d", 2, 9, 2)], "path string, dev int, ino int, nlink int")
    assert [tuple(r) for r in files.hardlink_targets(rows).collect()] == [("b", "a")]


RUNS = "run_id string, job string, archive_name string, size bigint, created_at bigint, completed_at bigint"
DELIVERIES = "run_id string, destination string, delivered boolean, attempts int, next_retry bigint, last_error string"


def test_delivery_life(spark):
    run = spark.createDataFrame([("r", ["/first", "/second", "/third"])], "run_id string, destinations array<string>")
    results = spark.createDataFrame([("r", "/first", True, None), ("r", "/second", False, "offline")], "run_id string, destination string, ok boolean, error string")
    d = state.registered(run, results, F.lit(1000).cast("bigint"))
    got = {r["destination"]: tuple(r)[2:] for r in d.collect()}
    assert got == {"/first": (True, 1, None, None), "/second": (False, 1, 1060, "offline"), "/third": (False, 0, 1000, None)}
    due = lambda at: {r["destination"] for r in state.due(d, F.lit(at)).collect()}
    assert due(1059) == {"/third"} and due(1060) == {"/second", "/third"}
    runs = spark.createDataFrame([("r", "j", "a", 12, 900, None), ("lone", "k", "b", 1, 901, None)], RUNS)
    assert {r["run_id"]: r["pending"] for r in state.status(runs, d).collect()} == {"r": 2, "lone": 0}
    assert [r["run_id"] for r in state.ready(runs, d).collect()] == ["lone"]
    again = spark.createDataFrame([("r", "/second", False, "offline"), ("r", "/third", True, None), ("r", "/gone", True, None)], "run_id string, destination string, ok boolean, error string")
    d2 = state.marked(d, again, F.lit(1060).cast("bigint"))
    got = {r["destination"]: (r["delivered"], r["attempts"], r["next_retry"]) for r in d2.collect()}
    assert got == {"/first": (True, 1, None), "/second": (False, 2, 1360), "/third": (True, 1, 1000)}
    done = state.completed(runs, state.marked(d2, again.withColumn("ok", F.lit(True)), F.lit(2000).cast("bigint")), F.lit(2000).cast("bigint"))
    assert {r["run_id"]: r["completed_at"] for r in done.collect()} == {"r": 2000, "lone": 2000}
    left, _ = state.purged(done, d2, F.lit(2000))
    assert left.count() == 2 and state.purged(done, d2, F.lit(2001))[0].count() == 0


def test_forget_and_rename(spark):
    runs = spark.createDataFrame([("r", "old", "old-x", 1, 1, None), ("s", "old", "old-y", 1, 1, 5), ("t", "oldest", "z", 1, 1, None)], RUNS)
    deliveries = spark.createDataFrame([("r", "/b/old", False, 0, 1, None), ("t", "/b/old", False, 0, 1, None)], DELIVERIES)
    kept, open_ = state.forgotten(runs, deliveries, "old")
    assert {r["run_id"] for r in kept.collect()} == {"s", "t"} and open_.count() == 1
    plan = spark.createDataFrame([("old", 7)], "job string, last bigint")
    moves = spark.createDataFrame([("/b/old", "/b/new")], "destination string, target string")
    moved, to, copied = state.renamed_job(runs, deliveries, plan, "old", "new", moves)
    assert sorted(r["job"] for r in moved.collect()) == ["new", "new", "oldest"]
    assert {r["run_id"]: r["destination"] for r in to.collect()} == {"r": "/b/new", "t": "/b/old"}
    assert {r["job"] for r in copied.collect()} == {"old", "new"}
    assert state.blocked_rename(runs, deliveries, "old").first()[0] and not state.blocked_rename(runs, deliveries, "x").first()[0]


def test_slots(spark):
    now = datetime(2026, 7, 17, 12, 45)
    slots = schedule.slot_table(spark, [("h", "0 * * * *"), ("d", "0 2 * * *"), ("n", "0 2 * * *")], now)
    last = spark.createDataFrame([("h", datetime(2026, 7, 17, 3)), ("d", datetime(2026, 7, 17, 2))], "job string, last timestamp_ntz")
    open_ = schedule.unhandled(slots, last)
    assert {r["job"]: r["slot"].hour for r in open_.collect()} == {"h": 12, "n": 2}
    held = spark.createDataFrame([("h", datetime(2026, 7, 17, 12), now + timedelta(minutes=1)), ("n", datetime(2026, 7, 16, 2), now + timedelta(minutes=1))], "job string, slot timestamp_ntz, next_retry timestamp_ntz")
    at = F.lit(now).cast("timestamp_ntz")
    assert {r["job"]: r["due"] for r in schedule.due(open_, held, at).collect()} == {"h": False, "n": True}


def test_health(spark):
    day, now = 86_400, F.lit(100 * 86_400)
    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    places = spark.createDataFrame([("a", "/x"), ("b", "/y")], "job string, destination string")
    seen = spark.createDataFrame([("/x", 91 * day), ("/y", 93 * day)], "destination string, at bigint")
    slots = spark.createDataFrame([("b", 100 * day - 3601)], "job string, slot bigint")
    none = spark.createDataFrame([], "job string, last bigint")
    failures = spark.createDataFrame([("/y", "b-20260717T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4", "bad", 5)], "destination string, archive string, error string, at bigint")
    found = [health.overdue(places, seen, now), health.missed(slots, none, now, busy=False), health.import_failed(jobs, failures)]
    got = {r["job"]: (r["healthy"], r["problems"]) for r in health.report(jobs, found).collect()}
    assert got["a"] == (False, ["verification overdue: /x"]) and len(got["b"][1]) == 2
    assert health.missed(slots, none, now, busy=True).count() == 0
    order = places.select("destination", F.lit(1).alias("position"))
    assert [r[0] for r in health.first_to_verify(order, seen, now).collect()] == ["/x"]


def test_check_and_repair(spark):
    entries = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "b"), ("p3", "c")], "pack string, chunk string")
    chunks = spark.createDataFrame([("s1", "b"), ("s2", "a"), ("s2", "c"), ("s3", "c")], "name string, chunk string")
    packs, damaged = entries.select("pack").distinct(), spark.createDataFrame([("p1",)], "pack string")
    found = verify.findings(entries, damaged, entries.limit(0), chunks, spark.createDataFrame([("s3",)], "name string"))
    assert {r["kind"]: r["items"] for r in verify.listed(found).collect()} == {"intact": ["s1"], "damaged_packs": ["p1"], "bad_chunks": ["a"], "bad_recipes": ["s3"], "incomplete": ["s2"]}
    row = verify.summary(packs, found).first()
    assert row["packs"] == 3 and row["incomplete"] == 1 and not row["clean"]
    lone, safe = verify.rehomed(entries, damaged)
    assert [tuple(r) for r in lone.collect()] == [("p1", "a")] and safe.count() == 0
    pieces = spark.createDataFrame([("f", i, i >= n) for n, f in () for i in range(4)] + [("f0", 0, True), ("f1", 0, False), ("f2", 0, False), ("f2", 1, False), ("f3", 0, False), ("f3", 1, False), ("f3", 2, False)], "file string, i int, good boolean")
    assert {r["file"]: r["verdict"] for r in verify.pieces_damaged(pieces, F.col("good")).collect()} == {"f0": "ok", "f1": "repaired", "f2": "repaired", "f3": "lost"}


def test_import_queue(spark):
    name = lambda job, day: f"{job}-202607{day:02}T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4"
    rows = [("/x", name("photos", 3)), ("/y", name("photos", 3)), ("/x", name("photos-raw", 2)), ("/x", "junk.txt")]
    found = legacy.archives(spark.createDataFrame(rows, "destination string, archive string"))
    failed = legacy.recent_failures(spark.createDataFrame([("/x", name("photos", 3), "e", 99)], "destination string, archive string, error string, at bigint"), F.lit(100))
    got = [(r["archive"], r["destinations"]) for r in legacy.in_order(legacy.import_queue(found, failed)).collect()]
    assert got == [(name("photos-raw", 2), ["/x"]), (name("photos", 3), ["/y"])]
    assert {r["job"] for r in found.collect()} == {"photos", "photos-raw"}


def test_progress_and_events(spark):
    from packlake.functions import events

    rows = spark.createDataFrame([("r", i, 4) for i in range(7)] + [("s", 0, 100)], "run_id string, seq int, size bigint")
    assert sorted(tuple(r) for r in store.progress(rows, step=10).collect()) == [("r", 2, 12), ("r", 5, 24), ("s", 0, 100)]
    line = spark.createDataFrame([("r", 5)], "job string, bytes bigint").select(events.event("progress", job=F.col("job"), bytes=F.col("bytes")).alias("value"), events.envelope(F.struct("job")).alias("ok"), events.envelope(F.struct("job"), F.lit("bad")).alias("bad"))
    got = line.first()
    assert got["value"] == '{"event":"progress","job":"r","bytes":5}' and got["ok"] == '{"ok":true,"data":{"job":"r"}}' and got["bad"] == '{"ok":false,"error":"bad"}'
    assert [tuple(r) for r in events.parsed(line, "event string, job string, error string").collect()] == [("progress", "r", None)]
    flags = spark.sql("select 1").select(*[events.reloads(F.lit(k), F.array(*map(F.lit, p)).cast("array<string>"), F.lit("c")) for k, p in (("modify", ["c"]), ("modify", []), ("modify", ["x"]), ("access", ["c"]))]).first()
    assert list(flags) == [True, True, False, False]

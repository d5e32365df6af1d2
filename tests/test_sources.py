"""The file source, configuration, the store's tables and streams."""

import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packlake.operators import files
from packlake.plans import catalog
from packlake.schemas import IMPORT_FAILURE
from packlake.sources import archive, config, endpoints, filesystem
from packlake.sources.state import State
from packlake.sources.tables import TABLES, Store
from packlake.sources.versions import Changed
from packlake.streaming import loops
from test_functions import noise

CONFIG = """
[[job]]
name = "docs"
source = "/home/me/docs"
destinations = ["/mnt/a/docs", "ssh://me@pc1/mnt/b"]
cron = "0 2 * * *"
retention = { age = "6w" }
exclude = ["*.tmp"]
"""


def test_scan(spark, tmp_path):
    for name, data in (("keep.txt", b"1"), ("nested/deep.txt", b"22"), ("skip.tmp", b"3"), ("cache/x", b"4")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link").symlink_to("keep.txt")
    os.mkfifo(tmp_path / "pipe")
    rows = {r["path"]: r for r in filesystem.scan(spark, str(tmp_path), ["*.tmp", "cache/"]).collect()}
    assert set(rows) == {"keep.txt", "nested", "nested/deep.txt", "link", "pipe"}
    assert rows["link"]["link_target"] == "keep.txt" and rows["pipe"]["disposition"] == "special" and rows["nested/deep.txt"]["len"] == 2
    prints = filesystem.scan(spark, str(tmp_path)).where("disposition = 'stored'").select("path", files.fingerprint().alias("fp"))
    before = {r["path"]: r["fp"] for r in prints.collect()}
    (tmp_path / "keep.txt").write_bytes(b"changed")
    after = {r["path"]: r["fp"] for r in prints.collect()}
    assert [p for p in before if before[p] != after[p]] == ["keep.txt"]
    assert {r["path"]: bytes(r["bytes"]) for r in filesystem.contents(spark, str(tmp_path / "nested")).collect()} == {"deep.txt": b"22"}
    with pytest.raises(Exception, match="symbolic link"):
        filesystem.scan(spark, str(tmp_path / "link")).collect()


def test_scan_deals_deep_folders(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"one/two/d{i % 5}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"one/two/d{i % 5}/f{i}.{'tmp' if i % 7 == 0 else 'txt'}").write_bytes(bytes(i))
    (tmp_path / "one/skipped/x").mkdir(parents=True)
    for tasks in (1, 2, 16):
        reader = filesystem.Reader({"root": str(tmp_path), "exclude": "*.tmp\nskipped/", "tasks": str(tasks)})
        rows = [r[0] for part in reader.partitions() for r in reader.read(part)]
        want = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.suffix != ".tmp" and "skipped" not in p.parts]
        assert sorted(rows) == sorted(want)
    assert len([p for p in filesystem.Reader({"root": str(tmp_path)}).partitions() if p.names]) == 16


def test_endpoints(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "link").symlink_to("src")
    (tmp_path / "file").write_text("x")
    job = lambda n, source, *places: config.Job(n, source, list(places), "0 2 * * *")
    asked = []
    jobs = [
        job("good", f"{tmp_path}/src", f"{tmp_path}/new/here", f"file://{tmp_path}/as-uri", "ssh://u@h:22/a", "ssh://u@h:22/b", "ssh://u@other/c"),
        job("bad", f"{tmp_path}/link", f"{tmp_path}/file"),
        job("gone", f"{tmp_path}/none", f"{tmp_path}/new/here"),
    ]
    found = endpoints.problems(spark, jobs, lambda place: asked.append(place) or ("no answer" if "other" in place else None))
    assert asked == ["ssh://u@h:22/a", "ssh://u@other/c"]
    assert [(j, p.rsplit("/", 1)[1]) for j, p, _ in found] == [("good", "c"), ("bad", "link"), ("bad", "file"), ("gone", "none")]
    assert (tmp_path / "new/here").is_dir() and not list((tmp_path / "new/here").iterdir())
    # moves go together or not at all
    (tmp_path / "x/docs").mkdir(parents=True)
    (tmp_path / "y/docs").mkdir(parents=True)
    moves = [(f"{tmp_path}/{d}/docs", f"{tmp_path}/{d}/papers") for d in "xyz"]
    (tmp_path / "y/papers").mkdir()
    with pytest.raises(ValueError, match="such a folder"):
        endpoints.move(spark, moves)
    assert (tmp_path / "x/docs").is_dir()
    (tmp_path / "y/papers").rmdir()
    endpoints.move(spark, moves)
    assert (tmp_path / "x/papers").is_dir() and (tmp_path / "y/papers").is_dir() and not (tmp_path / "x/docs").exists()


def test_a_loop_outlives_errors():
    log, ticks = [], iter(range(4))

    def step():
        log.append(tick := next(ticks))
        if tick % 2:
            raise OSError(f"tick {tick}")

    loops.kept_running(step, lambda e: log.append(str(e)), lambda: len(log) >= 6, sleep=lambda s: log.append(s) if s != 60 else None)
    assert log == [0, 1, "tick 1", 2, 3, "tick 3"]


def test_config(spark):
    jobs = config.parse(CONFIG)
    assert jobs[0].age_seconds == 6 * 604_800 and config.job_table(spark, jobs).first()["exclude"] == ["*.tmp"]
    for old, new in (('"docs"', '"a/b"'), ("/mnt/a/docs", "/home/me/docs/x"), ('age = "6w"', 'age = "6w", count = 1'), ("0 2 * * *", "0 2 * *"), ("exclude", "excluded")):
        with pytest.raises(ValueError):
            config.parse(CONFIG.replace(old, new))
    with pytest.raises(ValueError, match="2 times"):
        config.parse(CONFIG + CONFIG)
    with pytest.raises(ValueError, match="unknown job"):
        config.find(jobs, "x")
    changed, moves = config.renamed(jobs, "docs", "papers")
    assert moves == [("/mnt/a/docs", "/mnt/a/papers")] and changed[0].name == "papers"
    assert config.reload("/nonexistent", jobs) is jobs


def test_store_round_trip(spark, tmp_path):
    now = datetime(2026, 7, 17, 2)
    small = {"least": 256, "average": 1024, "most": 4096, "target": 20_000}
    store, peer = Store(spark, f"file://{tmp_path}/a", **small), Store(spark, f"file://{tmp_path}/b", **small)
    data = {"big.bin": noise(60_000, 1), "zeros.bin": bytes(9000), "small.txt": b"hello"}
    frame = lambda d: spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], "path string, bytes binary")
    first = store.ingest(frame(data), "j", now)
    size = store.table("pack_entry").agg(F.sum("stored")).first()[0]
    assert size < 61_000
    second = store.ingest(frame(data), "j", now + timedelta(days=1))
    assert store.table("pack_entry").agg(F.sum("stored")).first()[0] == size
    data["big.bin"] = data["big.bin"][:100] + b"an insert of some bytes" + data["big.bin"][100:]
    third = store.ingest(frame(data), "j", now + timedelta(days=2))
    assert store.table("pack_entry").agg(F.sum("stored")).first()[0] < size + 10_000
    got = {r["path"]: bytes(r["bytes"]) for r in store.restore(third).collect()}
    assert got == data
    sized = {r["name"]: r["new_size"] for r in store.list_sized().collect()}
    assert sized[second] == 0 and sized[first] > sized[third] > 0
    assert store.check().first()["clean"]

    store.copy_to(peer, third)
    assert archive.export(store, third, f"{tmp_path}/{third}") == 3
    with open(f"{tmp_path}/{third}", "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    (tmp_path / f"{third}.sha256").write_text(f"{digest}  {third}\n")
    old = {r["path"]: bytes(r["bytes"]) for r in archive.unpacked(archive.originals(spark, str(tmp_path))).collect()}
    assert old == data
    (tmp_path / f"{third}.sha256").write_text("00  x\n")
    assert [r["error"] for r in archive.unpacked(archive.originals(spark, str(tmp_path))).collect()] == ["the checksum doesn't match"]
    assert archive.restore_to(peer, third, f"{tmp_path}/out") == 3 and (tmp_path / "out/small.txt").read_bytes() == b"hello"
    assert {r["path"]: bytes(r["bytes"]) for r in peer.restore(third).collect()} == data
    # damage: half of the chunks no longer read as their ids say
    hurt = store.table("chunk_data").withColumn("stored", F.when(F.substring("chunk", 1, 1) < "8", F.encode(F.lit("junk"), "utf-8")).otherwise(F.col("stored"))).withColumn("compressed", F.when(F.substring("chunk", 1, 1) < "8", F.lit(False)).otherwise(F.col("compressed")))
    hurt.write.parquet(f"file://{tmp_path}/hurt")
    store._replace("chunk_data", spark.read.parquet(f"file://{tmp_path}/hurt"))
    assert not store.check().first()["clean"]
    assert {r["path"]: bytes(r["bytes"]) for r in store.restore(third, peer).collect()} == data
    store.repair(peer)
    assert {r["path"]: bytes(r["bytes"]) for r in store.restore(third).collect()} == data

    store.prune(now + timedelta(days=3), count=1)
    assert [r["name"] for r in store.snapshots("j").collect()] == [third]
    assert {r["path"]: bytes(r["bytes"]) for r in store.restore(third).collect()} == data
    live = store.table("snapshot_chunk").select("chunk").distinct().count()
    assert live <= store.table("pack_entry").select("chunk").distinct().count() <= live + 5


@pytest.mark.parametrize("pack", ["0" * 64, "f" * 64])
def test_garbage_collection_keeps_the_copy_that_reads(spark, tmp_path, pack):
    # a damaged copy of every chunk in a pack of a lesser or greater id than the sound ones
    now = datetime(2026, 7, 17, 2)
    store = Store(spark, f"file://{tmp_path}/s", 256, 1024, 4096, 20_000)
    data = noise(30_000, 5)
    name = store.ingest(spark.createDataFrame([("a", bytearray(data))], "path string, bytes binary"), "j", now)
    junk = store.table("chunk_data").withColumns({"pack": F.lit(pack), "folder": F.lit(pack[:2]), "stored": F.encode(F.lit("junk"), "utf-8"), "compressed": F.lit(False)})
    index = store.table("pack_entry").withColumn("pack", F.lit(pack))
    store._add({"chunk_data": junk, "pack_entry": index})
    store.collect_garbage(now + timedelta(days=3))
    assert bytes(store.restore(name).first()["bytes"]) == data
    assert not store.table("pack_entry").where(F.col("pack") == pack).count() and store.check().first()["clean"]


def test_snapshots_keep_what_a_scan_knows(spark, tmp_path):
    source = tmp_path / "source"
    (source / "empty").mkdir(parents=True)
    (source / "deep").mkdir()
    (source / "a.txt").write_bytes(b"text")
    (source / "none.txt").write_bytes(b"")
    (source / "deep/big.bin").write_bytes(noise(30_000, 3))
    os.link(source / "a.txt", source / "b.txt")
    (source / "away").symlink_to("deep/big.bin")
    os.chmod(source / "a.txt", 0o640)
    os.chmod(source / "empty", 0o700)
    os.utime(source / "a.txt", ns=(1, 1_500_000_000_123_456_789))
    store = Store(spark, f"file://{tmp_path}/s", 256, 1024, 4096, 20_000)
    entries, contents = filesystem.scan(spark, str(source)), filesystem.contents(spark, f"file://{source}")
    name = store.ingest(contents.select("path", "bytes"), "j", datetime(2026, 7, 17, 2), entries=entries)
    data = {"a.txt": b"text", "b.txt": b"text", "none.txt": b"", "deep/big.bin": noise(30_000, 3)}
    assert {r["path"]: bytes(r["bytes"]) for r in store.restore(name).collect()} == data
    assert archive.restore_to(store, name, f"{tmp_path}/out") == 4
    out = tmp_path / "out"
    assert {p: (out / p).read_bytes() for p in data} == data and (out / "empty").is_dir() and os.readlink(out / "away") == "deep/big.bin"
    assert os.path.samefile(out / "a.txt", out / "b.txt") and (out / "a.txt").stat().st_mtime_ns == 1_500_000_000_123_456_789
    assert [(out / p).stat().st_mode & 0o777 for p in ("a.txt", "empty")] == [0o640, 0o700]
    assert archive.export(store, name, f"{tmp_path}/{name}") == 4
    rows = {r["path"]: r for r in archive.unpacked(archive.originals(spark, str(tmp_path))).collect()}
    assert {p: bytes(rows[p]["bytes"]) for p in data if rows[p]["hard_target"] is None} == {p: v for p, v in data.items() if p != "b.txt"}
    assert rows["b.txt"]["hard_target"] == "a.txt" and rows["away"]["link_target"] == "deep/big.bin" and rows["empty"]["kind"] == "dir" and rows["a.txt"]["mode"] == 0o640
    # an import is the same snapshot, each store's for itself; damaged copies and odd names are told
    other = Store(spark, f"file://{tmp_path}/o", 256, 1024, 4096, 20_000)
    copies = archive.originals(spark, str(tmp_path))
    bad = copies.select("archive", F.encode(F.lit("junk"), "utf-8").alias("bytes"), F.lit("00").alias("expected"), F.lit(0).alias("position"))
    odd = bad.withColumn("archive", F.lit("x.tar.lz4"))
    both = bad.unionByName(copies.withColumn("position", F.lit(1)).select(*bad.columns)).unionByName(odd)
    assert sorted(archive.import_into([store, other], both)) == sorted([(name, other.root, None), ("x.tar.lz4", store.root, "the name doesn't parse"), ("x.tar.lz4", other.root, "the name doesn't parse")])
    assert {r["path"]: r.asDict(True) for r in other.entries(name).collect()} == {r["path"]: {**r.asDict(True), "mode": r["mode"] & 0o7777} for r in store.entries(name).collect()}
    assert {r["path"]: bytes(r["bytes"]) for r in other.restore(name).collect()} == data and archive.import_into([other], copies) == []
    alone = Store(spark, f"file://{tmp_path}/n", 256, 1024, 4096, 20_000)
    assert archive.import_into([alone], bad) == [(name, alone.root, "the checksum doesn't match")] and not alone.table("snapshot").count()
    # a link that a snapshot brings leads no file out of the folder
    (out / "deep/big.bin").unlink()
    (out / "deep").rmdir()
    (out / "deep").symlink_to(tmp_path)
    with pytest.raises(ValueError, match="outside"):
        archive.restore_to(store, name, str(out))


def test_a_store_changes_in_one_step(spark, tmp_path, monkeypatch):
    now = datetime(2026, 7, 17, 2)
    store = Store(spark, f"file://{tmp_path}/s", 256, 1024, 4096, 20_000)
    frame = lambda seed: spark.createDataFrame([("f", bytearray(noise(90_000, seed)))], "path string, bytes binary")
    state = lambda: {t: store.table(t).count() for t in TABLES}
    first = store.ingest(frame(5), "j", now)
    biggest = store.table("pack_entry").groupBy("pack").agg(F.sum("stored").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert biggest[0] < 20_000 + 4096 and biggest[1] in (4, 5)
    before, commit = state(), Store._commit

    def killed(self, version, parts):
        raise OSError("killed")

    monkeypatch.setattr(Store, "_commit", killed)
    for step in (lambda: store.ingest(frame(6), "j", now), lambda: store.prune(now + timedelta(days=900), count=0)):
        with pytest.raises(OSError, match="killed"):
            step()
        assert state() == before and store.check().first()["clean"]

    # another writer comes first: what is added follows it, what replaces is refused
    def overtaken(self, version, parts):
        monkeypatch.setattr(Store, "_commit", commit)
        Store(spark, store.root, 256, 1024, 4096, 20_000).ingest(frame(7), "other", now)
        commit(self, version, parts)

    monkeypatch.setattr(Store, "_commit", overtaken)
    second = store.ingest(frame(6), "j", now + timedelta(days=1))
    assert store.table("snapshot").count() == 3 and store.check().first()["clean"]
    monkeypatch.setattr(Store, "_commit", overtaken)
    with pytest.raises(Changed):
        store.prune(now + timedelta(days=900), count=1)
    assert store.table("snapshot").count() == 4 and store.check().first()["clean"]
    monkeypatch.undo()
    store.prune(now + timedelta(days=3), seconds=86_400)
    assert {r["name"] for r in store.snapshots("j").collect()} <= {first, second} and store.check().first()["clean"]
    store.vacuum(0)
    listed = {(t, p) for t, parts in store._state()[1].items() for p in parts}
    assert listed == {(t, f.name[5:]) for t in TABLES for f in (tmp_path / "s" / t).iterdir()} and not list((tmp_path / "s/_staging").iterdir())
    assert len([f for f in (tmp_path / "s/_log").iterdir() if f.name[0] != "."]) == 1 and store.check().first()["clean"]


def test_an_index_of_many_parts_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("packlake.sources.tables.MAX_INDEX_FILES", 2)
    store, peer = Store(spark, f"file://{tmp_path}/s", 256, 1024, 4096, 20_000), Store(spark, f"file://{tmp_path}/p", 256, 1024, 4096, 20_000)
    for day in range(3):
        name = store.ingest(spark.createDataFrame([("f", bytearray(noise(9_000, day + 1)))], "path string, bytes binary"), "j", datetime(2026, 7, 17 + day))
    parts = store._state()[1]
    assert len(parts["pack_entry"]) == len(parts["snapshot"]) == 1 and len(parts["chunk_data"]) == 3 and store.check().first()["clean"]
    # damaged bytes are sent nowhere
    store._replace("chunk_data", store.table("chunk_data").withColumn("stored", F.encode(F.lit("junk"), "utf-8")).withColumn("compressed", F.lit(False)))
    with pytest.raises(ValueError, match="whole"):
        store.copy_to(peer, name)
    assert peer.table("snapshot").count() == peer.table("chunk_data").count() == 0


def test_a_pack_heals_itself(spark, tmp_path):
    now = datetime(2026, 7, 17, 2)
    store, data = Store(spark, f"file://{tmp_path}/s", 256, 1024, 4096, 60_000), noise(150_000, 9)
    name = store.ingest(spark.createDataFrame([("f", bytearray(data))], "path string, bytes binary"), "j", now)
    packs = sorted(r["pack"] for r in store.table("pack_entry").select("pack").distinct().collect())
    assert len(packs) == 3 and [r["pack"] for r in store.packs().collect()] == packs and store.table("pack_seal").count() == 3
    rows = store.table("chunk_data").toPandas().sort_values(["pack", "chunk"])
    # some bytes within two pieces of one pack, more than that of another
    few = rows[rows["pack"] == packs[0]]["chunk"].iloc[0]
    many = set(rows[rows["pack"] == packs[1]]["chunk"].iloc[::2])
    broken = lambda x, n: bytes(x[:5]) + bytes(n) + bytes(x[5 + n :])
    rows["stored"] = [broken(x, 100) if c == few or c in many else bytes(x) for c, x in zip(rows["chunk"], rows["stored"], strict=True)]
    schema = "pack string, chunk string, seq bigint, stored binary, size bigint, compressed boolean, folder string"
    store._replace("chunk_data", spark.createDataFrame([tuple(map(lambda v: bytearray(v) if isinstance(v, bytes) else v, r)) for r in rows[[c.split()[0] for c in schema.split(", ")]].values.tolist()], schema))
    assert {r["chunk"] for r in store.damaged().collect()} == {few} | many
    left = store.verify().collect()
    assert {r["item"] for r in left if r["kind"] == "bad_chunks"} == many and {r["item"] for r in left if r["kind"] == "incomplete"} == {name}
    # the lost pack comes back from a peer, and the store is whole again
    peer = Store(spark, f"file://{tmp_path}/p", 256, 1024, 4096, 60_000)
    peer.ingest(spark.createDataFrame([("f", bytearray(data))], "path string, bytes binary"), "j", now)
    assert not store.verify(peer).count() and store.check().first()["clean"]
    assert bytes(store.restore(name).first()["bytes"]) == data
    seals = {r["pack"]: r["length"] for r in store.table("pack_seal").collect()}
    assert seals == {r["pack"]: r["n"] for r in store.table("pack_entry").groupBy("pack").agg(F.sum("stored").alias("n")).collect()}


def test_state_lasts(spark, tmp_path):
    kept = State(spark, f"file://{tmp_path}/state")
    run = lambda i, job: (i, job, f"{job}-20260717T020000Z-00000000-0000-0000-0000-00000000000{i}.tar.lz4", "c", 10, 100 + int(i), None, ["/a", "/b"])
    runs = spark.createDataFrame([run("1", "docs"), run("2", "docs")], "run_id string, job string, archive_name string, checksum string, size bigint, created_at bigint, completed_at bigint, destinations array<string>")
    results = lambda *rows: spark.createDataFrame(list(rows), "run_id string, destination string, ok boolean, error string")
    done = results(("1", "/a", True, None), ("1", "/b", False, "offline"), ("2", "/a", True, None))
    for _ in range(2):  # the same runs again change nothing
        kept.register(runs, done, F.lit(1000))
    rows = {(r["run_id"], r["destination"]): (r["delivered"], r["attempts"], r["next_retry"]) for r in kept.table("delivery").collect()}
    assert rows == {("1", "/a"): (True, 1, None), ("1", "/b"): (False, 1, 1060), ("2", "/a"): (True, 1, None), ("2", "/b"): (False, 0, 1000)}
    with pytest.raises(ValueError, match="still open"):
        kept.rename("docs", "papers")
    again = State(spark, kept.root)
    again.mark(results(("1", "/b", True, None)), F.lit(2000))
    assert {r["run_id"]: r["completed_at"] for r in kept.table("run").collect()} == {"1": 2000, "2": None}
    again.forget("docs")
    assert [r["run_id"] for r in kept.table("run").collect()] == ["1"] and kept.table("delivery").count() == 2
    again.rename("docs", "papers", spark.createDataFrame([("/a", "/c")], "destination string, target string"))
    assert kept.table("run").first()["archive_name"].startswith("papers-") and {r["destination"] for r in kept.table("delivery").collect()} == {"/c", "/b"}
    problems = lambda *x: spark.createDataFrame([(p,) for p in x], "problem string")
    kept.verified("/b", 50, problems("bad", "worse"))
    kept.verified("/b", 60, problems("bad"))
    assert [tuple(r) for r in kept.table("verified").collect()] == [("/b", 60)] and kept.table("verify_problem").count() == 1
    kept.upsert("import_failure", spark.createDataFrame([("/b", "x", "why", 5)], IMPORT_FAILURE))
    kept.upsert("import_failure", spark.createDataFrame([("/b", "x", "again", 6)], IMPORT_FAILURE))
    assert [r["error"] for r in kept.table("import_failure").collect()] == ["again"]
    kept.delete("import_failure", kept.table("import_failure").select("destination", "archive"))
    assert not kept.table("import_failure").count()
    kept.purge(2000 + 31 * 86_400)
    assert not kept.table("run").count() and not kept.table("delivery").count()


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 5, "error" if i % 3 else "click", 0.0, "{}") for i in range(60)]
    spark.createDataFrame(rows, loops.EVENTS).repartition(3).write.parquet(f"{tmp_path}/in/events.parquet")
    stream = lambda: spark.readStream.schema(loops.EVENTS).parquet(f"{tmp_path}/in/events.parquet")
    assert loops.drained(loops.distinct(stream(), ["user_id", "event_type"]), "t_dedup", "append").count() == 10
    counts = {r["job"]: r["failures"] for r in loops.drained(loops.failures(stream(), "user_id", F.col("event_type") == "error"), "t_fail", "complete").collect()}
    assert counts == {k: 8 for k in range(5)}
    seen = []
    loops.each_batch(loops.distinct_within(stream(), ["user_id"], "ts", "10 minutes"), lambda df, n: seen.append(df.count()), f"file://{tmp_path}/c1")
    assert sum(seen) == 5
    flagged = stream().withColumns({"failed": F.col("event_type") == "error", "at": F.unix_timestamp(F.col("ts").cast("timestamp"))})
    out = {}
    loops.each_batch(loops.retries(flagged, "user_id", "failed", "at"), lambda df, n: out.update({r["job"]: r for r in df.collect()}), f"file://{tmp_path}/c2", mode="update")
    assert set(out) == set(range(5)) and all(r["attempts"] in (0, 1, 2) for r in out.values())


def test_gaps_of_half_seconds_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    at, rows = datetime(2024, 1, 1), []
    for i, gap in enumerate([900.5, 901.5, 902.5, 900.500001, 900.499999, 10294.5, 2592000.5, 2592001.5, 0, 900, 901]):
        rows += [(2 * i, at, i, "view", 0.0, "{}"), (2 * i + 1, at + timedelta(microseconds=round(gap * 1_000_000)), i, "view", 0.0, "{}")]
    spark.createDataFrame(rows, loops.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["user_id"], r["gap"]) for r in catalog.QUERIES["stall_gaps"](spark, str(tmp_path)).collect())
    sql = catalog.ORACLE_SQL["stall_gaps"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted((u, g) for u, _, g in duckdb.sql(sql).fetchall())
    assert [g for _, g in got] == [902, 902, 901, 10294, 2592000, 2592002, 901]

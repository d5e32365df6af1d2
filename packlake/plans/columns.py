"""Queries of operators that work on names, locations, files, events and checks,
one at a time, with their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from packlake.functions import codec, events, location, names, parity
from packlake.operators import files, health, legacy, listing, schedule, state, store, verify
from packlake.plans import roles
from packlake.plans.registry import query
from packlake.sources.tables import Store
from packlake.streaming import loops

# -- locations and names

WHERE_SQL = "w AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS place FROM pages)"


@query(rf"""WITH {WHERE_SQL} SELECT page_id, regexp_extract(rtrim(place, '/'), '([^/]*)$', 1) AS folder, regexp_replace(rtrim(place, '/'), '[^/]+$', '') || 'next' AS beside,
rtrim(place, '/') = '/www.ththre.example.net' OR starts_with(place, '/www.ththre.example.net/') AS inside FROM w""")
def folder_names(spark, sf_dir):
    place = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    rows = roles.table(spark, sf_dir, "pages").select("page_id", place.alias("place"))
    own = F.col("place")
    return rows.select("page_id", location.folder_name(own).alias("folder"), location.sibling(own, "next").alias("beside"), location.contains(F.lit("/www.ththre.example.net/"), own).alias("inside"))


@query("""WITH e AS (SELECT 'ssh://u' || s_nationkey || '@h' || s_suppkey % 7 || '.example:22/x/' || s_suppkey AS uri FROM supplier)
SELECT regexp_extract(uri, '@([^:]*)', 1) AS host, regexp_extract(uri, '//([^@]*)', 1) AS "user", 22 AS port, min(uri) AS uri, count(*) AS places FROM e GROUP BY 1, 2, 3""")
def endpoints(spark, sf_dir):
    uri = F.concat(F.lit("ssh://u"), "s_nationkey", F.lit("@h"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".example:22/x/"), "s_suppkey")
    return location.endpoints(roles.table(spark, sf_dir, "supplier").select(uri.alias("uri")))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS id, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN upper(id) ELSE id END, '^[0-9a-f]{64}$') AS sound, substr(id, 1, 2) AS folder, greatest(CAST(ceil(n / 64) AS BIGINT), 2) + greatest(CAST(ceil(n / 64) AS BIGINT), 2) % 2 AS piece,
'sum-' || doc_id AS token FROM d""")
def content_ids(spark, sf_dir):
    found = roles.documents(spark, sf_dir).select("doc_id", names.content_id(F.col("text")).alias("id"), F.octet_length("text").alias("n"))
    said = F.when(F.col("doc_id") % 3 == 0, F.upper("id")).otherwise(F.col("id"))
    line = F.concat(F.lit("  sum-"), "doc_id", F.lit("\t archive.tar "))
    return found.select("doc_id", "id", names.is_content_id(said).alias("sound"), names.pack_folder(F.col("id")).alias("folder"), names.piece_length(F.col("n")).alias("piece"), names.first_token(line).alias("token"))


@query(r"""SELECT c_custkey, '/mnt/a b' || chr(9) || c_custkey || '\' || c_nationkey || '#x' AS mount FROM customer""")
def mount_names(spark, sf_dir):
    escaped = F.concat(F.lit("/mnt/a\\040b\\011"), "c_custkey", F.lit("\\134"), "c_nationkey", F.lit("\\043x"))
    return roles.table(spark, sf_dir, "customer").select("c_custkey", names.unescaped_mount(escaped).alias("mount"))


# -- files

@query("""SELECT doc_id, sha256(concat_ws('|', '4:file', length(n) || ':' || n, '1:1', length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '1:1', '-', '-', '-', '-', '3:420', '1:0', '1:0', '-', '')) AS fingerprint
FROM (SELECT doc_id, CAST(n_chars AS VARCHAR) AS n FROM documents)""")
def fingerprints(spark, sf_dir):
    none = F.lit(None).cast("bigint")
    rows = roles.documents(spark, sf_dir).select(
        "doc_id", F.lit("file").alias("kind"), F.col("n_chars").alias("len"), F.lit(1).alias("dev"), F.col("doc_id").alias("ino"), F.lit(1).alias("nlink"), *[none.alias(c) for c in ("mtime", "mtime_ns", "ctime", "ctime_ns")],
        F.lit(420).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(None).cast("string").alias("link_target"), F.lit(None).cast("array<struct<name:string,value:binary>>").alias("xattrs"),
    )
    return rows.select("doc_id", files.fingerprint().alias("fingerprint"))


@query("""SELECT '/m' || doc_id % 5 || '/' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 NOT IN (3, 4)""")
def outside_mounts(spark, sf_dir):
    k = F.col("doc_id")
    rows = roles.documents(spark, sf_dir).select(F.concat(F.lit("/m"), k % 5, F.lit("/"), k).alias("path"), (k % 2).alias("dev"))
    return files.without_mounts(rows, spark.createDataFrame([("/m3",), ("/m4",), ("/m",)], "mount string"), 0).select("path")


# -- the store

@query(f"WITH s AS (SELECT o_custkey AS job, o_orderkey AS name, o_orderdate AS created FROM orders) SELECT job, name, row_number() OVER (PARTITION BY job ORDER BY created DESC, name DESC) AS place FROM s")  # noqa: F541
def newest_ranked(spark, sf_dir):
    return listing.ranked(roles.snapshots(spark, sf_dir)).select("job", "name", "place")


@query("""WITH RECURSIVE r AS (SELECT l_suppkey AS run_id, CAST(round(l_quantity) AS BIGINT) AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem),
f AS (SELECT run_id, seq, size AS done, CASE WHEN size >= 400 THEN size ELSE 0 END AS told, size >= 400 AS say FROM r WHERE seq = 1
  UNION ALL SELECT r.run_id, r.seq, f.done + r.size, CASE WHEN f.done + r.size - f.told >= 400 THEN f.done + r.size ELSE f.told END, f.done + r.size - f.told >= 400 FROM f JOIN r ON r.run_id = f.run_id AND r.seq = f.seq + 1)
SELECT run_id, seq, done FROM f WHERE say""")
def progress_marks(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = roles.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.row_number().over(order).cast("bigint").alias("seq"), F.round("l_quantity").cast("bigint").alias("size"))
    return store.progress(rows, step=400)


@query(f"""WITH e AS ({roles.ENTRIES_SQL}), b AS (SELECT DISTINCT chunk FROM e WHERE chunk % 5 = 0) SELECT chunk FROM b WHERE chunk NOT IN (SELECT chunk FROM e WHERE pack >= 20)""")
def unrepairable_chunks(spark, sf_dir):
    found = roles.entries(spark, sf_dir)
    return verify.unrepairable(found.where("chunk % 5 = 0").select("chunk").distinct(), found.where("pack >= 20"))


@query(f"""WITH e AS ({roles.ENTRIES_SQL}) SELECT DISTINCT pack FROM e WHERE pack NOT IN (SELECT pack FROM e WHERE chunk % 90 = 0)""")
def unindexed_packs(spark, sf_dir):
    found = roles.entries(spark, sf_dir)
    return store.unindexed(found.select("pack").distinct(), found.where("chunk % 90 = 0"))


# -- state and health

STATE_SQL = f"r AS ({roles.RUNS_SQL}), d AS ({roles.DELIVERIES_SQL})"


@query(f"WITH {STATE_SQL} SELECT run_id, size FROM r WHERE completed_at IS NOT NULL AND job = 7")
def history_of_job(spark, sf_dir):
    return state.history(roles.runs(spark, sf_dir), 7).select("run_id", "size")


@query(f"WITH {STATE_SQL} SELECT count(*) FILTER (r.job = 7) > 0 AS blocked FROM d JOIN r USING (run_id) WHERE NOT delivered")
def rename_blocked(spark, sf_dir):
    return state.blocked_rename(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir), 7)


@query("SELECT user_id AS destination, 'a-' || event_id AS archive FROM events WHERE event_type = 'error' AND epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) < 86400")
def import_failures(spark, sf_dir):
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    failed = roles.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("destination"), F.concat(F.lit("a-"), "event_id").alias("archive"), seconds(F.col("ts")).alias("at"))
    return legacy.recent_failures(failed, seconds(F.expr("timestamp_ntz'2024-01-20 00:00:00'")))


@query("""WITH j AS (SELECT c_custkey AS job, 100000 + c_custkey % 50 * 1000 AS slot, CASE WHEN c_custkey % 3 <> 0 THEN 100000 + c_custkey % 40 * 1000 END AS last, c_nationkey AS destination FROM customer),
a AS (SELECT n_nationkey AS n, 'job-' || n_nationkey || '-20240101T000000Z-00000000-0000-0000-0000-' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') || '.tar.lz4' AS archive FROM nation)
SELECT CAST(job AS VARCHAR) AS job, 'missed its schedule' AS problem FROM j WHERE (last IS NULL OR last < slot) AND 140000 - slot > 3600
UNION ALL SELECT CAST(job AS VARCHAR), destination || ': damaged' FROM j WHERE destination % 6 = 1
UNION ALL SELECT 'job-' || n, 'import failed: ' || archive FROM a WHERE n < 9""")
def health_rules(spark, sf_dir):
    k = F.col("c_custkey")
    jobs = roles.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("job"), (100000 + k % 50 * 1000).alias("slot"), F.when(k % 3 != 0, 100000 + k % 40 * 1000).alias("last"), F.col("c_nationkey").alias("destination")
    )
    damaged = roles.table(spark, sf_dir, "nation").where("n_nationkey % 6 = 1").select(F.col("n_nationkey").alias("destination"), F.lit("damaged").alias("problem"))
    n = F.col("n_nationkey")
    unique = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))
    archive = names.archive_name(F.concat(F.lit("job-"), n), F.expr("timestamp_ntz'2024-01-01 00:00:00'"), unique)
    nations = roles.table(spark, sf_dir, "nation")
    named = nations.where("n_nationkey < 9").select(F.concat(F.lit("job-"), n).alias("job"))
    found = health.missed(jobs.select("job", "slot"), jobs.select("job", "last"), F.lit(140000), busy=False)
    return found.unionByName(health.verify_failed(jobs.select("job", "destination"), damaged)).unionByName(health.import_failed(named, nations.select(archive.alias("archive"))))


@query("""SELECT user_id, least(coalesce(min(CASE WHEN event_type = 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) END), 1706400060), 1706400060) AS at FROM events GROUP BY 1""")
def next_checks(spark, sf_dir):
    due = F.min(F.when(F.col("event_type") == "error", F.unix_timestamp(F.col("ts").cast("timestamp"))))
    return roles.table(spark, sf_dir, "events").groupBy("user_id").agg(schedule.next_check(due, F.lit(1706400000).cast("bigint")).alias("at"))


@query("""WITH v AS (SELECT s_suppkey AS destination, s_suppkey AS position, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 100000 % 2000000 END AS t FROM supplier), s AS (SELECT destination, position, coalesce(t, 2000000) AS t FROM v),
n AS (SELECT destination FROM s WHERE 2000000 - t >= 604800 ORDER BY position LIMIT 1)
SELECT destination, CASE WHEN destination IN (SELECT destination FROM n) THEN 2000000 ELSE t END AS "at", destination IN (SELECT destination FROM n) AS verify FROM s""")
def maintenance_step(spark, sf_dir):
    k = F.col("s_suppkey")
    keys = roles.table(spark, sf_dir, "supplier").select(k.alias("destination"), k.alias("position"), F.when(k % 4 != 0, k * 100000 % 2000000).alias("at"))
    return health.maintenance_step(keys.select("destination", "position"), keys.where("at is not null").select("destination", "at"), F.lit(2000000).cast("bigint"))


@query("""SELECT o_orderkey, lpad(CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR), 12, ' ') AS size, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE 'unknown' END AS completed FROM orders""")
def text_report(spark, sf_dir):
    rows = roles.snapshots(spark, sf_dir)
    return rows.select(F.col("name").alias("o_orderkey"), names.right_aligned(F.col("size")).alias("size"), names.rfc3339(F.col("created")).alias("created"), F.coalesce(names.rfc3339(F.when(F.col("done"), F.col("created"))), F.lit("unknown")).alias("completed"))


# -- codecs and events

@query("SELECT doc_id, octet_length(encode(text)) AS size, true AS smaller, true AS same FROM documents")
def lz4_round_trip(spark, sf_dir):
    rows = roles.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("bytes"))
    packed = rows.select("doc_id", "bytes", F.octet_length("bytes").cast("bigint").alias("size"), codec.compress(F.col("bytes")).alias("form"))
    back = codec.decompress(F.col("form.stored"), F.col("size"), F.col("form.compressed"))
    return packed.select("doc_id", "size", (F.octet_length("form.stored") <= F.col("size")).alias("smaller"), (back == F.col("bytes")).alias("same"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE sha256(text) END AS healed FROM documents")
def parity_healed(spark, sf_dir):
    rows = roles.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("bytes"))
    hurt = lambda x: F.col("doc_id") * x % 66
    third = F.when(F.col("doc_id") % 9 == 0, F.lit(3)).otherwise(F.lit(2))
    return rows.select("doc_id", F.sha2(parity.healed("bytes", hurt(7), third), 256).alias("healed"))


@query("SELECT event_id, user_id % 3 <> 0 AS ok, CASE WHEN user_id % 3 = 0 THEN 'offline' END AS error, CASE WHEN user_id % 3 <> 0 THEN event_type END AS kind FROM events")
def result_envelope(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "events")
    error = F.when(F.col("user_id") % 3 == 0, F.lit("offline"))
    lines = rows.select("event_id", events.envelope(F.struct("event_type"), error).alias("line"))
    one = F.from_json("line", "ok boolean, error string, data struct<event_type:string>")
    return lines.select("event_id", one.alias("e")).select("event_id", "e.ok", "e.error", F.col("e.data.event_type").alias("kind"))


@query("SELECT event_id, event_type IN ('click', 'view', 'error') AND (user_id % 4 = 0 OR user_id % 4 = 1) AS reload FROM events")
def config_reloads(spark, sf_dir):
    k = F.col("user_id") % 4
    kind = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "error", "remove").otherwise("access")
    paths = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("/other"), F.lit("/jobs.toml"))).otherwise(F.array(F.lit("/other")))
    return roles.table(spark, sf_dir, "events").select("event_id", events.reloads(kind, paths, F.lit("/jobs.toml")).alias("reload"))


# -- a store from end to end

STORED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS content FROM documents"


def _stored(spark, sf_dir):
    """A new store with all documents as one snapshot, and its name."""
    held = Store(spark, f"{loops.shared_root(spark)}/store-{uuid.uuid4().hex}")
    docs = roles.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("bytes"))
    return held, held.ingest(docs, "documents", datetime(2026, 7, 17, 2))


def _contents(held, name):
    return held.restore(name).select(F.col("path").cast("bigint").alias("doc_id"), F.sha2("bytes", 256).alias("content"))


@query(STORED_SQL)
def stored_documents(spark, sf_dir):
    return _contents(*_stored(spark, sf_dir))


@query(STORED_SQL)
def copied_documents(spark, sf_dir):
    held, name = _stored(spark, sf_dir)
    other = Store(spark, f"{held.root}-copy")
    held.copy_to(other, name)
    return _contents(other, name)


@query(STORED_SQL)
def healed_documents(spark, sf_dir):
    """The smallest chunk of each pack is overwritten; the packs heal themselves."""
    held, name = _stored(spark, sf_dir)
    least = held.table("pack_entry").groupBy("pack").agg(F.min_by("chunk", F.struct("stored", "chunk")).alias("hurt"))
    data = held.table("chunk_data")
    lost = F.encode(F.lpad(F.lit(""), F.octet_length("stored"), F.lit("?")), "utf-8")
    damaged = data.join(least, "pack").withColumn("stored", F.when(F.col("chunk") == F.col("hurt"), lost).otherwise(F.col("stored")))
    held._replace("chunk_data", damaged.select(*data.columns))
    held.verify()
    return _contents(held, name)

"""The queries of the engine by name, with their SQL.

Each query puts the driver's tables into their roles, applies operators and
selects columns; the SQL says the same in one statement.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from packlake.functions import chunking, codec, durations, events, location, names, parity
from packlake.functions.ignore import excluded
from packlake.operators import files, health, legacy, listing, retention, schedule, state, store, verify
from packlake.operators.sizes import one_row
from packlake.plans import columns, roles  # noqa: F401  columns registers queries
from packlake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from packlake.streaming import loops

NOW = datetime(2001, 8, 28, 12)

SNAPSHOTS_SQL = "SELECT o_custkey AS job, o_orderkey AS name, o_orderdate AS created, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderstatus = 'F' AS done FROM orders"
OWN_SQL = "SELECT l_orderkey AS name, l_partkey AS chunk, min(CAST(round(l_quantity) AS BIGINT)) AS size FROM lineitem GROUP BY 1, 2"
NEW_SQL = f"""s AS ({SNAPSHOTS_SQL}), p AS (SELECT *, lag(name) OVER (PARTITION BY job ORDER BY created, name) AS previous FROM s),
c AS ({OWN_SQL}), n AS (
  SELECT p.name, c.chunk, c.size FROM p JOIN c USING (name) WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.name = p.previous AND b.chunk = c.chunk))"""


# -- listings

@query(f"WITH {NEW_SQL} SELECT s.job, s.name, s.created, s.size, CAST(coalesce(sum(n.size), 0) AS BIGINT) AS new_size FROM s LEFT JOIN n USING (name) GROUP BY ALL")
def list_sized(spark, sf_dir):
    out = listing.list_sized(roles.snapshots(spark, sf_dir), roles.chunks(spark, sf_dir))
    return out.select("job", "name", "created", "size", "new_size")


@query(f"""WITH {NEW_SQL}, e AS ({roles.ENTRIES_SQL}), i AS (SELECT chunk, min_by(stored, pack) AS stored FROM e WHERE chunk % 97 <> 0 GROUP BY chunk)
SELECT s.name, CAST(coalesce(sum(n.size), 0) AS BIGINT) AS new_size,
  CASE WHEN count(n.chunk) = count(i.chunk) THEN CAST(coalesce(sum(i.stored), 0) AS BIGINT) ELSE -1 END AS new_stored
FROM s LEFT JOIN n USING (name) LEFT JOIN i ON i.chunk = n.chunk GROUP BY s.name""")
def list_sized_stored(spark, sf_dir):
    index = roles.entries(spark, sf_dir).where("chunk % 97 <> 0")
    out = listing.list_sized_stored(roles.snapshots(spark, sf_dir), roles.chunks(spark, sf_dir), index)
    return out.select("name", "new_size", F.coalesce("new_stored", F.lit(-1).cast("bigint")).alias("new_stored"))


@query(f"""WITH s AS ({SNAPSHOTS_SQL}), r AS (SELECT job, name, size, row_number() OVER w AS rn, lead(size) OVER w AS previous_size FROM s WINDOW w AS (PARTITION BY job ORDER BY created DESC, name DESC))
SELECT job, name, size, previous_size FROM r WHERE rn = 1 AND size * 2 < previous_size""")
def health_shrunk(spark, sf_dir):
    return listing.shrunk(roles.snapshots(spark, sf_dir))


@query(f"""WITH s AS ({SNAPSHOTS_SQL}), l AS (SELECT name, created, d AS destination FROM s CROSS JOIN (VALUES (1), (2), (3)) t(d) WHERE (name + d) % 3 <> 0),
m AS (SELECT name FROM l ORDER BY created DESC, name DESC LIMIT 1) SELECT name, destination, destination = 2 AS local FROM l WHERE name = (SELECT name FROM m)""")
def latest_copies(spark, sf_dir):
    one = lambda d: roles.snapshots(spark, sf_dir).where((F.col("name") + d) % 3 != 0).select("name", "created", F.lit(d).alias("destination"))
    local = F.col("destination") == 2
    return listing.latest(listing.across([one(d) for d in (1, 2, 3)]), local).select("name", "destination", local.alias("local"))


# -- retention

JUDGED_SQL = f"""s AS ({SNAPSHOTS_SQL}), a AS (SELECT *, CAST(floor(epoch(TIMESTAMP '2001-08-28 12:00:00' - created) / 86400) AS BIGINT) AS d FROM s),
b AS (SELECT *, CASE WHEN d < 7 THEN NULL WHEN d >= 365 THEN 6 + (d - 365) // 365 WHEN d >= 180 THEN 5 WHEN d >= 90 THEN 4 WHEN d >= 60 THEN 3 WHEN d >= 30 THEN 2 WHEN d >= 14 THEN 1 ELSE 0 END AS bucket FROM a),
k AS (SELECT *, bucket IS NOT NULL AND row_number() OVER (PARTITION BY job, bucket ORDER BY created, name DESC) = 1 AS keeper FROM b)"""


@query(f"WITH {JUDGED_SQL} SELECT job, name, bucket FROM k WHERE keeper")
def milestone_keepers(spark, sf_dir):
    return retention.milestone_keepers(roles.snapshots(spark, sf_dir), NOW)


@query(f"WITH {JUDGED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job, keeper ORDER BY created DESC, name DESC) AS rn FROM k) SELECT job, name FROM r WHERE NOT keeper AND rn > 3")
def retention_count(spark, sf_dir):
    return retention.removals_by_count(roles.snapshots(spark, sf_dir), NOW, 3)


@query(f"WITH {JUDGED_SQL} SELECT job, name FROM k WHERE NOT keeper AND created < TIMESTAMP '2001-08-28 12:00:00' - INTERVAL 90 DAY")
def retention_age(spark, sf_dir):
    return retention.removals_by_age(roles.snapshots(spark, sf_dir), NOW, durations.seconds("90d"))


@query(f"""WITH {JUDGED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job, keeper ORDER BY created DESC, name DESC) AS rn FROM k)
SELECT job, count(*) AS kept, CAST(sum(size) AS BIGINT) AS size FROM r WHERE keeper OR rn <= 2 GROUP BY job""")
def retention_applied(spark, sf_dir):
    return retention.apply(roles.snapshots(spark, sf_dir), NOW, count=2).groupBy("job").agg(F.count(F.lit(1)).alias("kept"), F.sum("size").alias("size"))


# -- the store

PLAN_SQL = f"""e AS ({roles.ENTRIES_SQL}), live AS (SELECT DISTINCT l_partkey AS chunk FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'),
keep AS (SELECT chunk, min(pack) AS keeper FROM e GROUP BY chunk),
u AS (SELECT e.pack, CAST(sum(stored) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN live.chunk IS NOT NULL AND keeper = e.pack THEN stored END), 0) AS BIGINT) AS used
  FROM e JOIN keep USING (chunk) LEFT JOIN live USING (chunk) GROUP BY e.pack),
plan AS (SELECT *, CASE WHEN used = 0 THEN 'dead' WHEN used * 100 < total * 30 THEN 'sparse' ELSE 'keep' END AS verdict FROM u)"""


def _live(spark, sf_dir):
    """What the snapshots need that are still in progress."""
    open_ = roles.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("name"))
    return store.live_chunks(roles.chunks(spark, sf_dir).join(open_, "name", "left_semi"))


@query(f"WITH {PLAN_SQL} SELECT pack, total, used, verdict FROM plan")
def gc_plan(spark, sf_dir):
    return store.gc_plan(roles.entries(spark, sf_dir), _live(spark, sf_dir), 30)


@query("SELECT l_suppkey AS pack, max(l_shipdate) AS modified FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2001-11-01 00:00:00' - INTERVAL 1 HOUR")
def gc_young_guard(spark, sf_dir):
    packs = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pack")).agg(F.max("l_shipdate").alias("modified"))
    return store.old_enough(packs, F.expr("timestamp_ntz'2001-11-01 00:00:00'"))


MOVES_SQL = f"""{PLAN_SQL}, w AS (SELECT e.* FROM e SEMI JOIN live USING (chunk)), doomed AS (SELECT pack FROM plan WHERE verdict <> 'keep'),
safe AS (SELECT DISTINCT chunk FROM w ANTI JOIN doomed USING (pack)),
m AS (SELECT chunk, min(pack) AS pack, min_by(stored, pack) AS stored FROM (SELECT * FROM w SEMI JOIN doomed USING (pack)) ANTI JOIN safe USING (chunk) GROUP BY chunk)"""


@query(f"WITH {MOVES_SQL} SELECT chunk, pack, stored FROM m")
def repack_moves(spark, sf_dir):
    found, live = roles.entries(spark, sf_dir), _live(spark, sf_dir)
    return store.repack_moves(found, live, store.gc_plan(found, live, 30))


@query(f"""WITH {MOVES_SQL}, out AS (SELECT e.pack, chunk, stored FROM e SEMI JOIN (SELECT pack FROM plan WHERE verdict = 'keep') k USING (pack) UNION ALL SELECT 40, chunk, stored FROM m)
SELECT pack, count(*) AS chunks, CAST(sum(stored) AS BIGINT) AS stored FROM out GROUP BY pack""")
def gc_result(spark, sf_dir):
    after = store.collect_garbage(roles.entries(spark, sf_dir), _live(spark, sf_dir), F.lit(40).cast("bigint"), 30)
    return after.groupBy("pack").agg(F.count(F.lit(1)).alias("chunks"), F.sum("stored").alias("stored"))


@query(f"""WITH c AS ({roles.CONTENT_SQL}), g AS (SELECT chunk, count(*) AS n, min(size) AS size FROM c GROUP BY chunk)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS kept_bytes FROM g""")
def dedup_stats(spark, sf_dir):
    return store.dedup_stats(roles.content(spark, sf_dir))


@query(f"""WITH c AS ({roles.CONTENT_SQL}), k AS (SELECT DISTINCT chunk FROM c WHERE seq % 7 = 0)
SELECT seq, chunk, size, CASE WHEN row_number() OVER (PARTITION BY c.chunk ORDER BY seq) = 1 AND k.chunk IS NULL THEN 'Data' ELSE 'Reference' END AS tag FROM c LEFT JOIN k USING (chunk)""")
def dedup_new_vs_ref(spark, sf_dir):
    stream = roles.content(spark, sf_dir).drop("destination")
    return store.tagged(stream, stream.where("seq % 7 = 0")).select("seq", "chunk", "size", "tag")


@query("SELECT l_partkey AS chunk FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) = 3")
def known_intersection(spark, sf_dir):
    return store.known_everywhere(roles.holdings(spark, sf_dir))


@query("""SELECT d.destination, p.p_partkey AS chunk FROM part p CROSS JOIN (SELECT DISTINCT l_suppkey % 3 AS destination FROM lineitem) d
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_suppkey % 3 = d.destination AND NOT (l_partkey % 5 = 2 AND l_suppkey % 3 = 1))""")
def missing_per_destination(spark, sf_dir):
    held = roles.holdings(spark, sf_dir)
    destinations = held.select("destination").distinct()
    return store.missing(roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk")), destinations, held.where("not (chunk % 5 = 2 and destination = 1)"))


@query("SELECT l_orderkey AS name, count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 10) GROUP BY 1")
def ensure_complete(spark, sf_dir):
    index = roles.table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("chunk"))
    return store.incomplete(roles.chunks(spark, sf_dir), index)


@query("SELECT l_partkey AS chunk, min(l_linenumber) AS seq FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 10) GROUP BY 1")
def unique_missing(spark, sf_dir):
    index = roles.table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("chunk"))
    return store.unique_missing(roles.chunks(spark, sf_dir), index)


@query(f"""WITH e AS ({roles.ENTRIES_SQL}), o AS (SELECT * FROM e WHERE pack < 25), n AS (SELECT * FROM e WHERE pack BETWEEN 20 AND 35)
SELECT pack, count(*) AS chunks FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE pack NOT IN (SELECT pack FROM o)) WHERE pack % 10 <> 0 GROUP BY pack""")
def index_merge(spark, sf_dir):
    found = roles.entries(spark, sf_dir)
    gone = found.where("pack % 10 = 0").select("pack")
    return store.merged_index(found.where("pack < 25"), found.where("pack between 20 and 35"), gone).groupBy("pack").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"""WITH c AS ({roles.CONTENT_SQL}), need AS (SELECT c.chunk, d.destination, bool_or(c.seq % 3 <> 0) AS data FROM c CROSS JOIN (SELECT DISTINCT destination FROM c) d GROUP BY 1, 2),
lack AS (SELECT n.* FROM need n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chunk = n.chunk AND c.destination = n.destination))
SELECT destination, count(*) FILTER (data) AS put, count(*) FILTER (NOT data) AS unresolved FROM lack GROUP BY 1""")
def fanout_put(spark, sf_dir):
    content = roles.content(spark, sf_dir)
    stream = content.withColumn("tag", F.when(F.col("seq") % 3 != 0, "Data").otherwise("Reference"))
    put, failed = store.fan_out(stream, content, content)
    both = put.withColumn("data", F.lit(True)).unionByName(failed.withColumn("data", F.lit(False)))
    return both.groupBy("destination").agg(F.count_if("data").alias("put"), F.count_if(~F.col("data")).alias("unresolved"))


@query("""SELECT doc_id, seq, CAST(coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", len
FROM (SELECT doc_id, CAST(i AS INTEGER) AS seq, octet_length(encode(string_split(text, chr(10))[i + 1])) AS len FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS i))""")
def chunk_offsets(spark, sf_dir):
    lines = roles.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    sized = lines.select("doc_id", "seq", F.octet_length("line").cast("bigint").alias("len"))
    return store.offsets(sized, "doc_id", "seq", "len").select("doc_id", "seq", "offset", "len")


@query("""WITH RECURSIVE r AS (SELECT l_suppkey AS destination, CAST(round(l_quantity) AS BIGINT) AS stored, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem),
f AS (SELECT destination, seq, stored, CAST(0 AS BIGINT) AS pack_no, stored AS filled FROM r WHERE seq = 1
  UNION ALL SELECT r.destination, r.seq, r.stored, CASE WHEN f.filled >= 500 THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.filled >= 500 THEN r.stored ELSE f.filled + r.stored END
  FROM f JOIN r ON r.destination = f.destination AND r.seq = f.seq + 1)
SELECT destination, pack_no, count(*) AS chunks, CAST(sum(stored) AS BIGINT) AS stored FROM f GROUP BY 1, 2""")
def pack_assign(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("destination"), F.row_number().over(order).cast("bigint").alias("seq"), F.round("l_quantity").cast("bigint").alias("stored")
    )
    return store.assign_packs(rows, target=500).groupBy("destination", "pack_no").agg(F.count(F.lit(1)).alias("chunks"), F.sum("stored").alias("stored"))


# -- verify and repair

@query("""WITH c AS (SELECT DISTINCT l_orderkey AS name, l_partkey AS chunk FROM lineitem)
SELECT name, bool_and(p.p_size IS NOT NULL) AS intact, count(*) FILTER (p.p_size IS NULL) AS bad_chunks FROM c LEFT JOIN (SELECT * FROM part WHERE p_size >= 10) p ON p.p_partkey = c.chunk GROUP BY name""")
def snapshot_check(spark, sf_dir):
    good = roles.table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("chunk"))
    return verify.snapshot_check(roles.chunks(spark, sf_dir), good)


@query(f"""WITH e AS ({roles.ENTRIES_SQL}), c AS (SELECT DISTINCT l_orderkey AS name, l_partkey AS chunk FROM lineitem),
good AS (SELECT DISTINCT chunk FROM e WHERE pack >= 30 AND NOT (pack = 31 AND chunk % 5 = 0)), r AS (SELECT name, bool_and(g.chunk IS NOT NULL) AS intact FROM c LEFT JOIN good g USING (chunk) WHERE name % 700 <> 0 GROUP BY name)
SELECT (SELECT count(DISTINCT pack) FROM e) AS packs, (SELECT count(*) FROM r WHERE intact) AS intact, (SELECT count(DISTINCT pack) FROM e WHERE pack < 30) AS damaged_packs,
  (SELECT count(DISTINCT chunk) FROM c WHERE chunk NOT IN (SELECT chunk FROM good)) AS bad_chunks, (SELECT count(DISTINCT name) FROM c WHERE name % 700 = 0) AS bad_recipes, (SELECT count(*) FROM r WHERE NOT intact) AS incomplete, false AS clean""")
def store_check(spark, sf_dir):
    found = roles.entries(spark, sf_dir)
    chunks = roles.chunks(spark, sf_dir)
    damaged = found.where("pack < 30").select("pack").distinct()
    bad = found.where("pack = 31 and chunk % 5 = 0")
    recipes = chunks.where("name % 700 = 0").select("name").distinct()
    return verify.summary(found.select("pack").distinct(), verify.findings(found, damaged, bad, chunks, recipes))


@query("""SELECT l_partkey AS chunk, min(l_suppkey) AS source FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def restore_priority(spark, sf_dir):
    copies = roles.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("source"), "l_returnflag")
    return verify.best_copies(copies, F.col("source"), F.col("l_returnflag") != "R").select("chunk", "source")


@query("""SELECT l_orderkey AS name, min_by(l_suppkey, l_suppkey % 17 * 1000 + l_suppkey) AS destination FROM lineitem GROUP BY 1""")
def recipe_source(spark, sf_dir):
    copies = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("destination"), (F.col("l_suppkey") % 17 * 1000 + F.col("l_suppkey")).alias("position"))
    return verify.first_with(copies)


@query(f"""WITH e AS ({roles.ENTRIES_SQL}), d AS (SELECT DISTINCT pack FROM e WHERE pack % 2 = 1), l AS (SELECT pack, chunk FROM e WHERE pack IN (SELECT pack FROM d) AND chunk NOT IN (SELECT chunk FROM e WHERE pack NOT IN (SELECT pack FROM d)))
SELECT d.pack, count(l.chunk) AS lone, count(l.chunk) = 0 AS safe FROM d LEFT JOIN l USING (pack) GROUP BY d.pack""")
def rehome(spark, sf_dir):
    found = roles.entries(spark, sf_dir)
    damaged = found.where("pack % 2 = 1").select("pack").distinct()
    lone, safe = verify.rehomed(found, damaged)
    counts = lone.groupBy("pack").agg(F.count(F.lit(1)).alias("lone"))
    return damaged.join(counts, "pack", "left").join(safe.withColumn("safe", F.lit(True)), "pack", "left").select("pack", F.coalesce("lone", F.lit(0).cast("bigint")).alias("lone"), F.coalesce("safe", F.lit(False)).alias("safe"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS job, s_suppkey AS destination FROM supplier) SELECT DISTINCT a.destination, b.destination AS peer FROM p a JOIN p b USING (job) WHERE a.destination <> b.destination""")
def peers(spark, sf_dir):
    return verify.peers(roles.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job"), F.col("s_suppkey").alias("destination")))


@query("""SELECT vec_id AS file, count(*) FILTER (abs(x) >= 0.3) AS bad, CASE WHEN count(*) FILTER (abs(x) >= 0.3) = 0 THEN 'ok' WHEN count(*) FILTER (abs(x) >= 0.3) <= 2 THEN 'repaired' ELSE 'lost' END AS verdict
FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1""")
def pieces_damaged(spark, sf_dir):
    pieces = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file"), F.posexplode("embedding").alias("piece", "x"))
    return verify.pieces_damaged(pieces, ~(F.abs("x") >= F.lit(0.3).cast("float")))


@query("SELECT l_suppkey AS pack, bit_xor(l_partkey * 1000003 + l_orderkey) AS parity FROM lineitem GROUP BY 1")
def xor_parity(spark, sf_dir):
    return roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pack")).agg(F.bit_xor(F.col("l_partkey") * 1000003 + F.col("l_orderkey")).alias("parity"))


@query("""SELECT name, sha256(string_agg(chunk, ',' ORDER BY seq, chunk)) AS root FROM (SELECT l_orderkey AS name, l_linenumber AS seq, CAST(l_partkey AS VARCHAR) AS chunk, l_partkey AS k FROM lineitem) GROUP BY 1""")
def snapshot_root(spark, sf_dir):
    return verify.snapshot_root(roles.chunks(spark, sf_dir).withColumn("chunk", F.col("chunk").cast("string")))


@query("""WITH r AS (SELECT l_orderkey AS name, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS rebuilt FROM lineitem GROUP BY 1)
SELECT o_orderkey AS name, o_orderkey % 200 AS size, coalesce(rebuilt, 0) AS rebuilt, coalesce(rebuilt, 0) = o_orderkey % 200 AS complete FROM orders LEFT JOIN r ON name = o_orderkey""")
def stream_sizes(spark, sf_dir):
    expected = roles.snapshots(spark, sf_dir).select("name", (F.col("name") % 200).alias("size"))
    return verify.stream_check(roles.chunks(spark, sf_dir), expected).select("name", "size", "rebuilt", "complete")


# -- files

SCANS_SQL = """a AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0),
d AS (SELECT path, a.hash AS old, b.hash AS new FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash)"""


def _scans(spark, sf_dir):
    docs = roles.documents(spark, sf_dir)
    before = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("hash"))
    return before, after


@query(f"WITH {SCANS_SQL} SELECT path, old, new FROM d")
def catalog_diff(spark, sf_dir):
    return files.changed_paths(*_scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL} SELECT count(*) AS total, (SELECT string_agg(CAST(path AS VARCHAR), ',' ORDER BY path) FROM (SELECT path FROM d ORDER BY path LIMIT 20)) AS paths FROM d")
def catalog_diff_top20(spark, sf_dir):
    out = files.changed_summary(files.changed_paths(*_scans(spark, sf_dir)))
    return out.select("total", F.array_join(F.transform("paths", lambda p: p.cast("string")), ",").alias("paths"))


@query("""WITH f AS (SELECT doc_id AS path, md5(text) AS ino, count(*) OVER (PARTITION BY md5(text)) AS nlink FROM documents)
SELECT path, target FROM (SELECT path, min(path) OVER (PARTITION BY ino) AS target FROM f WHERE nlink > 1) WHERE path <> target""")
def hardlink_targets(spark, sf_dir):
    docs = roles.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(1).alias("dev"), F.md5("text").alias("ino"))
    return files.hardlink_targets(docs.withColumn("nlink", F.count(F.lit(1)).over(Window.partitionBy("ino"))))


#: The last pattern that matches decides; nothing below an excluded folder comes back.
IGNORED = ["*.html", "/www.*/", "!blog.*", "**/fr/**", "!/blog.*/fr/1*"]


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), t AS (SELECT page_id, path, string_split(rtrim(path, '/'), '/') AS s FROM p),
f AS (SELECT page_id, path, s[1] AS host, s[2] AS lang, s[3] AS leaf, len(s) AS n FROM t)
SELECT page_id, path, CASE WHEN host LIKE 'www.%' AND n > 1 THEN true WHEN lang = 'fr' AND n > 2 THEN NOT (host LIKE 'blog.%' AND leaf LIKE '1%') WHEN leaf LIKE '%.html' THEN true ELSE false END AS excluded FROM f""")
def exclude_filter(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = roles.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", excluded(F.rtrim(F.col("path"), F.lit("/")), F.lit(False), IGNORED).alias("excluded"))


@query(f"SELECT destination, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({roles.CONTENT_SQL}) GROUP BY 1")
def usage(spark, sf_dir):
    return files.usage(roles.content(spark, sf_dir).withColumnRenamed("size", "len"))


@query("""SELECT doc_id, name FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '.' || source || '.partial' WHEN doc_id % 3 = 1 THEN '.store-write-test-' || doc_id ELSE source || '.partial' END AS name,
TIMESTAMP '2001-08-27 00:00:00' + INTERVAL 1 MINUTE * doc_id AS modified FROM documents) WHERE (name LIKE '.%.partial' OR name LIKE '.store-write-test-%') AND modified < TIMESTAMP '2001-08-28 12:00:00' - INTERVAL 24 HOUR""")
def stale_partials(spark, sf_dir):
    third = F.col("doc_id") % 3
    name = F.when(third == 0, F.concat(F.lit("."), "source", F.lit(".partial"))).when(third == 1, F.concat(F.lit(".store-write-test-"), "doc_id")).otherwise(F.concat("source", F.lit(".partial")))
    rows = roles.documents(spark, sf_dir).select("doc_id", name.alias("path"), (F.expr("timestamp_ntz'2001-08-27 00:00:00'") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("modified"))
    return files.stale_partials(rows, F.lit(NOW).cast("timestamp_ntz")).select("doc_id", F.col("path").alias("name"))


# -- names and locations

NAMES_SQL = """n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'x/' WHEN o_orderkey % 10 = 2 THEN '.' ELSE '' END || o_orderpriority || '-' || o_custkey || '-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-00000000-0000-0000-0000-'
  || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || CASE WHEN o_orderkey % 10 = 3 THEN '.zip' ELSE '.tar.lz4' END AS name, o_orderpriority || '-' || o_custkey AS own, o_orderdate AS created, o_orderkey % 10 IN (1, 2, 3) AS bad FROM orders)"""


def _names(spark, sf_dir):
    kind = F.col("o_orderkey") % 10
    own = F.concat("o_orderpriority", F.lit("-"), "o_custkey")
    unique = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    good = names.archive_name(own, F.col("o_orderdate"), unique)
    name = F.concat(F.when(kind == 1, "x/").when(kind == 2, ".").otherwise(""), F.when(kind == 3, F.regexp_replace(good, r"\.tar\.lz4$", ".zip")).otherwise(good))
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), own.alias("own"))


@query(f"WITH {NAMES_SQL} SELECT o_orderkey, name, CASE WHEN NOT bad THEN own END AS job, CASE WHEN NOT bad THEN created END AS created FROM n")
def archive_name_parse(spark, sf_dir):
    name = F.col("name")
    return _names(spark, sf_dir).select("o_orderkey", "name", names.parsed_job(name).alias("job"), names.parsed_created(name).alias("created"))


@query(f"WITH {NAMES_SQL} SELECT o_orderkey, CASE WHEN NOT bad AND o_orderkey % 10 <> 4 THEN 'new-job' || substr(name, length(own) + 1) END AS renamed FROM n")
def rename_names(spark, sf_dir):
    old = F.when(F.col("o_orderkey") % 10 == 4, "other").otherwise(F.col("own"))
    return _names(spark, sf_dir).select("o_orderkey", names.renamed(F.col("name"), old, "new-job").alias("renamed"))


@query(r"""WITH u AS (SELECT page_id, 'ssh://' || CASE WHEN page_id % 3 = 0 THEN 'me@' ELSE '' END || CASE WHEN page_id % 11 = 0 THEN '-' ELSE '' END || regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN page_id % 2 = 0 THEN ':2222' ELSE '' END || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || CASE WHEN page_id % 7 = 0 THEN '/a%20b/..' ELSE '' END AS uri FROM pages)
SELECT page_id, regexp_extract(uri, '^ssh://(?:me@)?([^:/]*)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'me' END AS "user", CASE WHEN page_id % 2 = 0 THEN 2222 ELSE 0 END AS port, replace(regexp_extract(uri, '^ssh://[^/]*(/.*)$', 1), '%20', ' ') AS path,
CASE WHEN page_id % 11 = 0 THEN 'host or user starts with a dash' WHEN page_id % 7 = 0 THEN 'path leads upwards' END AS error, uri AS shown FROM u""")
def location_parse(spark, sf_dir):
    k, host = F.col("page_id"), F.regexp_extract("url", "://([^/?#]*)", 1)
    uri = F.concat(
        F.lit("ssh://"), F.when(k % 3 == 0, "me@").otherwise(""), F.when(k % 11 == 0, "-").otherwise(""), host, F.when(k % 2 == 0, ":2222").otherwise(""), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.when(k % 7 == 0, "/a%20b/..").otherwise("")
    )
    rows = roles.table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"))
    where = location.parsed(F.col("uri"))
    return rows.select("page_id", where["host"].alias("host"), where["user"].alias("user"), F.coalesce(where["port"], F.lit(0)).alias("port"), where["path"].alias("path"), location.error(F.col("uri")).alias("error"), location.shown(where).alias("shown"))


# -- state

STATE_SQL = f"r AS ({roles.RUNS_SQL}), d AS ({roles.DELIVERIES_SQL})"


@query(f"WITH {STATE_SQL} SELECT r.run_id, r.job, count(d.run_id) AS pending FROM r LEFT JOIN d ON d.run_id = r.run_id AND NOT d.delivered WHERE completed_at IS NULL GROUP BY 1, 2")
def status(spark, sf_dir):
    return state.status(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir)).select("run_id", "job", "pending")


@query(f"WITH {STATE_SQL} SELECT run_id FROM r WHERE completed_at IS NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = r.run_id AND NOT delivered)")
def ready_runs(spark, sf_dir):
    return state.ready(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir)).select("run_id")


@query(f"WITH {STATE_SQL} SELECT run_id, destination, next_retry, r.created_at FROM d JOIN r USING (run_id) WHERE NOT delivered AND next_retry <= TIMESTAMP '1999-01-01 00:00:00'")
def due_deliveries(spark, sf_dir):
    now = F.expr("timestamp_ntz'1999-01-01 00:00:00'")
    return state.pending(roles.runs(spark, sf_dir), state.due(roles.deliveries(spark, sf_dir), now)).select("run_id", "destination", "next_retry", "created_at")


@query(f"WITH {STATE_SQL} SELECT min(next_retry) AS next_due FROM d WHERE NOT delivered")
def next_due(spark, sf_dir):
    return state.next_due(roles.deliveries(spark, sf_dir))


@query(f"WITH {STATE_SQL} SELECT job, run_id, size, completed_at FROM r WHERE completed_at IS NOT NULL")
def history(spark, sf_dir):
    return state.history(roles.runs(spark, sf_dir)).select("job", "run_id", "size", "completed_at")


@query(f"WITH {STATE_SQL}, g AS (SELECT run_id FROM r WHERE completed_at < TIMESTAMP '1998-01-01 00:00:00') SELECT (SELECT count(*) FROM r WHERE run_id NOT IN (SELECT run_id FROM g)) AS runs, (SELECT count(*) FROM d WHERE run_id NOT IN (SELECT run_id FROM g)) AS deliveries")
def purge_candidates(spark, sf_dir):
    runs, deliveries = state.purged(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir), F.expr("timestamp_ntz'1998-01-01 00:00:00'"))
    return runs.agg(F.count(F.lit(1)).alias("runs")).join(one_row(deliveries.agg(F.count(F.lit(1)).alias("deliveries"))))


RESULTS_SQL = "SELECT run_id, destination, destination % 3 <> 0 AS ok, 'offline' AS error FROM d WHERE destination % 5 <> 0"


def _results(deliveries):
    return deliveries.where("destination % 5 <> 0").select("run_id", "destination", (F.col("destination") % 3 != 0).alias("ok"), F.lit("offline").alias("error"))


@query(f"""WITH {STATE_SQL}, x AS ({RESULTS_SQL}) SELECT d.run_id, d.destination, coalesce(ok, false) AS delivered, CASE WHEN ok IS NULL THEN 0 ELSE 1 END AS attempts,
CASE WHEN ok IS NULL THEN 1000 WHEN NOT ok THEN 1060 ELSE 0 END AS next_retry, CASE WHEN NOT ok THEN error END AS last_error FROM d LEFT JOIN x USING (run_id, destination)""")
def register_run(spark, sf_dir):
    deliveries = roles.deliveries(spark, sf_dir)
    runs = deliveries.groupBy("run_id").agg(F.collect_list("destination").alias("destinations"))
    return state.registered(runs, _results(deliveries), F.lit(1000)).withColumn("next_retry", F.coalesce("next_retry", F.lit(0)))


@query(f"""WITH {STATE_SQL}, x AS ({RESULTS_SQL}), t AS (SELECT d.*, CAST(destination % 5 AS INTEGER) AS attempts, x.ok, x.error FROM d LEFT JOIN x USING (run_id, destination))
SELECT run_id, destination, coalesce(ok, delivered) AS delivered, CASE WHEN ok IS NULL THEN attempts ELSE attempts + 1 END AS attempts,
CASE WHEN NOT ok THEN 1000 + CASE attempts + 1 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END ELSE 500 END AS next_retry, CASE WHEN NOT ok THEN error WHEN ok THEN NULL ELSE 'before' END AS last_error FROM t""")
def mark_deliveries(spark, sf_dir):
    deliveries = roles.deliveries(spark, sf_dir)
    before = deliveries.select("run_id", "destination", "delivered", (F.col("destination") % 5).cast("int").alias("attempts"), F.lit(500).alias("next_retry"), F.lit("before").alias("last_error"))
    return state.marked(before, _results(deliveries), F.lit(1000))


@query(f"""WITH {STATE_SQL} SELECT count(*) FILTER (completed_at IS NOT NULL OR NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = r.run_id AND NOT delivered)) AS completed, count(*) AS runs FROM r""")
def complete_runs(spark, sf_dir):
    out = state.completed(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return out.agg(F.count_if(F.col("completed_at").isNotNull()).alias("completed"), F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {STATE_SQL}, g AS (SELECT run_id FROM r WHERE job = 7 AND completed_at IS NULL) SELECT (SELECT count(*) FROM r WHERE run_id NOT IN (SELECT run_id FROM g)) AS runs, (SELECT count(*) FROM d WHERE run_id NOT IN (SELECT run_id FROM g)) AS deliveries""")
def forget_job(spark, sf_dir):
    runs, deliveries = state.forgotten(roles.runs(spark, sf_dir), roles.deliveries(spark, sf_dir), 7)
    return runs.agg(F.count(F.lit(1)).alias("runs")).join(one_row(deliveries.agg(F.count(F.lit(1)).alias("deliveries"))))


@query(f"""WITH {STATE_SQL} SELECT run_id, count(*) FILTER (delivered) AS delivered, count(*) FILTER (NOT delivered) AS failed, count(*) FILTER (delivered) > 0 AS ok,
coalesce(string_agg(CASE WHEN NOT delivered THEN destination || ': offline' END, '; ' ORDER BY destination), '') AS errors FROM d GROUP BY 1""")
def fanout_outcome(spark, sf_dir):
    return state.outcome(roles.deliveries(spark, sf_dir).withColumn("last_error", F.lit("offline"))).withColumn("errors", F.coalesce("errors", F.lit("")))


@query("""WITH t AS (SELECT s_suppkey AS destination, 100 AS "at" FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT s_suppkey AS destination, 200 AS "at", s_suppkey % 5 = 0 AS gone FROM supplier WHERE s_suppkey % 3 = 0)
SELECT destination, "at" FROM t WHERE destination NOT IN (SELECT destination FROM c) UNION ALL SELECT destination, "at" FROM c WHERE NOT gone""")
def verified_upsert(spark, sf_dir):
    keys = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("destination"))
    table = keys.where("destination % 2 = 0").withColumn("at", F.lit(100))
    changes = keys.where("destination % 3 = 0").withColumns({"at": F.lit(200), "gone": F.col("destination") % 5 == 0})
    return state.upserted(table, changes, ["destination"], F.col("gone"))


@query(f"""WITH {STATE_SQL} SELECT count(*) AS runs, count(*) FILTER (job = 9001) AS moved, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) + CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 9001) THEN 1 ELSE 0 END AS schedules
FROM (SELECT CASE WHEN job = 7 THEN 9001 ELSE job END AS job FROM r)""")
def rename_job(spark, sf_dir):
    runs = roles.runs(spark, sf_dir).withColumns({"job": F.col("job").cast("string"), "archive_name": F.concat(F.col("job").cast("string"), F.lit("-old"))})
    table = runs.select("job").distinct().withColumn("last", F.lit(1))
    moved, _, copied = state.renamed_job(runs, roles.deliveries(spark, sf_dir), table, "7", "9001")
    return moved.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("job") == "9001").alias("moved")).join(one_row(copied.agg(F.count(F.lit(1)).alias("schedules"))))


@query("""SELECT user_id, count(*) AS attempts, CASE least(count(*), 4) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END AS delay, max(ts) + INTERVAL 1 SECOND * CASE least(count(*), 4) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END AS next_retry
FROM events WHERE event_type = 'error' GROUP BY 1""")
def backoff(spark, sf_dir):
    failures = roles.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last"))
    delay = names.retry_delay(F.col("attempts"))
    return failures.select("user_id", "attempts", delay.alias("delay"), (F.col("last") + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).alias("next_retry"))


# -- schedules and health

SLOTS_SQL = "s AS (SELECT user_id AS job, max(date_trunc('day', ts - INTERVAL 2 HOUR) + INTERVAL 2 HOUR) AS slot FROM events WHERE date_trunc('day', ts - INTERVAL 2 HOUR) + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1)"
LAST_SQL = "l AS (SELECT user_id AS job, max(ts) AS last FROM events WHERE event_type = 'signup' AND user_id % 4 <> 0 GROUP BY 1)"


def _slots(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "events")
    slots = rows.select(F.col("user_id").alias("job"), schedule.daily_slot(F.col("ts"), 2).alias("slot"))
    last = rows.where("event_type = 'signup' and user_id % 4 <> 0").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last"))
    return schedule.latest_slots(slots, F.expr("timestamp_ntz'2024-01-29 12:00:00'")), last


@query(f"WITH {SLOTS_SQL}, {LAST_SQL} SELECT job, slot FROM s LEFT JOIN l USING (job) WHERE last IS NULL OR last < slot")
def next_slot_asof(spark, sf_dir):
    return schedule.unhandled(*_slots(spark, sf_dir))


@query(f"""WITH {SLOTS_SQL}, {LAST_SQL}, t AS (SELECT job, CASE WHEN job % 2 = 0 THEN slot ELSE slot - INTERVAL 1 DAY END AS retry_slot, TIMESTAMP '2024-01-29 11:00:00' + INTERVAL 1 HOUR * (job % 3) AS next_retry FROM s WHERE job % 5 <> 0)
SELECT job, slot, NOT coalesce(retry_slot = slot AND next_retry > TIMESTAMP '2024-01-29 12:00:00', false) AS due FROM s LEFT JOIN l USING (job) LEFT JOIN t USING (job) WHERE last IS NULL OR last < slot""")
def due_runs(spark, sf_dir):
    slots, last = _slots(spark, sf_dir)
    held = slots.where("job % 5 <> 0").select(
        "job",
        F.when(F.col("job") % 2 == 0, F.col("slot")).otherwise(F.col("slot") - F.expr("interval 1 day")).alias("slot"),
        (F.expr("timestamp_ntz'2024-01-29 11:00:00'") + F.make_dt_interval(hours=(F.col("job") % 3).cast("int"))).alias("next_retry"),
    )
    return schedule.due(schedule.unhandled(slots, last), held, F.expr("timestamp_ntz'2024-01-29 12:00:00'"))


CRONS = [("nightly", "0 2 * * *"), ("hourly", "0 * * * *"), ("monthly", "0 2 1 * *"), ("weekdays", "30 6 * * 1-5"), ("quarters", "*/15 * * * *")]


@query("""SELECT * FROM (VALUES ('nightly', TIMESTAMP '2026-07-17 02:00:00'), ('hourly', TIMESTAMP '2026-07-17 12:00:00'), ('monthly', TIMESTAMP '2026-07-01 02:00:00'), ('weekdays', TIMESTAMP '2026-07-17 06:30:00'), ('quarters', TIMESTAMP '2026-07-17 12:45:00')) t(job, slot)""")
def cron_slots(spark, sf_dir):
    return schedule.slot_table(spark, CRONS, datetime(2026, 7, 17, 12, 45))


@query(f"""WITH {STATE_SQL}, h AS (SELECT job, run_id AS name, size, created_at AS created FROM r), k AS (SELECT job, name, size, row_number() OVER w AS rn, lead(size) OVER w AS previous_size FROM h WINDOW w AS (PARTITION BY job ORDER BY created DESC, name DESC)),
p AS (SELECT job, 'shrank from ' || previous_size || ' to ' || size AS problem FROM k WHERE rn = 1 AND size * 2 < previous_size
  UNION ALL SELECT job, count(*) || ' deliveries pending' FROM r JOIN d USING (run_id) WHERE NOT delivered AND r.completed_at IS NULL AND epoch(TIMESTAMP '2001-08-28 12:00:00' - created_at) > 3600 GROUP BY job
  UNION ALL SELECT c_custkey, 'verification overdue: ' || c_custkey FROM customer JOIN (SELECT user_id AS x, max(ts) AS seen FROM events WHERE event_type = 'click' GROUP BY 1) ON x = c_custkey WHERE epoch(TIMESTAMP '2024-02-06 12:00:00' - seen) > 8 * 86400)
SELECT c_custkey AS job, count(problem) = 0 AS healthy, coalesce(string_agg(problem, '; ' ORDER BY problem), '') AS problems FROM customer LEFT JOIN p ON p.job = c_custkey GROUP BY 1""")
def health_report(spark, sf_dir):
    runs = roles.runs(spark, sf_dir)
    jobs = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"))
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    past = runs.select("job", F.col("run_id").alias("name"), "size", F.col("created_at").alias("created"))
    open_ = runs.where("completed_at is null").withColumn("created_at", seconds(F.col("created_at")))
    seen = roles.table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("destination")).agg(F.max(seconds(F.col("ts"))).alias("at"))
    now = seconds(F.lit(NOW).cast("timestamp_ntz"))
    found = [
        health.shrank(listing.shrunk(past)),
        health.undelivered(open_, roles.deliveries(spark, sf_dir), now),
        health.overdue(jobs.withColumn("destination", F.col("job")), seen, seconds(F.expr("timestamp_ntz'2024-02-06 12:00:00'"))),
    ]
    return health.report(jobs, found).withColumn("problems", F.array_join("problems", "; "))


@query(f"WITH {STATE_SQL} SELECT job, count(*) AS pending FROM r WHERE completed_at IS NULL AND job NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 1")
def health_orphans(spark, sf_dir):
    jobs = roles.table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("job"))
    return health.orphans(roles.runs(spark, sf_dir).where("completed_at is null"), jobs)


@query("""SELECT user_id AS destination FROM (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1) WHERE epoch(TIMESTAMP '2024-02-03 12:00:00' - seen) >= 7 * 86400 ORDER BY user_id LIMIT 1""")
def verify_overdue(spark, sf_dir):
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    seen = roles.table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("destination")).agg(F.max(seconds(F.col("ts"))).alias("at"))
    order = seen.select("destination", F.col("destination").alias("position"))
    return health.first_to_verify(order, seen, seconds(F.expr("timestamp_ntz'2024-02-03 12:00:00'")))


@query(f"""WITH {NAMES_SQL}, f AS (SELECT o_orderkey % 4 AS destination, name AS archive, created FROM n WHERE NOT bad UNION ALL SELECT o_orderkey % 4 + 4, name, created FROM n WHERE NOT bad AND o_orderkey % 3 = 0)
SELECT archive, created, string_agg(CAST(destination AS VARCHAR), ',' ORDER BY destination) AS destinations FROM f WHERE NOT (destination = 1 AND created >= TIMESTAMP '2001-01-01 00:00:00') GROUP BY 1, 2""")
def import_queue(spark, sf_dir):
    listed = _names(spark, sf_dir).select((F.col("o_orderkey") % 4).alias("destination"), F.col("name").alias("archive"), "o_orderkey")
    more = listed.where("o_orderkey % 3 = 0").withColumn("destination", F.col("destination") + 4)
    found = legacy.archives(listed.unionByName(more).drop("o_orderkey"))
    failed = found.where("destination = 1 and created >= timestamp_ntz'2001-01-01 00:00:00'").select("destination", "archive")
    return legacy.import_queue(found, failed).withColumn("destinations", F.array_join(F.transform("destinations", lambda d: d.cast("string")), ","))


# -- chunking, codecs, events

@query("""WITH w AS (SELECT doc_id, CAST(i AS BIGINT) AS pos, string_split(text, ' ')[i + 1] AS word FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, ' ')))) AS i)),
n AS (SELECT *, CAST(coalesce(sum(CASE WHEN CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq FROM w),
c AS (SELECT doc_id, seq, string_agg(word, ' ' ORDER BY pos) AS part FROM n GROUP BY 1, 2) SELECT doc_id, seq, sha256(part) AS chunk, octet_length(encode(part)) AS size FROM c""")
def token_chunks(spark, sf_dir):
    return chunking.token_chunks(roles.documents(spark, sf_dir), "doc_id", "text")


@query()
def cdc_chunks(spark, sf_dir):
    return chunking.chunked(roles.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("bytes")), least=256, average=1024, most=4096)


@query()
def lz4_sizes(spark, sf_dir):
    docs = roles.documents(spark, sf_dir)
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("size"), codec.stored_size(F.col("text").cast("binary")).alias("stored"))


@query()
def parity_q(spark, sf_dir):
    return roles.documents(spark, sf_dir).select("doc_id", parity.parity_digest(F.col("text").cast("binary")).alias("parity"))


@query("SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_envelope(spark, sf_dir):
    fields = {c: F.col(c) for c in ("event_id", "user_id", "event_type", "props")}
    lines = roles.table(spark, sf_dir, "events").select(events.event("seen", **fields).alias("value"))
    found = events.parsed(lines, "event string, event_id bigint, user_id bigint, event_type string, props string")
    return found.where("event = 'seen'").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT user_id, ts, gap FROM (SELECT user_id, ts, CAST(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS BIGINT) AS gap FROM events) WHERE gap > 900")
def stall_gaps(spark, sf_dir):
    return loops.gaps(roles.table(spark, sf_dir, "events"), "user_id", "ts", 900)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_runs(spark, sf_dir):
    return loops.hourly(roles.table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return loops.drained(loops.distinct(loops.event_stream(spark, sf_dir), ["user_id", "event_type"]), "stream_dedup", "append")


@query("SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS failures, CASE least(count(*) FILTER (event_type = 'error'), 4) WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END AS delay FROM events GROUP BY 1")
def stream_scheduler(spark, sf_dir):
    counts = loops.drained(loops.failures(loops.event_stream(spark, sf_dir), "user_id", F.col("event_type") == "error"), "stream_scheduler", "complete")
    return counts.select("job", "failures", F.when(F.col("failures") > 0, names.retry_delay(F.col("failures"))).otherwise(0).alias("delay"))

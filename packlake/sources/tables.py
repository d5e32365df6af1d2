"""A chunk store as versioned tables.

``chunk_data`` holds bytes by pack, ``pack_entry`` is the index, ``pack_seal``
lets a damaged pack heal itself, ``snapshot``, ``snapshot_entry`` and
``snapshot_chunk`` are the recipes. A snapshot shows with all that it needs or
not at all.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions import chunking, codec, names, parity
from packlake.operators import files as catalog
from packlake.operators import listing, retention, store, verify
from packlake.operators.sizes import one_row
from packlake.schemas import CHUNK_AVG, CHUNK_MAX, CHUNK_MIN, MAX_INDEX_FILES, PACK_TARGET
from packlake.sources.versions import Changed, Versioned

TABLES = {
    "chunk_data": "pack string, chunk string, seq bigint, stored binary, size bigint, compressed boolean, folder string",
    "pack_entry": "pack string, chunk string, stored bigint, size bigint, compressed boolean, modified timestamp_ntz",
    "pack_seal": "pack string, length bigint, hashes array<string>, p binary, q binary",
    "snapshot_chunk": "name string, path string, seq int, chunk string, size bigint",
    "snapshot_entry": (
        "name string, path string, kind string, mode int, mtime bigint, mtime_ns bigint, uid int, gid int, "
        "link_target string, hard_target string, xattrs array<struct<name:string,value:binary>>"
    ),
    "snapshot": "job string, name string, created timestamp_ntz, size bigint, chunks bigint",
}
#: Packs that one task fills at most when a snapshot is written.
GROUP_PACKS = 16


class Store(Versioned):
    TABLES, DEALT = TABLES, {"chunk_data": "folder"}

    def __init__(self, spark: SparkSession, root: str, least: int = CHUNK_MIN, average: int = CHUNK_AVG, most: int = CHUNK_MAX, target: int = PACK_TARGET):
        super().__init__(spark, root)
        self.sizes, self.target = (least, average, most), target

    # -- write

    def _packed(self, rows: DataFrame, label: str) -> DataFrame:
        """Rows (chunk, size, stored, compressed, length) with their new packs. A
        group of ids fills about ``GROUP_PACKS`` packs, so a pack never exceeds its
        target by more than a chunk, and tasks grow in number with the bytes."""
        total = rows.agg(F.sum("length")).first()[0] or 0
        width = 0
        while 16**width * GROUP_PACKS * self.target < total:
            width += 1
        dealt = rows.withColumns({"group": F.substring("chunk", 1, width), "seq": F.lit(0).cast("bigint")})
        pack = F.sha2(F.concat_ws(":", F.lit(label), "group", F.col("pack_no").cast("string")), 256)
        dealt = store.assign_packs(dealt, "group", "chunk", "length", self.target)
        return dealt.withColumn("pack", pack).withColumn("folder", names.pack_folder(F.col("pack")))

    def ingest(self, files: DataFrame, job: str, created: datetime, now: datetime | None = None, entries: DataFrame | None = None, name: str | None = None) -> str:
        """Store the files (path, bytes) as a snapshot; its name.

        ``entries`` are rows of a scan: modes, times, owners, attributes, links
        and folders to keep with it. Without them every file has its path alone.
        """
        name = name or f"{job}-{created:%Y%m%dT%H%M%SZ}-{uuid.uuid4()}{names.SUFFIX}"
        if entries is None:
            kept = files.select("path", F.lit("file").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("mode", "int"), ("mtime", "bigint"), ("mtime_ns", "bigint"), ("uid", "int"), ("gid", "int"), ("link_target", "string"), ("hard_target", "string"), ("xattrs", "array<struct<name:string,value:binary>>"))])
        else:
            stored = entries.where("disposition = 'stored'")
            kept = stored if "hard_target" in stored.columns else stored.join(catalog.hardlink_targets(stored.where("kind = 'file'")).withColumnRenamed("target", "hard_target"), "path", "left")
        with self._staged(kept.select(F.lit(name).alias("name"), *[c for c in self._read("snapshot_entry", []).columns if c != "name"])) as kept:
            own = files.join(kept.where("kind = 'file' and hard_target is null").select("path"), "path", "left_semi")
            with self._staged(chunking.chunked(own, "path", "bytes", *self.sizes, keep_bytes=True)) as chunks:
                new = chunks.dropDuplicates(["chunk"]).join(self.table("pack_entry").select("chunk").distinct(), "chunk", "left_anti")
                form = new.select("chunk", "size", codec.compress(F.col("bytes")).alias("form")).select("chunk", "size", "form.stored", "form.compressed")
                with self._staged(form.withColumn("length", F.octet_length("stored").cast("bigint"))) as sized, self._staged(self._packed(sized, name)) as rows:
                    recipe = chunks.select(F.lit(name).alias("name"), "path", "seq", "chunk", "size")
                    total = recipe.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"), F.count(F.lit(1)).alias("chunks"))
                    added = {
                        "chunk_data": rows,
                        "pack_entry": rows.withColumns({"stored": F.col("length"), "modified": F.lit(now or created).cast("timestamp_ntz")}),
                        "pack_seal": parity.pack_seals(rows),
                        "snapshot_chunk": recipe,
                        "snapshot_entry": kept,
                        "snapshot": total.select(F.lit(job).alias("job"), F.lit(name).alias("name"), F.lit(created).cast("timestamp_ntz").alias("created"), "size", "chunks"),
                    }
                    self._add(added, lambda parts: not store.incomplete(recipe, self.table("pack_entry", parts)).limit(1).count())
        self._compact()
        return name

    def _compact(self) -> None:
        """Merge the index and the list of snapshots once they have too many parts."""
        version, parts = self._state()
        many = {name: self.table(name, parts) for name in ("pack_entry", "pack_seal", "snapshot") if len(parts.get(name, [])) > MAX_INDEX_FILES}
        if many:
            try:
                self._swap(version, parts, many)
            except Changed:
                pass  # the next writer finds it as long

    # -- read

    def snapshots(self, job: str | None = None) -> DataFrame:
        rows = self.table("snapshot")
        return listing.newest_first(rows if job is None else rows.where(F.col("job") == job))

    def packs(self) -> DataFrame:
        """pack, chunks, stored, by id."""
        return self.table("pack_entry").groupBy("pack").agg(F.count(F.lit(1)).alias("chunks"), F.sum("stored").alias("stored")).orderBy("pack")

    def list_sized(self) -> DataFrame:
        return listing.list_sized_stored(self.table("snapshot"), self.table("snapshot_chunk"), self.table("pack_entry"))

    def contents(self, wanted: DataFrame | None = None, parts: dict[str, list[str]] | None = None) -> DataFrame:
        """pack, chunk, bytes of what reads as its id says, of all chunks or of
        those in ``wanted``; others aren't decoded."""
        data = self.table("chunk_data", parts)
        if wanted is not None:
            data = data.join(wanted.select("chunk").distinct(), "chunk", "left_semi")
        plain = data.withColumn("bytes", codec.decompress(F.col("stored"), F.col("size"), F.col("compressed")))
        return plain.where(F.sha2("bytes", 256) == F.col("chunk")).select("pack", "chunk", "bytes")

    def entries(self, name: str) -> DataFrame:
        """The paths of a snapshot with what is known of them, and ``size``."""
        sizes = self.table("snapshot_chunk").where(F.col("name") == name).groupBy("path").agg(F.sum("size").alias("size"))
        rows = self.table("snapshot_entry").where(F.col("name") == name).drop("name")
        return rows.join(sizes, "path", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))

    def pieces(self, name: str, *peers: Store) -> DataFrame:
        """path, seq, bytes of the chunks of a snapshot's files, each from the
        first store that has it intact; bytes are null where none has."""
        recipe = self.table("snapshot_chunk").where(F.col("name") == name).drop("name")
        copies = self.contents(recipe).withColumn("priority", F.lit(0))
        for i, peer in enumerate(peers, 1):
            copies = copies.unionByName(peer.contents(recipe).withColumn("priority", F.lit(i)))
        best = verify.best_copies(copies, F.struct("priority", "pack"), F.lit(True))
        return recipe.join(best.select("chunk", "bytes"), "chunk", "left").select("path", "seq", "bytes")

    def restore(self, name: str, *peers: Store) -> DataFrame:
        """path, bytes of a snapshot's files, null where chunks are lost. A file's
        chunks come together to form it; ``pieces`` has those of larger files."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "bytes"))), lambda p: F.hex(p["bytes"]))
        formed = self.pieces(name, *peers).groupBy("path").agg(F.when(F.count_if(F.col("bytes").isNull()) == 0, F.unhex(F.array_join(parts, ""))).alias("bytes"), F.lit(True).alias("some"))
        rows = self.entries(name).where("kind = 'file'").select("path", F.coalesce("hard_target", "path").alias("source"))
        joined = rows.join(formed.withColumnRenamed("path", "source"), "source", "left")
        return joined.select("path", F.when(F.col("some").isNull(), F.lit(b"")).otherwise(F.col("bytes")).alias("bytes"))

    def damaged(self, parts: dict[str, list[str]] | None = None) -> DataFrame:
        """pack, chunk of what the index lists and doesn't read as its id says."""
        return self.table("pack_entry", parts).select("pack", "chunk").join(self.contents(parts=parts).select("pack", "chunk"), ["pack", "chunk"], "left_anti")

    def findings(self) -> DataFrame:
        """kind, item: what stands and what is damaged. A pack counts as damaged
        once nothing in it reads; other bad chunks are listed by themselves."""
        found, bad, recipes = self.table("pack_entry"), self.damaged(), self.table("snapshot_chunk")
        dead = bad.select("pack").distinct().join(found.join(bad, ["pack", "chunk"], "left_anti").select("pack").distinct(), "pack", "left_anti")
        torn = self.table("snapshot").groupBy("name").agg(F.sum("chunks").alias("chunks")).join(recipes.groupBy("name").agg(F.count(F.lit(1)).alias("listed")), "name", "left")
        return verify.findings(found, dead, bad, recipes, torn.where("chunks <> coalesce(listed, 0)").select("name"))

    def check(self) -> DataFrame:
        """The store check's one row; bad chunks of which another copy reads aren't clean either."""
        row = verify.summary(self.table("pack_entry").select("pack").distinct(), self.findings())
        return row.withColumn("clean", F.col("clean") & F.lit(not self.damaged().limit(1).count()))

    def verify(self, *peers: Store) -> DataFrame:
        """kind, item that stay damaged after a check, a repair by seals and peers,
        and another check."""
        if self.damaged().limit(1).count():
            self.repair(*peers)
        return self.findings().where("kind <> 'intact'")

    # -- maintain

    def prune(self, now: datetime, count: int | None = None, seconds: int | None = None) -> None:
        """Apply retention, then collect garbage; without a rule only the latter."""
        if count is not None or seconds is not None:
            version, parts = self._state()
            with self._staged(retention.apply(self.table("snapshot", parts), now, count, seconds)) as kept:
                left = {name: self.table(name, parts).join(kept.select("name"), "name", "left_semi") for name in ("snapshot_chunk", "snapshot_entry")}
                self._swap(version, parts, {"snapshot": kept, **left})
        self.collect_garbage(now)

    def collect_garbage(self, now: datetime) -> None:
        """Drop dead packs and rewrite sparse ones; young packs stay. Only parts
        that hold such packs are written anew; index and bytes change together.
        Of several copies of a chunk only one that reads lets the others go."""
        version, parts = self._state()
        found = self.table("pack_entry", parts)
        moment: Column = F.lit(now).cast("timestamp_ntz")
        old = store.old_enough(found, moment).select("pack").distinct()
        live = store.live_chunks(self.table("snapshot_chunk", parts).join(self.table("snapshot", parts).select("name"), "name", "left_semi"))
        several = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(live, "chunk", "left_semi").select("chunk")
        with self._staged(several) as several, self._staged(self._unread(found, several, parts)) as unread, self._staged(self._doomed(found, live, unread, old)) as doomed:
            if doomed.limit(1).count():
                data = self._read("chunk_data", parts["chunk_data"], with_part=True)
                hurt = [r["part"] for r in data.select("part", "pack").join(doomed, "pack", "left_semi").select("part").distinct().collect()]
                touched = self._read("chunk_data", hurt)
                moves = store.repack_moves(found.join(unread, ["pack", "chunk"], "left_anti"), live, doomed).select("chunk", "pack")
                moved = touched.join(moves, ["pack", "chunk"], "left_semi").select("chunk", "size", "stored", "compressed", F.octet_length("stored").cast("bigint").alias("length"))
                columns = [c.name for c in touched.schema]
                with self._staged(moved) as sized, self._staged(self._packed(sized, uuid.uuid4().hex)) as fresh:
                    index = found.join(doomed, "pack", "left_anti").unionByName(fresh.select("pack", "chunk", F.col("length").alias("stored"), "size", "compressed", moment.alias("modified")))
                    rest = touched.join(doomed, "pack", "left_anti").select(*columns).unionByName(fresh.select(*columns))
                    seals = self.table("pack_seal", parts).join(doomed, "pack", "left_anti").unionByName(parity.pack_seals(fresh))
                    self._swap(version, parts, {"pack_entry": index, "chunk_data": rest, "pack_seal": seals}, {"chunk_data": [p for p in parts["chunk_data"] if p not in hurt]})
        self.vacuum()

    @staticmethod
    def _doomed(found: DataFrame, live: DataFrame, unread: DataFrame, old: DataFrame) -> DataFrame:
        plan = store.gc_plan(found, live, unread=unread).join(old, "pack", "left_semi")
        return plan.where("verdict <> 'keep'").select("pack", "verdict")

    def _unread(self, found: DataFrame, several: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
        """pack, chunk of the copies of ``several`` chunks that don't read as their
        id says while another copy does. Only these chunks are decoded."""
        if not several.limit(1).count():
            return found.sparkSession.createDataFrame([], "pack string, chunk string")
        reads = self.contents(several, parts).select("pack", "chunk").withColumn("reads", F.lit(True))
        copies = found.join(several, "chunk", "left_semi").select("pack", "chunk").join(reads, ["pack", "chunk"], "left")
        packs = F.collect_set(F.when(F.col("reads").isNull(), F.col("pack")))
        return copies.groupBy("chunk").agg(packs.alias("packs"), F.bool_or("reads").alias("some")).where("some").select(F.explode("packs").alias("pack"), "chunk")

    def repair(self, *peers: Store) -> None:
        """Bring damaged chunks back, from the seal of their pack or else from the
        first peer that holds them intact. They go to new packs; a pack keeps its
        damaged rows while one of them can't be brought back."""
        version, parts = self._state()
        index, data, seals = (self.table(t, parts) for t in ("pack_entry", "chunk_data", "pack_seal"))
        with self._staged(self.damaged(parts)) as bad:
            hurt = bad.select("pack").distinct()
            good = index.join(bad, ["pack", "chunk"], "left_anti").select("chunk").distinct()
            wanted = bad.select("chunk").distinct().join(good, "chunk", "left_anti")
            listed = index.join(hurt, "pack", "left_semi").withColumnRenamed("stored", "length")
            own = parity.healed_packs(listed.join(data.select("pack", "chunk", "stored"), ["pack", "chunk"], "left"), seals.join(hurt, "pack", "left_semi"))
            copies = own.join(listed.select("pack", "chunk", "size", "compressed"), ["pack", "chunk"]).withColumn("priority", F.lit(0))
            for i, peer in enumerate(peers, 1):
                theirs = peer.table("chunk_data").select("pack", "chunk", "stored", "size", "compressed").withColumn("priority", F.lit(i))
                copies = copies.unionByName(theirs.join(peer.contents(wanted).select("pack", "chunk"), ["pack", "chunk"], "left_semi"))
            copies = copies.join(wanted, "chunk", "left_semi")
            sound = copies.withColumn("reads", F.sha2(codec.decompress(F.col("stored"), F.col("size"), F.col("compressed")), 256) == F.col("chunk"))
            best = verify.best_copies(sound, F.struct("priority", "pack"), F.col("reads")).select("chunk", "size", "stored", "compressed", F.octet_length("stored").cast("bigint").alias("length"))
            with self._staged(best) as found, self._staged(self._packed(found, uuid.uuid4().hex)) as fresh:
                cured = bad.join(good.unionByName(found.select("chunk")), "chunk", "left_semi")
                lost = bad.join(cured, ["pack", "chunk"], "left_anti").select("pack").distinct()
                with self._staged(cured.join(lost, "pack", "left_anti").select("pack", "chunk")) as gone:
                    if not gone.limit(1).count() and not fresh.limit(1).count():
                        return
                    # only parts with rows that go are written anew, beside those of the new packs
                    touched = self._read("chunk_data", parts["chunk_data"], with_part=True).select("part", "pack", "chunk").join(gone, ["pack", "chunk"], "left_semi")
                    old = [r["part"] for r in touched.select("part").distinct().collect()]
                    rest = self._read("chunk_data", old).join(gone, ["pack", "chunk"], "left_anti")
                    columns = data.columns
                    healed = gone.select("pack").distinct()
                    when = index.agg(F.max("modified").alias("modified"))
                    new = fresh.select("pack", "chunk", F.col("length").alias("stored"), "size", "compressed").join(one_row(when))
                    left = data.join(gone, ["pack", "chunk"], "left_anti").join(healed, "pack", "left_semi").select("pack", "chunk", "stored")
                    tables = {
                        "chunk_data": rest.select(*columns).unionByName(fresh.select(*columns)),
                        "pack_entry": index.join(gone, ["pack", "chunk"], "left_anti").select(*index.columns).unionByName(new.select(*index.columns)),
                        "pack_seal": seals.join(healed, "pack", "left_anti").unionByName(parity.pack_seals(left.unionByName(fresh.select("pack", "chunk", "stored")))),
                    }
                    self._swap(version, parts, tables, {"chunk_data": [p for p in parts["chunk_data"] if p not in old]})

    def copy_to(self, other: Store, name: str) -> None:
        """Send a snapshot: only the chunks that the other store lacks."""
        recipe = self.table("snapshot_chunk").where(F.col("name") == name)
        need = store.unique_missing(recipe, other.table("pack_entry")).select("chunk")
        intact = self.contents(need).select("pack", "chunk").distinct()
        best = verify.best_copies(self.table("chunk_data").join(intact, ["pack", "chunk"], "left_semi"), F.col("pack"), F.lit(True))
        best = best.select("chunk", "size", "stored", "compressed", F.octet_length("stored").cast("bigint").alias("length"))
        own = self.table("snapshot").where(F.col("name") == name)
        with self._staged(best) as sized, self._staged(other._packed(sized, uuid.uuid4().hex)) as rows:
            when = own.agg(F.max("created").alias("modified"))
            added = {
                "chunk_data": rows,
                "pack_entry": rows.drop("stored").withColumnRenamed("length", "stored").join(one_row(when)),
                "pack_seal": parity.pack_seals(rows),
                "snapshot_chunk": recipe,
                "snapshot_entry": self.table("snapshot_entry").where(F.col("name") == name),
                "snapshot": own,
            }
            other._add(added, lambda parts: not store.incomplete(recipe, other.table("pack_entry", parts)).limit(1).count())
        other._compact()

"""Schemas of the tables; every reader declares them and none is inferred."""

from __future__ import annotations

JOB = "name string, source string, destinations array<string>, cron string, retention struct<count:bigint,age_seconds:bigint>, pre string, exclude array<string>"
SNAPSHOT = "destination string, job string, name string, created timestamp_ntz, size bigint, checksum string"
SNAPSHOT_CHUNK = "destination string, name string, seq int, chunk string, size bigint"
PACK = "destination string, pack string, modified timestamp_ntz"
PACK_ENTRY = "destination string, pack string, chunk string, offset bigint, stored bigint, size bigint, compressed boolean"
CHUNK_DATA = "destination string, pack string, chunk string, bytes binary"
FILE = (
    "path string, kind string, len bigint, dev bigint, ino bigint, nlink bigint, mtime bigint, mtime_ns bigint, ctime bigint, ctime_ns bigint, "
    "mode int, uid int, gid int, link_target string, xattrs array<struct<name:string,value:binary>>, disposition string, reason string"
)
RUN = f"run_id string, job string, archive_name string, checksum string, size bigint, created_at bigint, completed_at bigint"  # noqa: F541
DELIVERY = "run_id string, destination string, delivered boolean, attempts int, next_retry bigint, last_error string"
SCHEDULE = "job string, last bigint"
RETRY = "job string, slot bigint, attempts int, next_retry bigint"
VERIFIED = "destination string, at bigint"
VERIFY_PROBLEM = "destination string, problem string"
IMPORT_FAILURE = "destination string, archive string, error string, at bigint"
EVENT = "event string, job string, archive string, bytes bigint, total bigint, error string"

# Limits that decide results.
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 256 << 10, 1 << 20, 4 << 20
PACK_TARGET = 32 << 20
DATA_PIECES, PARITY_PIECES = 64, 2
YOUNG_PACK_SECONDS = 3600
LIVE_PERCENT = 70
MAX_INDEX_FILES = 16
STALE_PARTIAL_SECONDS = 24 * 3600
BACKOFF_SECONDS = (60, 300, 900, 3600)
HISTORY_DAYS = 30
MILESTONE_DAYS = (7, 14, 30, 60, 90, 180, 365)
GRACE_SECONDS, BUSY_GRACE_SECONDS = 3600, 86_400
VERIFY_SECONDS, OVERDUE_SECONDS = 7 * 86_400, 8 * 86_400
IMPORT_RETRY_SECONDS = 24 * 3600
STALL_SECONDS = 900
STATE_ERROR_SECONDS = 60
PROGRESS_BYTES = 64 << 20
CHANGED_PATHS_SHOWN = 20

"""Archive names, content ids and back-off as column expressions.

An archive is named ``<job>-<yyyyMMddTHHmmssZ>-<uuid>.tar.lz4``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake.schemas import BACKOFF_SECONDS

SUFFIX = ".tar.lz4"
UUID_PART, STAMP_PART = 37, 17
STAMP = "yyyyMMdd'T'HHmmss'Z'"


def _stem_length(name: Column) -> Column:
    return F.length(name) - (len(SUFFIX) + UUID_PART)


def parsed_job(name: Column) -> Column:
    """The job of an archive name, or null if the name isn't one."""
    return F.when(is_archive_name(name), F.substring(name, F.lit(1), _stem_length(name) - STAMP_PART))


def parsed_created(name: Column) -> Column:
    """The time of an archive name as NTZ, or null."""
    stamp = F.substring(name, _stem_length(name) - (STAMP_PART - 2), F.lit(STAMP_PART - 1))
    return F.when(_shaped(name), F.try_to_timestamp(stamp, F.lit(STAMP)).cast("timestamp_ntz"))


def _shaped(name: Column) -> Column:
    stem = _stem_length(name)
    return (
        name.endswith(SUFFIX)
        & ~F.contains(name, F.lit("/"))
        & ~name.startswith(".")
        & (stem >= STAMP_PART)
        & (F.substring(name, stem - (STAMP_PART - 1), F.lit(1)) == "-")
    )


def parts(name: Column) -> Column:
    """An array with archive, job and created of a name that is one, else empty:
    for ``inline``, so that the name is worked out and parsed once."""
    job = lambda n: F.substring(n, F.lit(1), _stem_length(n) - STAMP_PART)
    one = F.transform(F.array(name), lambda n: F.struct(n.alias("archive"), job(n).alias("job"), parsed_created(n).alias("created")))
    return F.filter(one, lambda x: x["created"].isNotNull())


def is_archive_name(name: Column) -> Column:
    return _shaped(name) & parsed_created(name).isNotNull()


def archive_name(job: Column, created: Column, unique: Column) -> Column:
    return F.concat(job, F.lit("-"), F.date_format(created, STAMP), F.lit("-"), unique, F.lit(SUFFIX))


def renamed(name: Column, old: Column | str, new: Column | str) -> Column:
    """The name moved to another job; null unless it belongs to ``old``."""
    old = F.lit(old) if isinstance(old, str) else old
    new = F.lit(new) if isinstance(new, str) else new
    return F.when(parsed_job(name) == old, F.concat(new, F.substring(name, F.length(old) + 1, F.length(name))))


def content_id(data: Column) -> Column:
    """64 hex digits; lexicographic order is that of the bytes."""
    return F.sha2(data, 256)


def is_content_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def pack_folder(pack: Column) -> Column:
    """Packs are dealt over folders by their first two digits."""
    return F.substring(pack, 1, 2)


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait after so many failed attempts; the last delay repeats."""
    delays = F.array(*[F.lit(x) for x in BACKOFF_SECONDS])
    return F.element_at(delays, F.greatest(F.lit(1), F.least(attempts.cast("int"), F.lit(len(BACKOFF_SECONDS)))))


def piece_length(size: Column) -> Column:
    """Bytes of one of 64 data pieces: at least 2 and even."""
    each = F.greatest(F.ceil(size / 64), F.lit(2)).cast("long")
    return each + each % 2


def first_token(line: Column) -> Column:
    """The checksum of a checksum line."""
    return F.split(F.trim(line), "\\s+").getItem(0)


def unescaped_mount(field: Column) -> Column:
    """A mount point with its octal escapes decoded; they stand for ASCII."""
    decoded = lambda part: F.concat(F.chr(F.conv(F.substring(part, 1, 3), 8, 10).cast("int")), F.substring(part, F.lit(4), F.length(part)))
    parts = F.split(field, r"\\(?=[0-7]{3})")
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(decoded(part))), "")


def right_aligned(value: Column, width: int = 12) -> Column:
    """Text at the right of a column of a report; longer text isn't cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")

"""Locations: local paths and ``ssh://`` URIs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SSH = r"^ssh://(?:([^@/?#]*)@)?([^:/?#@]*)(?::([0-9]+))?(/[^?#]*)?$"
#: Characters that are written as percent escapes.
ESCAPED = [chr(c) for c in range(32)] + [" ", '"', "#", "?", "\x7f"]


def scheme(uri: Column) -> Column:
    return F.when(uri.startswith("ssh://"), F.lit("ssh")).otherwise(F.lit("local"))


def _part(uri: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(uri, SSH, group), F.lit(""))


def host(uri: Column) -> Column:
    return F.when(scheme(uri) == "ssh", _part(uri, 2))


def user(uri: Column) -> Column:
    return F.when(scheme(uri) == "ssh", _part(uri, 1))


def port(uri: Column) -> Column:
    return F.when(scheme(uri) == "ssh", _part(uri, 3).cast("int"))


def path(uri: Column) -> Column:
    """The decoded path of either kind."""
    return F.when(scheme(uri) == "ssh", F.try_url_decode(F.replace(_part(uri, 4), F.lit("+"), F.lit("%2B")))).otherwise(uri)


def error(uri: Column) -> Column:
    """Why the location isn't valid, or null."""
    where = path(uri)
    return (
        F.when((scheme(uri) == "ssh") & ~uri.rlike(SSH), F.lit("not an ssh location"))
        .when(F.contains(user(uri), F.lit(":")), F.lit("passwords are not allowed"))
        .when((scheme(uri) == "ssh") & host(uri).isNull(), F.lit("host is missing"))
        .when(host(uri).startswith("-") | user(uri).startswith("-"), F.lit("host or user starts with a dash"))
        .when(where.isNull() | ~where.startswith("/"), F.lit("path is not absolute"))
        .when(where.rlike(r"(^|/)\.\.(/|$)"), F.lit("path leads upwards"))
    )


def parsed(uri: Column) -> Column:
    return F.struct(scheme(uri).alias("scheme"), host(uri).alias("host"), user(uri).alias("user"), port(uri).alias("port"), path(uri).alias("path"))


def shown(where: Column) -> Column:
    """The URI of a ``parsed`` location."""
    text = F.replace(where["path"], F.lit("%"), F.lit("%25"))
    for c in ESCAPED:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name = F.when(where["user"].isNotNull(), F.concat(where["user"], F.lit("@"))).otherwise(F.lit(""))
    gate = F.when(where["port"].isNotNull(), F.concat(F.lit(":"), where["port"].cast("string"))).otherwise(F.lit(""))
    return F.when(where["scheme"] == "ssh", F.concat(F.lit("ssh://"), name, where["host"], gate, text)).otherwise(where["path"])


def folder_name(where: Column) -> Column:
    return F.element_at(F.split(F.rtrim(where, F.lit("/")), "/"), -1)


def sibling(where: Column, name: Column | str) -> Column:
    """The location with another last part."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.regexp_replace(F.rtrim(where, F.lit("/")), "[^/]+$", ""), name)


def contains(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` is ``outer`` or lies below it."""
    base = F.rtrim(outer, F.lit("/"))
    return (F.rtrim(inner, F.lit("/")) == base) | inner.startswith(F.concat(base, F.lit("/")))


def endpoints(places: DataFrame, uri: str = "uri") -> DataFrame:
    """host, user, port, uri, places: each remote end once, with its least uri, so
    that a probe asks each end once."""
    where = F.col(uri)
    ends = places.where(scheme(where) == "ssh").select(host(where).alias("host"), user(where).alias("user"), port(where).alias("port"), where.alias("uri"))
    return ends.groupBy("host", "user", "port").agg(F.min("uri").alias("uri"), F.count(F.lit(1)).alias("places"))


def same_host(a: Column, b: Column) -> Column:
    return host(a).eqNullSafe(host(b)) & user(a).eqNullSafe(user(b)) & port(a).eqNullSafe(port(b))

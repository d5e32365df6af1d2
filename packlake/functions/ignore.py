"""Exclusion patterns in the style of ignore files, as regular expressions and
as one column expression: the last pattern that matches a path or one of its
parents decides, and nothing below an excluded folder comes back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    regex: str
    include: bool
    folders_only: bool


def compiled(line: str) -> Pattern | None:
    """A pattern line, or None for blanks and comments."""
    line = line.rstrip("\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    include = line.startswith("!")
    line = line[1:] if include else line
    folders_only = line.endswith("/")
    line = line.rstrip("/") if folders_only else line
    rooted = "/" in line
    body, parts = "", line.lstrip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            body += ".*" if last else "(?:[^/]+/)*"
            continue
        body += _part(part) + ("" if last else "/")
    return Pattern("^" + ("" if rooted else "(?:.*/)?") + body + "$", include, folders_only)


def _part(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while text[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inner = text[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        else:
            if c == "\\" and i + 1 < len(text):
                i, c = i + 1, text[i + 1]
            out += re.escape(c) if not c.isalnum() else c
        i += 1
    return out


def _verdict(path: Column, is_folder: Column, patterns: list[Pattern]) -> Column:
    """True excluded, false included again, null untouched."""
    out = F.lit(None).cast("boolean")
    for p in patterns:
        hit = path.rlike(p.regex)
        if p.folders_only:
            hit = hit & is_folder
        out = F.when(hit, F.lit(not p.include)).otherwise(out)
    return out


def excluded(path: Column, is_folder: Column, lines: list[str]) -> Column:
    """Whether a relative path is excluded, by itself or by a parent."""
    patterns = [p for line in lines if (p := compiled(line))]
    if not patterns:
        return F.lit(False)
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = (F.size(parts) > 1) & F.exists(parents, lambda p: F.coalesce(_verdict(p, F.lit(True), patterns), F.lit(False)))
    return above | F.coalesce(_verdict(path, is_folder, patterns), F.lit(False))

"""Job configuration from TOML, validated as a whole before use."""

from __future__ import annotations

import re
import tomllib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from packlake.functions.durations import Cron, seconds
from packlake.schemas import JOB

NAME = re.compile(r"^[A-Za-z0-9._-]+$")
KEYS = {"name", "source", "destinations", "cron", "retention", "pre", "exclude"}


@dataclass
class Job:
    name: str
    source: str
    destinations: list[str]
    cron: str
    count: int | None = None
    age_seconds: int | None = None
    pre: str | None = None
    exclude: list[str] = field(default_factory=list)


def problems(jobs: list[dict]) -> list[str]:
    """Everything that is wrong, by job."""
    out = []
    for name, n in Counter(j.get("name") for j in jobs).items():
        if n > 1:
            out.append(f"{name}: the name is used {n} times")
    for job in jobs:
        name = job.get("name")
        say = lambda text: out.append(f"{name}: {text}")  # noqa: B023, E731
        if unknown := set(job) - KEYS:
            say(f"unknown keys {', '.join(sorted(unknown))}")
        if not isinstance(name, str) or not NAME.match(name) or name in (".", ".."):
            say("the name has other characters than letters, digits, dot, dash and underscore")
        source, places = job.get("source", ""), job.get("destinations", [])
        if not source:
            say("the source is missing")
        if not places:
            say("there is no destination")
        if len(set(places)) < len(places):
            say("a destination is named twice")
        for place in places:
            inside = place.rstrip("/") == source.rstrip("/") or place.startswith(source.rstrip("/") + "/")
            if source and inside:
                say(f"the destination {place} lies in the source")
        try:
            Cron(job.get("cron", ""))
        except ValueError as e:
            say(str(e))
        rule = job.get("retention")
        if rule is not None:
            if set(rule) - {"count", "age"} or len(rule) != 1:
                say("retention takes either count or age")
            elif "count" in rule and rule["count"] < 1:
                say("retention keeps at least one")
            elif "age" in rule:
                try:
                    if seconds(rule["age"]) <= 0:
                        say("retention has no age")
                except ValueError as e:
                    say(str(e))
    return out


def parse(text: str) -> list[Job]:
    found = tomllib.loads(text)
    jobs = found.get("job", [])
    wrong = problems(jobs) + [f"unknown section {k}" for k in found if k != "job"]
    if wrong:
        raise ValueError("; ".join(wrong))
    return [
        Job(j["name"], j["source"], j["destinations"], j["cron"], (r := j.get("retention", {})).get("count"), seconds(r["age"]) if "age" in r else None, j.get("pre"), j.get("exclude", []))
        for j in jobs
    ]


def load(path: str) -> list[Job]:
    with open(path) as f:
        return parse(f.read())


def reload(path: str, before: list[Job]) -> list[Job]:
    """The new configuration, or the one before while the new isn't valid."""
    try:
        return load(path)
    except (ValueError, OSError):
        return before


def job_table(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    rows = [(j.name, j.source, j.destinations, j.cron, (j.count, j.age_seconds) if j.count or j.age_seconds else None, j.pre, j.exclude) for j in jobs]
    return spark.createDataFrame(rows, JOB)


def find(jobs: list[Job], name: str) -> Job:
    for job in jobs:
        if job.name == name:
            return job
    raise ValueError(f"unknown job: {name}")


def renamed(jobs: list[Job], old: str, new: str) -> tuple[list[Job], list[tuple[str, str]]]:
    """The configuration with a job renamed, and destinations that follow:
    those whose last folder is the job's name."""
    if any(j.name == new for j in jobs):
        raise ValueError(f"the name is taken: {new}")
    job, moves = find(jobs, old), []
    places = []
    for place in job.destinations:
        head, _, last = place.rstrip("/").rpartition("/")
        if last == old:
            moves.append((place, f"{head}/{new}"))
            place = moves[-1][1]
        places.append(place)
    changed = Job(new, job.source, places, job.cron, job.count, job.age_seconds, job.pre, job.exclude)
    return [changed if j is job else j for j in jobs], moves

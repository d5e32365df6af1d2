"""Runs, deliveries, schedules, retries and checks as versioned tables.

A transaction is a function from tables to changed tables; what it returns shows
in one step. When another writer comes first it runs again on the new version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.operators import state
from packlake.schemas import DELIVERY, HISTORY_DAYS, IMPORT_FAILURE, IMPORT_RETRY_SECONDS, RETRY, RUN, SCHEDULE, VERIFIED, VERIFY_PROBLEM
from packlake.sources.versions import Changed, Versioned

KEYS = {
    "run": ["run_id"], "delivery": ["run_id", "destination"], "schedule": ["job"], "retry": ["job", "slot"],
    "verified": ["destination"], "verify_problem": ["destination", "problem"], "import_failure": ["destination", "archive"],
}


class State(Versioned):
    TABLES = {
        "run": RUN, "delivery": DELIVERY, "schedule": SCHEDULE, "retry": RETRY,
        "verified": VERIFIED, "verify_problem": VERIFY_PROBLEM, "import_failure": IMPORT_FAILURE,
    }

    def change(self, step: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]) -> None:
        """Put the tables that ``step`` makes of the present ones in their place."""
        while True:
            version, parts = self._state()
            try:
                return self._swap(version, parts, step(lambda name, parts=parts: self.table(name, parts)))
            except Changed:
                continue

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows in the place of those with their keys."""
        self.change(lambda table: {name: state.upserted(table(name), rows.select(*table(name).columns), KEYS[name])})

    def delete(self, name: str, keys: DataFrame) -> None:
        self.change(lambda table: {name: table(name).join(keys, KEYS[name], "left_anti").select(*table(name).columns)})

    def register(self, runs: DataFrame, results: DataFrame, now: Column) -> None:
        """New runs (those of ``run``, and destinations) with their deliveries. A
        run that is there already stays as it is."""

        def step(table):
            old = table("run")
            new = runs.join(old.select("run_id"), "run_id", "left_anti")
            made = state.registered(new, results, now).select(*table("delivery").columns)
            return {"run": old.unionByName(new.select(*old.columns)), "delivery": table("delivery").unionByName(made)}

        self.change(step)

    def mark(self, results: DataFrame, now: Column) -> None:
        """Deliveries after attempts, and the runs that these complete."""

        def step(table):
            after = state.marked(table("delivery"), results, now)
            return {"delivery": after, "run": state.completed(table("run"), after, now)}

        self.change(step)

    def purge(self, now: int, days: int = HISTORY_DAYS) -> None:
        """Forget runs that were complete so long ago, and import failures that no
        longer hold anything back."""

        def step(table):
            runs, deliveries = state.purged(table("run"), table("delivery"), F.lit(now - days * 86_400))
            return {"run": runs, "delivery": deliveries, "import_failure": table("import_failure").where(F.col("at") > now - IMPORT_RETRY_SECONDS)}

        self.change(step)

    def forget(self, job: str) -> None:
        self.change(lambda table: dict(zip(("run", "delivery"), state.forgotten(table("run"), table("delivery"), job), strict=True)))

    def rename(self, old: str, new: str, moves: DataFrame | None = None) -> None:
        """Move a job to another name; open deliveries forbid it."""

        def step(table):
            if state.blocked_rename(table("run"), table("delivery"), old).first()["blocked"]:
                raise ValueError(f"{old}: deliveries are still open")
            return dict(zip(("run", "delivery", "schedule"), state.renamed_job(table("run"), table("delivery"), table("schedule"), old, new, moves), strict=True))

        self.change(step)

    def verified(self, destination: str, at: int, problems: DataFrame) -> None:
        """Note a check of a destination: its time, whatever came of it, and what
        it found (problem) in the place of what was found before."""

        def step(table):
            time = self.spark.createDataFrame([(destination, at)], VERIFIED)
            found = problems.select(F.lit(destination).alias("destination"), "problem")
            kept = table("verify_problem").where(F.col("destination") != destination)
            return {"verified": state.upserted(table("verified"), time, ["destination"]), "verify_problem": kept.unionByName(found)}

        self.change(step)

"""Small documents that several jobs change: a model registry and a lease, each on a log whose numbers are given once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.snapshots import Conflict, VersionLog

STAGING, PRODUCTION, ARCHIVED = "Staging", "Production", "Archived"
MODELS = "version int, stage string, run_id string, val_mae double, created_at timestamp_ntz, tags map<string,string>"


class Registry:
    """Versions of a model, their stages and tags. Each change is made on the state that was read, or not at all (Conflict)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, VersionLog(spark, folder)

    def state(self) -> tuple[int, list[dict]]:
        number = self.log.last()
        return number, self.log.get(number).get("models", [])

    def table(self) -> DataFrame:
        """All versions: some hundreds at most."""
        rows = [(m["version"], m["stage"], m["run_id"], m["val_mae"], datetime.fromisoformat(m["created_at"]), m["tags"]) for m in self.state()[1]]
        return self.spark.createDataFrame(rows, MODELS)

    def register(self, run_id: str, val_mae: float | None, parameters: dict, created_at: datetime, times: int = 5) -> int:
        """A new version without a stage; its number. Registering commutes, so a lost race is run again."""
        for turn in range(times):
            number, models = self.state()
            version = 1 + max([0, *(m["version"] for m in models)])
            new = {"version": version, "stage": "None", "run_id": run_id, "val_mae": val_mae, "created_at": created_at.isoformat(), "tags": {}, "parameters": parameters}
            try:
                self.log.put(number + 1, {"models": [*models, new]})
                return version
            except Conflict:
                if turn == times - 1:
                    raise
        raise AssertionError

    def newest(self, stage: str) -> dict | None:
        """The highest version in a stage."""
        return max((m for m in self.state()[1] if m["stage"] == stage), key=lambda m: m["version"], default=None)

    def change(self, version: int, stage: str | None = None, tags: dict[str, str] | None = None, seen: int | None = None) -> None:
        """Puts a version into a stage, archives what was in Production before if that is the stage, and adds tags, in one step.

        `seen` is the state's number that the change was decided on; without it the present one.
        """
        number, models = self.state()
        out = []
        for m in models:
            if m["version"] == version:
                m = {**m, "stage": stage or m["stage"], "tags": {**m["tags"], **(tags or {})}}
            elif stage == PRODUCTION and m["stage"] == PRODUCTION:
                m = {**m, "stage": ARCHIVED}
            out.append(m)
        self.log.put((number if seen is None else seen) + 1, {"models": out})

    def promote(self) -> int:
        """The newest Staging version becomes Production, the old one is archived; LookupError if none is in Staging."""
        seen, models = self.state()
        staged = [m["version"] for m in models if m["stage"] == STAGING]
        if not staged:
            raise LookupError("no version is in Staging")
        self.change(max(staged), PRODUCTION, seen=seen)
        return max(staged)


class Lease:
    """Who may run a job now, until when, and when it last began. A dead owner's lease runs out."""

    def __init__(self, spark: SparkSession, folder: str, minutes: float = 60):
        self.log, self.length = VersionLog(spark, folder), timedelta(minutes=minutes)

    def last_run(self) -> datetime | None:
        at = self.log.get(self.log.last()).get("last_run")
        return datetime.fromisoformat(at) if at else None

    def take(self, owner: str, now: datetime) -> bool:
        """Whether `owner` has the lease from now on; the run counts from here, however it ends."""
        number = self.log.last()
        held = self.log.get(number)
        if held.get("owner") and datetime.fromisoformat(held["until"]) > now:
            return False
        try:
            self.log.put(number + 1, {"owner": owner, "until": (now + self.length).isoformat(), "last_run": now.isoformat()})
            return True
        except Conflict:
            return False

    def give_back(self, owner: str) -> None:
        """Ends the lease if `owner` still has it."""
        number = self.log.last()
        held = self.log.get(number)
        if held.get("owner") == owner:
            self.log.put(number + 1, {"owner": None, "until": None, "last_run": held["last_run"]})

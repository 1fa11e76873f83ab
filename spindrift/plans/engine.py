"""The stage runner: reuse by configuration hash, dry runs, budgets, one retry, and a lock; around lazy DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import cache
from ..storage import Files, stored

#: Seconds after which a lock counts as left behind.
STALE = 3 * 3600


def config_hash(config: dict) -> str:
    """As operators.cache.config_hash, for a configuration on the driver."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


class BudgetExceeded(Exception):
    pass


@dataclass
class Stage:
    """A named step: config(inputs) is what its result depends on, run(inputs) makes it, estimate its cost in dollars, cost what it did cost: a sum of its rows, counted while they are written, or a function of the stored result."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    config: Callable[[], dict] = dict
    estimate: float = 0.0
    cost: Column | Callable[[DataFrame], float] | None = None


@dataclass
class Engine:
    """Runs stages in order over one folder of any store that Spark reaches; results are Parquet tables below it and a JSON record of hashes, costs and runs. What the engine does is told to log."""

    spark: SparkSession
    folder: str
    stages: list[Stage]
    budget: float = 1.0
    log: Callable[[str], None] = lambda line: None
    record: dict = field(default_factory=lambda: {"stages": {}, "runs": []})

    def __post_init__(self) -> None:
        self.files = Files(self.spark)
        if self.files.exists(self._file):
            self.record = json.loads(self.files.text(self._file))

    @property
    def _file(self) -> str:
        return f"{self.folder}/manifest.json"

    def _save(self) -> None:
        self.files.write(self._file, json.dumps(self.record, ensure_ascii=False))

    def charge(self, spent: float, usd: float, what: str) -> None:
        if spent + usd > self.budget:
            raise BudgetExceeded(f"{what}: {spent + usd:.4f} is more than {self.budget}")

    def invalidate(self, name: str) -> None:
        """Drops the records of a stage and all later ones."""
        names = [s.name for s in self.stages]
        for later in names[names.index(name) :]:
            self.record["stages"].pop(later, None)

    def run(self, until: str | None = None, dry_run: bool = False, force: bool = False) -> dict[str, DataFrame]:
        """Results by stage; the run is recorded even if it fails."""
        run = {"started": time.time(), "dry_run": dry_run, "force": force, "stages_run": [], "stages_cached": [], "usd": 0.0}
        out: dict[str, DataFrame] = {}
        parent = None
        try:
            for stage in self.stages:
                key = config_hash({**stage.config(), "parent": parent})
                known, path = self.record["stages"].get(stage.name), f"{self.folder}/{stage.name}"
                if not force and known and known["config_hash"] == key and self.files.exists(f"{path}/_SUCCESS"):
                    self.log(f"{stage.name}: cached")
                    run["stages_cached"].append(stage.name)
                    out[stage.name] = self.spark.read.parquet(path)
                elif dry_run:
                    run["usd"] += stage.estimate
                else:
                    self.charge(run["usd"], stage.estimate, stage.name)
                    made, told = stage.run(dict(out)), Observation()
                    counted = isinstance(stage.cost, Column)
                    made = made.observe(told, F.coalesce(stage.cost, F.lit(0.0)).cast("double").alias("usd")) if counted else made
                    made.write.mode("overwrite").parquet(path)
                    out[stage.name] = self.spark.read.parquet(path)
                    usd = told.get["usd"] if counted else stage.cost(out[stage.name]) if stage.cost else 0.0
                    self.invalidate(stage.name)
                    self.record["stages"][stage.name] = {"config_hash": key, "usd": usd, "finished_at": time.strftime("%Y-%m-%dT%H:%M:%S")}
                    run["usd"] = round(run["usd"] + usd, 6)
                    self.log(f"{stage.name}: done, {usd:.4f} dollars")
                    run["stages_run"].append(stage.name)
                parent = key
                if until and stage.name.startswith(until):
                    break
        finally:
            if not dry_run:
                self.record["runs"].append(run)
                self._save()
            self.last_run = run
        return out


def retried_once(rows: DataFrame, check: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: check adds ok; what fails goes through again once and is checked once more.

    Both passes are stored before they are split, so each failing row is asked for again once (once more only if a task is lost), however often the results are read. A row that again leaves out is rejected as it was; keys tell rows apart.
    """
    first = stored(check(rows))
    failing = first.where(~F.coalesce("ok", F.lit(False)))
    second = stored(check(again(failing.select(rows.columns))))
    left = failing.join(second.select(*keys), keys, "left_anti").select(first.columns)
    both = first.where("ok").unionByName(second).unionByName(left)
    return both.where("ok").drop("ok"), both.where(~F.coalesce("ok", F.lit(False))).drop("ok")


class Lock:
    """One process at a time in a folder: a file that only one writer can make; one older than three hours is taken over. With a session the folder may be in any store that Spark reaches."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.path, self.files = f"{folder}/.lock", Files(spark) if spark else None

    def _make(self) -> None:
        if self.files:
            self.files.write(self.path, str(os.getpid()), anew=True)
            return
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path, "x") as f:
            f.write(str(os.getpid()))

    def _age(self) -> float:
        return self.files.age(self.path) if self.files else time.time() - os.path.getmtime(self.path)

    def _remove(self) -> None:
        if self.files:
            self.files.delete(self.path)
        elif os.path.exists(self.path):
            os.unlink(self.path)

    def __enter__(self) -> Lock:
        for last in (False, True):
            try:
                self._make()
                return self
            except FileExistsError:
                if last or self._age() < STALE:
                    raise RuntimeError(f"{self.path} is held") from None
                self._remove()
        raise AssertionError

    def __exit__(self, *_) -> None:
        self._remove()


__all__ = ["BudgetExceeded", "Engine", "Lock", "Stage", "cache", "config_hash", "retried_once"]

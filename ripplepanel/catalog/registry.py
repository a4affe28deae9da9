"""Where queries register, and the shared tables they start from."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ripplepanel.functions.columns import present
from ripplepanel.operators.panel import cells_of
from ripplepanel.plans import binding
from ripplepanel.session import cut, scratch_root

_SECTIONS = ("trips", "panels", "geography", "effects", "weights", "learned", "reports")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}
_TABLES: dict[tuple, DataFrame] = {}


class Context:
    """One session and data folder, with the tables later steps share.

    Panels, feature tables and fitted results are written once per session and
    read from there on, so a step never repeats the work of the step before.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.policy = binding.STAR_POLICY

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _TABLES:
            _TABLES[key] = cut(build(), name)
        return _TABLES[key]

    def table(self, name: str) -> DataFrame:
        return binding.table(self.spark, self.sf_dir, name)

    def trips(self) -> DataFrame:
        return binding.star_clean(self.spark, self.sf_dir)

    def days(self) -> DataFrame:
        """Cells of days: the one pass over the trips that all panels come from."""
        return self.shared("days", lambda: cells_of(self.trips(), "day"))

    def panel(self, unit: str = "month", min_trips: int = 5) -> DataFrame:
        return self.shared(
            f"panel_{unit}_{min_trips}",
            lambda: binding.star_panel_with_dose(
                self.spark, self.sf_dir, unit, min_trips, None if unit == "hour" else self.days()))

    def weeks(self) -> DataFrame:
        """Week panel with every cell of every week."""
        return self.panel("week", 1)

    def folder(self, name: str) -> str:
        tag = self.sf_dir.strip("/").replace("/", "_")
        return f"{scratch_root(self.spark)}/{tag}/{name}"


def query(name: str, sql: str | None = None, keep: tuple[str, ...] = ()):
    """Register ``fn(ctx)`` under ``name`` with its SQL check, if it has one."""

    def register(fn: Callable[[Context], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Context(spark, sf_dir)), keep)

        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return fn

    return register


def load_all() -> dict[str, Entry]:
    for section in _SECTIONS:
        importlib.import_module(f"ripplepanel.catalog.{section}")
    return CATALOG

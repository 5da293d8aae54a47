"""The end-to-end job (D37): sources in; summary, weekly panel, counters out.

Each part is made when an output first asks for it, and once:

1. bills: cleaned, last copy per BSEG_ID (exchange by BSEG_ID), written to
   the checkpoint folder, since the other parts read them;
2. per-SP season statistics in one aggregate (exchange by SP_ID) and the
   candidate filter on it, written and measured: the bytes decide whether
   later joins broadcast the candidates;
3. contacts, medians and premise lists: bills reduced to candidates first;
4. reads: one pass (``read_pass``), written as one row per meter;
5. summary, panel and counters: joins of per-SP tables.

The tables lie in the folder of ``spark.checkpoint.dir`` until ``release()``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hydrosight.operators.bills import (
    JOB_BILL_COLUMNS,
    clean_bills,
    screen,
    season_base,
    summer_year,
    with_details,
)
from hydrosight.operators.diagnostics import coverage_report, diagnostic_rows, diagnostics
from hydrosight.operators.joins import join_checked, table_bytes
from hydrosight.operators.panel import weekly_panel
from hydrosight.operators.people import clean_people, sp_contacts
from hydrosight.operators.read_pass import (
    covered_metrics,
    day_rows,
    per_service_point,
    read_days,
    read_rows,
)
from hydrosight.operators.summary import build_summary, with_parcel
from hydrosight.params import DEFAULT, Params
from hydrosight.session import drop_tables, materialize
from hydrosight.sources.schemas import METRIC_COLUMNS, THRESHOLD_COLUMNS, week_columns
from hydrosight.sources.testdata import Sources


class Job:
    """``candidates_only=False`` keeps the reads of every service point: the
    metrics and counters then cover those without a threshold too."""

    def __init__(self, spark: SparkSession, src: Sources, p: Params = DEFAULT, candidates_only: bool = True):
        self.spark, self.src, self.p, self.candidates_only = spark, src, p, candidates_only
        self.tables: list[str] = []
        self.counted: dict[str, Observation] = {}

    def _keep(self, df: DataFrame) -> DataFrame:
        return materialize(df, self.tables)

    def _counting(self, name: str, df: DataFrame) -> DataFrame:
        """Counts the source's rows on their one way through."""
        self.counted[name] = Observation(name)
        return df.observe(self.counted[name], F.count(F.lit(1)).alias("n"))

    def release(self) -> None:
        """Delete the job's tables; its outputs cannot be read afterwards."""
        drop_tables(self.spark, self.tables)

    # --- bills
    @cached_property
    def usage(self) -> DataFrame:
        return self._keep(clean_bills(self._counting("consumption", self.src.bills), self.p, JOB_BILL_COLUMNS))

    @cached_property
    def summer_year(self) -> int | None:
        return summer_year(self.usage).first()["summer_year"]

    @cached_property
    def candidates(self) -> DataFrame:
        return self._keep(screen(season_base(self.usage, self.p), self.p))

    @cached_property
    def candidate_count(self) -> int:
        return self.candidates.count()

    @cached_property
    def thresholds(self) -> DataFrame:
        return self.candidates.select("SP_ID", *THRESHOLD_COLUMNS)

    @cached_property
    def threshold_bytes(self) -> int:
        return table_bytes(self.thresholds)

    @cached_property
    def candidate_usage(self) -> DataFrame:
        return join_checked(self.usage, self.candidates.select("SP_ID"), "SP_ID", "left_semi",
                            self.threshold_bytes, "BSEG_ID", self.p)

    # --- people
    @cached_property
    def people(self) -> DataFrame:
        return self._keep(clean_people(self._counting("person", self.src.person), self.p))

    @cached_property
    def contacts(self) -> DataFrame:
        return sp_contacts(self.candidate_usage, self.people)

    # --- reads
    @cached_property
    def reads(self) -> DataFrame:
        return read_rows(self.src.reads, self.thresholds, self.threshold_bytes, self.summer_year, self.p,
                         self.candidates_only)

    @cached_property
    def days(self) -> DataFrame:
        return read_days(self.reads, self.p)

    @cached_property
    def day_table(self) -> DataFrame:
        return day_rows(self.days, self.summer_year, self.p)

    @cached_property
    def stats(self) -> DataFrame | None:
        return None if self.src.reads is None else self._keep(per_service_point(self.day_table, self.p))

    @cached_property
    def metrics(self) -> DataFrame:
        if self.stats is None:
            cols = ", ".join(f"{c} double" for c in METRIC_COLUMNS + week_columns(self.p.week_count))
            return self.spark.createDataFrame([], f"SP_ID string, {cols}")
        return covered_metrics(self.stats, self.p)

    # --- outputs
    @cached_property
    def panel(self) -> DataFrame:
        return weekly_panel(self.thresholds, self.metrics, self.p, self.candidates_only)

    @cached_property
    def summary(self) -> DataFrame:
        detailed = with_details(self.candidates, self.candidate_usage)
        return with_parcel(build_summary(self.contacts, detailed, self.metrics, self.p), self.src.parcel)

    @cached_property
    def _diagnostic_rows(self) -> DataFrame:
        # the counters need the summary's service points and their coverage, no contact data
        coverage = self.contacts.select("SP_ID").join(
            self.metrics.select("SP_ID", "summer_drc_coverage_days"), "SP_ID", "left")
        return diagnostic_rows(self.candidate_count, self.stats, coverage, self.p)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return diagnostics(self._diagnostic_rows)

    @cached_property
    def report(self) -> DataFrame:
        rows = self._diagnostic_rows
        _ = self.usage, self.people  # counted as they were written
        sources = {name: int(seen.get["n"]) for name, seen in self.counted.items()}
        if self.stats is not None:
            sources["drc"] = self.stats.agg(F.coalesce(F.sum("n_raw"), F.lit(0))).first()[0]
        return coverage_report(rows, sources)


def build(spark: SparkSession, src: Sources, p: Params = DEFAULT, candidates_only: bool = True) -> Job:
    return Job(spark, src, p, candidates_only)

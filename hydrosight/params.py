"""Job parameters.

Fixed values: the numbers and code lists below must equal the screening
rules the job reproduces, or its results change. They are stated here once,
in natural order, and every operator takes them from a ``Params`` instance.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # --- fixed values (unit conversions, screening rules) -------------------
    ccf_to_kgal: float = 0.7480519
    gal_to_kgal: float = 0.001
    min_bill_days: float = 20.0
    max_bill_days: float = 40.0
    min_triple_daily_kgal: float = 0.3
    summer_winter_ratio: float = 2.0
    min_summer_mean_kgal: float = 3.0
    summer_months: tuple[int, ...] = (4, 5, 6, 7, 8, 9)
    summer_start_month: int = 4
    summer_end_month: int = 10
    week_count: int = 26
    seconds_per_day: float = 86400.0
    threshold_multiple: float = 3.0
    normalised_days: float = 30.0
    subdaily_cut_days: float = 0.99
    coverage_report_days: float = 170.0
    service_types: tuple[str, ...] = ("WRES", "WRESSEW", "WRESIRR", "WRECRES")
    ccf_units: tuple[str, ...] = ("CCF",)
    gal_units: tuple[str, ...] = ("GAL",)
    # letters of the service-type code, in output order
    service_letters: tuple[tuple[str, str], ...] = (
        ("WRES", "W"),
        ("WRESSEW", "S"),
        ("WRESIRR", "I"),
        ("WRECRES", "R"),
    )
    # canonical phone types and the codes folded into each, in rule order
    phone_types: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("CELL", ("CELL", "CEL", "MOBILE", "MOB")),
        ("HOME", ("HOME", "HM")),
        ("WORK", ("WORK", "WK", "BUS", "BUSINESS")),
    )
    # --- execution knobs (not semantics) ------------------------------------
    # text form of timestamps in the raw files: None = ISO text
    # ('yyyy-MM-dd HH:mm[:ss[.ffffff]]') through Spark's fast cast, else a
    # a form of functions/formats.py, "infer" (found from all rows of the source, one pass more),
    # or a datetime pattern for to_timestamp_ntz
    ts_format: str | None = None
    # patterns of single columns, as (column, pattern) pairs; they go first
    ts_formats: tuple[tuple[str, str], ...] = ()
    # a join side is broadcast only when its counted bytes stay below this
    broadcast_max_bytes: int = 64 << 20

    def format_of(self, column: str) -> str | None:
        return dict(self.ts_formats).get(column, self.ts_format)

    def with_forms(self, forms: dict[str, str]) -> Params:
        """These parameters with a form for columns that name none."""
        named = dict(self.ts_formats)
        return replace(self, ts_formats=self.ts_formats + tuple((c, f) for c, f in forms.items() if c not in named))

    @property
    def supported_units(self) -> tuple[str, ...]:
        return self.ccf_units + self.gal_units


DEFAULT = Params()

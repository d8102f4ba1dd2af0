"""Operator parameters as frozen dataclasses (values become plan literals)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass


@dataclass(frozen=True)
class EmergenceConfig:
    # Defaults of the emergence methodology (fixed values).
    time_window_days: int = 30
    prior_window_days: int = 30
    seasonality_window_days: int = 90
    growth_threshold: float = 1.5
    top_n_rank: int = 5
    top_n_emerging: int = 10
    min_current_volume: int = 10
    min_prior_volume: int = 5
    top_issues_per_product: int = 5
    persistence_min_runs: int = 1
    hide_new_until_persistent: bool = False
    # Month column of a table written by month ("month" for tables that ingest wrote); None for others.
    partition_column: str | None = None
    # Relative error up to which distinct states may be estimated; None counts them exactly.
    distinct_states_rsd: float | None = None


@dataclass(frozen=True)
class IngestConfig:
    # Regex searched (case-insensitive) in the company name; empty = keep all.
    company_filter_pattern: str = ""
    # Dedup key, used for the columns present (fixed values).
    dedup_subset: tuple[str, ...] = (
        "complaint_id",
        "date_received",
        "product",
        "issue",
        "consumer_complaint_narrative",
    )
    min_filtered_rows: int = 100
    source_url: str = ""


@dataclass(frozen=True)
class SliceSpec:
    """A dashboard-style slice: inclusive date range plus an optional LOB."""

    start: _dt.date
    end: _dt.date
    lob: str | None = None  # None = all lines of business

    @property
    def window_days(self) -> int:
        return max(1, (self.end - self.start).days + 1)

    @property
    def prior_start(self) -> _dt.date:
        return self.start - _dt.timedelta(days=self.window_days)

    @property
    def baseline_days(self) -> int:
        return max(self.window_days * 3, 90)

    def emergence_config(self, base: EmergenceConfig = EmergenceConfig()) -> EmergenceConfig:
        from dataclasses import replace

        return replace(
            base,
            time_window_days=self.window_days,
            prior_window_days=self.window_days,
            seasonality_window_days=self.baseline_days,
            persistence_min_runs=1,
        )


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 20
    # Complaint text columns searched by the keyword path (fixed values).
    text_columns: tuple[str, ...] = (
        "consumer_complaint_narrative",
        "issue",
        "product",
        "canonical_issue",
        "canonical_product",
        "sub_issue",
        "sub_product",
    )
    # Query vectors and candidate rows that one task of the batch search holds.
    queries_per_block: int = 4096
    candidates_per_part: int = 50_000

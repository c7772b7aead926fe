"""Run settings from the environment, entitlements and errors."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from tallywright import schema

log = logging.getLogger(__name__)


class StatementError(Exception):
    """Any failure of a run; carries details for logs."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ConfigurationError(StatementError):
    pass


class EntitlementError(StatementError):
    pass


class TemplateError(StatementError):
    pass


class ExtractionError(StatementError):
    pass


class OutputError(StatementError):
    pass


@dataclass(frozen=True)
class Entitlements:
    """What a tier may do; tiers differ in whether card statements are read."""

    tier: str = "free"
    require_iban: bool = True
    formats: tuple[str, ...] = ("csv", "json", "excel")
    recursive: bool = True
    monthly_summary: bool = True
    expense_analysis: bool = True

    @classmethod
    def free(cls) -> "Entitlements":
        return cls()

    @classmethod
    def paid(cls) -> "Entitlements":
        return cls("paid", require_iban=False)

    def check_format(self, name: str) -> None:
        if canonical_format(name) not in self.formats:
            raise EntitlementError(f"format {name} is not part of the {self.tier} tier")

    def check_recursive(self, wanted: bool) -> bool:
        """Denied recursion silently becomes a flat scan."""
        return wanted and self.recursive


def canonical_format(name: str) -> str:
    return "excel" if name.lower() == "xlsx" else name.lower()


def parse_int(env: Mapping[str, str], name: str, default: int) -> int:
    if name not in env:
        return default
    try:
        return int(env[name])
    except ValueError as e:
        raise ConfigurationError(f"{name} must be a whole number", value=env[name]) from e


def parse_float(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        return float(env.get(name, default))
    except ValueError:
        log.warning("%s is no number; %s is used", name, default)
        return default


def parse_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    return env[name].strip().lower() in ("1", "true", "yes", "on") if name in env else default


def parse_list(env: Mapping[str, str], name: str, default: tuple[str, ...]) -> tuple[str, ...]:
    found = tuple(x.strip() for x in env.get(name, "").split(",") if x.strip())
    return found or default


def parse_json_list(env: Mapping[str, str], name: str, default: list) -> list:
    try:
        value = json.loads(env[name]) if name in env else default
    except ValueError:
        return default
    return value if isinstance(value, list) else default


def parse_columns(env: Mapping[str, str]) -> dict[str, tuple]:
    """TABLE_COLUMNS: a JSON object from column names to edges."""
    try:
        raw = json.loads(env["TABLE_COLUMNS"]) if "TABLE_COLUMNS" in env else {}
        return {k: (float(v[0]), float(v[1])) for k, v in raw.items()} or dict(schema.DEFAULT_COLUMNS)
    except (ValueError, TypeError, IndexError, AttributeError):
        log.warning("TABLE_COLUMNS cannot be read; the default layout is used")
        return dict(schema.DEFAULT_COLUMNS)


@dataclass(frozen=True)
class Config:
    input_dir: str = "input"
    output_dir: str = "output"
    logs_dir: str = "logs"
    table_top: int = 300
    table_bottom: int = 720
    dynamic_boundary: bool = False
    sort_by_date: bool = True
    recursive: bool = True
    monthly_summary: bool = True
    expense_analysis: bool = True
    totals: tuple[str, ...] = ("debit", "credit")
    formats: tuple[str, ...] = ("csv",)
    retention_days: int = 0
    cleanup_on_exit: bool = False
    #: Accounts that get files of their own; all accounts are in the tables and reports that are written as a whole.
    account_files: int = 1000
    columns: Mapping[str, tuple] = field(default_factory=lambda: dict(schema.DEFAULT_COLUMNS))
    duplicate_strategy: str = "all_fields"
    entitlements: Entitlements = field(default_factory=Entitlements)

    def __post_init__(self):
        if self.table_top < 0 or self.table_bottom < 0 or self.table_top >= self.table_bottom:
            raise ConfigurationError("table bounds must satisfy 0 <= top < bottom", top=self.table_top, bottom=self.table_bottom)
        for name in self.formats:
            if canonical_format(name) not in ("csv", "json", "excel"):
                raise ConfigurationError(f"unknown output format {name}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Config":
        env = os.environ if env is None else env
        root = env.get("PROJECT_ROOT", "")
        place = lambda name, default: env.get(name) or os.path.join(root, default)
        return cls(
            input_dir=place("INPUT_DIR", "input"),
            output_dir=place("OUTPUT_DIR", "output"),
            logs_dir=place("LOGS_DIR", "logs"),
            table_top=parse_int(env, "TABLE_TOP_Y", 300),
            table_bottom=parse_int(env, "TABLE_BOTTOM_Y", 720),
            dynamic_boundary=parse_bool(env, "ENABLE_DYNAMIC_BOUNDARY", False),
            sort_by_date=parse_bool(env, "SORT_BY_DATE", True),
            recursive=parse_bool(env, "RECURSIVE_SCAN", True),
            monthly_summary=parse_bool(env, "GENERATE_MONTHLY_SUMMARY", True),
            expense_analysis=parse_bool(env, "GENERATE_EXPENSE_ANALYSIS", True),
            totals=tuple(t.lower() for t in parse_list(env, "TOTALS_COLUMNS", ("debit", "credit"))),
            formats=parse_list(env, "OUTPUT_FORMATS", ("csv",)),
            retention_days=parse_int(env, "DATA_RETENTION_DAYS", 0),
            cleanup_on_exit=parse_bool(env, "AUTO_CLEANUP_ON_EXIT", False),
            columns=parse_columns(env),
        )

    def with_(self, **changes) -> "Config":
        """A changed copy: the settings are the builder."""
        return replace(self, **changes)


def for_bank(bank: str, config: Config | None = None) -> Config:
    """Settings of a named kind of bank; ``lenient`` compares dates and amounts only."""
    return (config or Config()).with_(duplicate_strategy="date_amount" if bank == "lenient" else "all_fields")

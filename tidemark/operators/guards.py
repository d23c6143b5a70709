"""Checks that fail a job.  A violation is an error, never a warning."""

from __future__ import annotations

from pyspark.sql import DataFrame


class GuardError(RuntimeError):
    """A rule that protects validity was broken."""


def expect_empty(violations: DataFrame, message: str, shown: int = 10) -> None:
    """Raise if there is any violation, naming the first few."""
    rows = violations.limit(shown + 1).collect()
    if rows:
        more = " and more" if len(rows) > shown else ""
        raise GuardError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows[:shown]) + more)


def expect_columns(df: DataFrame, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise GuardError(f"missing columns {missing}; found {df.columns}")


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise GuardError(f"none of {candidates} is among {df.columns}")


def expect_within(used: float, cap: float, what: str) -> None:
    """Refuse, rather than cut short, what exceeds a budget."""
    if used > cap:
        raise GuardError(f"{what}: {used} exceeds {cap}")


def safe_member(path: str) -> bool:
    """Whether an archive's member stays below the folder it is unpacked to."""
    p = path.replace("\\", "/")
    return not p.startswith("/") and ".." not in p.split("/") and p[1:2] != ":"

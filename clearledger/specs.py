"""Declarations that drive loading and masking."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """Column rules of one table that cannot be read off the data."""

    table: str
    source: str = ""
    time_columns: tuple[str, ...] = ()
    timestamp_columns: tuple[str, ...] = ()
    escaped_text_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class MaskPolicy:
    """Which columns of a table are masked, and how.

    ``escaped_phones`` are decoded before masking and keep empty cells;
    ``phones`` and ``redacted`` turn empty cells into NULL.
    """

    escaped_phones: tuple[str, ...] = ()
    phones: tuple[str, ...] = ()
    redacted: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.escaped_phones + self.phones + self.redacted


# Source files, tables, declared columns and masked columns.
MANIFEST = (
    TableSpec(
        table="emd",
        source="em.parquet",
        timestamp_columns=("DATE_BIR",),
        escaped_text_columns=("PERIOD",),
    ),
    TableSpec(
        table="inpatient_movement",
        source="in.parquet",
        time_columns=(
            "MOVE_STIME", "MOVE_ETIME", "ATIME", "DTIME",
            "DEATH_TIME", "REPORTING_MOVE_STIME", "REPORTING_MOVE_ETIME",
        ),
        timestamp_columns=("DATE_BIR", "DDATE", "MOVE_EDATE"),
    ),
    TableSpec(
        table="surgery",
        source="su.parquet",
        time_columns=("ATIME", "DTIME", "ENTOTTIME", "EXOTTIME", "SOPTIME", "EOPTIME"),
    ),
    TableSpec(
        table="soc",
        source="sc.parquet",
        time_columns=("SOC_APPT_TIME", "SOC_VISIT_TIME"),
    ),
)

MASK_POLICIES = {
    "emd": MaskPolicy(escaped_phones=("RESIDENT_TEL", "CONTACT_TEL")),
    "inpatient_movement": MaskPolicy(
        phones=("CONTACT_TEL",),
        redacted=("ADDRESS1", "ADDRESS2", "BLOCK_BUILD"),
    ),
}

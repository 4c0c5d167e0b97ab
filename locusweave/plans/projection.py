"""Which columns a query needs."""

from __future__ import annotations

COORDINATES = ["row_idx", "contig", "col_begin", "col_end"]


def plan_columns(queried: list[str], fields: dict[str, dict], columns: list[str], need_alleles: bool = False, sites_only: bool = False) -> list[str]:
    """Columns to read for the queried fields (all, if none are named): coordinates first, REF and ALT where a field's
    length follows alleles or the command needs them, GT where one follows genotypes; for sites only no FORMAT field but
    those INFO DP is made of. Fields that the table doesn't have are an error."""
    names = list(queried) or [c for c in columns if c not in COORDINATES]
    if missing := [n for n in names if n not in columns]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    shape = lambda n: fields.get(n, {}).get("length", ["1"])[0]
    if sites_only:
        names = [n for n in names if n in ("dp_format", "min_dp") or "FORMAT" not in fields.get(n, {}).get("classes", []) or "INFO" in fields.get(n, {}).get("classes", [])]
    if need_alleles or any(shape(n) in ("A", "R", "G") for n in names):
        names = ["ref", "alt", *names]
    if any(shape(n) == "G" for n in names):
        names.append("gt")
    return list(dict.fromkeys([*COORDINATES, *(n for n in names if n in columns)]))


def flatten_tuples(df, field: str):
    """A struct field as columns `<field>_tuple_element_<i>`."""
    from pyspark.sql import functions as F

    parts = df.schema[field].dataType.fieldNames()
    return df.withColumns({f"{field}_tuple_element_{i}": F.col(f"{field}.{p}") for i, p in enumerate(parts)}).drop(field)

"""Row filters: live rows, optional parameters, tenants, consent, dates, text, arrays, record quality."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.text import col

#: Texts and numbers that stand for "no filter" in a request.
BLANKS = ("", 0, "0", "all", "All", "Click here")


def live(df: DataFrame, flag: str = "deleted") -> DataFrame:
    """Rows that are not soft-deleted. Written as an equality so that it reaches the file scan."""
    return df.where(F.col(flag) == F.lit(False))


def none_if(value, blanks: Iterable = BLANKS):
    """``None`` when a parameter carries one of the blank values; a boolean is a value of its own."""
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple, set)):
        return value or None
    if isinstance(value, str) and value.strip() in blanks:
        return None
    return None if value in blanks else value


def opt(df: DataFrame, value, predicate: Callable[[object], Column]) -> DataFrame:
    """Apply ``predicate(value)`` only when a value was given."""
    return df if value is None else df.where(predicate(value))


def one_of(c: Column | str, values: Iterable) -> Column:
    return col(c).isin(list(values))


def branch(df: DataFrame, value, cases: dict, default: Callable | None = None) -> DataFrame:
    """Pick the transformation that belongs to a parameter value."""
    step = cases.get(value, default)
    if step is None:
        raise ValueError(f"{value!r} is not one of {sorted(map(str, cases))}")
    return step(df)


def allowed_tenants(tenants: DataFrame, agreements: DataFrame | None = None, purpose: str = "reporting") -> DataFrame:
    """The caller's tenants and those that share with them for ``purpose``; one column ``website_id``.

    ``agreements`` has ``from_website_id`` (the reader), ``to_website_id`` (the owner) and one
    boolean ``receive_for_<purpose>`` per purpose.
    """
    own = tenants.select("website_id")
    if agreements is None:
        return own.distinct()
    granted = agreements.where(F.col(f"receive_for_{purpose}") == F.lit(True))
    shared = granted.join(own.withColumnRenamed("website_id", "from_website_id"), "from_website_id", "left_semi")
    return own.union(shared.select("to_website_id")).distinct()


def visible(
    df: DataFrame,
    tenants: DataFrame,
    agreements: DataFrame | None = None,
    purpose: str = "reporting",
    tenant_col: str = "website_id",
) -> DataFrame:
    """Rows of the caller's tenants or shared with them: a semi-join, so rows never multiply."""
    allowed = allowed_tenants(tenants, agreements, purpose).withColumnRenamed("website_id", tenant_col)
    return df.join(allowed, tenant_col, "left_semi")


def mask(df: DataFrame, column: str, shown: Column, replacement: Column | None = None) -> DataFrame:
    """Show a personal column only where ``shown`` holds."""
    return df.withColumn(column, F.when(shown, F.col(column)).otherwise(replacement if replacement is not None else F.lit(None)))


def date_overlap(df: DataFrame, date_from=None, date_to=None, start: str = "date_start", end: str = "date_end") -> DataFrame:
    if date_from is None and date_to is None:
        return df
    return df.where(dates.overlaps(start, end, date_from, date_to))


def search(df: DataFrame, columns: list[str], query: str | None, mode: str = "substring") -> DataFrame:
    """Case-insensitive text search; ``%`` and ``_`` in the query have no special meaning.

    Modes: ``prefix``, ``substring``, ``name`` (name key, prefix), ``squeezed`` (spaces ignored, substring).
    """
    if query is None:
        return df
    if mode == "name":
        wanted = text.name_key(F.lit(query))
        tests = [text.name_key(c).startswith(wanted) for c in columns]
    elif mode == "squeezed":
        wanted = text.squeezed(F.lit(query))
        tests = [text.squeezed(F.col(c)).contains(wanted) for c in columns]
    else:
        wanted = F.lower(F.lit(query))
        tests = [
            F.lower(c).startswith(wanted) if mode == "prefix" else F.lower(c).contains(wanted) for c in columns
        ]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return df.where(found)


def has(c: str, value) -> Column:
    """The array holds the value."""
    return F.array_contains(F.col(c), F.lit(value))


def has_any(c: str, values: Iterable[int]) -> Column:
    return F.arrays_overlap(F.col(c), F.array(*[F.lit(v).cast("long") for v in values]))


def has_all(c: str, values: Iterable[int]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(v).cast("long") for v in values]), F.col(c))) == 0


def quality(
    df: DataFrame,
    status_in: Iterable[str] | None = None,
    status_not: Iterable[str] | None = None,
    absent: bool | None = None,
    training: bool | None = False,
    sensitive: bool | None = None,
    status: str = "record_status",
) -> DataFrame:
    """Record-quality filter. ``None`` switches a test off; flags a frame does not have are skipped."""
    df = opt(df, status_in, lambda v: F.col(status).isin(list(v)))
    df = opt(df, status_not, lambda v: ~F.col(status).isin(list(v)))
    for flag, wanted in (("zero_abundance", absent), ("training", training), ("sensitive", sensitive)):
        if wanted is not None and flag in df.columns:
            df = df.where(F.col(flag) == F.lit(wanted))
    return df

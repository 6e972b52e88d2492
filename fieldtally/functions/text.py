"""Text expressions: null-propagating concatenation, name keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined(*parts: Column | str) -> Column:
    """Concatenation that is null as soon as one part is null. Strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def optional(*parts: Column | str) -> Column:
    """Like :func:`joined`, but an empty string when any part is missing."""
    return F.coalesce(joined(*parts), F.lit(""))


def full_name(first: Column | str, last: Column | str) -> Column:
    """``Last, First``, or ``Last`` alone when there is no first name."""
    first, last = col(first), col(last)
    return F.concat(last, optional(", ", first))


def name_key(c: Column | str) -> Column:
    """Search key of a name: bracketed text dropped, lower case, ``ae`` -> ``e``, letters and digits only.

    ``?`` and ``+`` are kept because hybrid and uncertain names use them. The patterns are fixed values.
    """
    plain = F.lower(F.regexp_replace(col(c), r"\(.+\)", ""))
    return F.regexp_replace(F.regexp_replace(plain, "ae", "e"), r"[^a-z0-9?+]", "")


def squeezed(*parts: Column) -> Column:
    """Lower-cased concatenation without spaces, missing parts skipped."""
    return F.lower(F.replace(F.concat_ws("", *parts), F.lit(" "), F.lit("")))


def natural_key(c: Column | str) -> Column:
    """Sort key under which ``S2`` comes before ``S10``: each number is led by its number of digits."""

    def piece(p):
        number = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(F.rlike(p, F.lit("^[0-9]")), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(col(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), piece), "")


def list_text(c: Column | str, trailing: str = ", ") -> Column:
    """A list written as text without the separators left at its end; spaces and commas of the text itself stay."""
    return F.rtrim(col(c), F.lit(trailing))


def lacks(c: Column | str, sign: str) -> Column:
    """Whether a text does not hold a sign; null for a null text."""
    return F.position(F.lit(sign), col(c)) == 0


def source_label(site: Column | str, survey: Column | str) -> Column:
    """``site | survey``; a site title repeated at the start of the survey title is dropped."""
    site, survey = col(site), col(survey)
    rest = F.when(survey.startswith(site), F.trim(F.substring(survey, F.length(site) + 1, F.length(survey)))).otherwise(survey)
    return F.when(rest == "", site).otherwise(joined(site, " | ", rest))


def recode(c: Column | str, mapping: dict, default: Column | str | None = None) -> Column:
    """CASE over exact values. ``default`` may be a Column; missing default keeps null."""
    c = col(c)
    out = None
    for key, value in mapping.items():
        out = (F.when if out is None else out.when)(c == F.lit(key), F.lit(value))
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# Record status and sub-status codes and their labels.
STATUS_LABELS = {
    "V": "accepted",
    "V1": "accepted as correct",
    "V2": "accepted as considered correct",
    "C": "pending",
    "C3": "plausible",
    "R": "rejected",
    "R4": "rejected as unable to verify",
    "R5": "rejected as incorrect",
}


def status_label(status: Column | str, substatus: Column | str) -> Column:
    """Readable record status; unknown codes are shown as they are."""
    code = F.concat(col(status), F.coalesce(col(substatus).cast("string"), F.lit("")))
    return recode(code, STATUS_LABELS, code)

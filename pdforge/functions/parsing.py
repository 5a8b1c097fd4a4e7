"""Text parsing expressions (term, employment length, month-year dates).

All are JVM-side Column expressions; nothing here leaves whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdforge.constants import MONTHS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_term(c="term") -> Column:
    """' 36 months' -> 36 (smallint). Malformed text raises, as a strict cast does."""
    return F.replace(F.trim(_c(c)), F.lit(" months"), F.lit("")).cast("smallint")


def parse_emp_length(c="emp_length") -> Column:
    """'n/a' and null -> -1, '< 1 year' -> 0, 'N year(s)' -> N, '10+ years' -> 10 (tinyint)."""
    s = F.when(_c(c) == "n/a", F.lit(None).cast("string")).otherwise(_c(c))
    s = F.replace(s, F.lit("< 1 year"), F.lit("0"))
    s = F.regexp_replace(s, r"\+ years?", "")
    s = F.regexp_replace(s, r" years?", "")
    return F.coalesce(F.trim(s).cast("float"), F.lit(-1.0)).cast("tinyint")


def _month_codes() -> Column:
    pairs = []
    for i, m in enumerate(MONTHS, start=1):
        pairs += [F.lit(m), F.lit(i)]
    return F.create_map(*pairs)


def month_number(text) -> Column:
    """First three letters of a 'Mon-YYYY' date as 1..12; unknown or null -> 0."""
    return F.coalesce(F.try_element_at(_month_codes(), F.substring(_c(text), 1, 3)), F.lit(0))


def year_number(text) -> Column:
    """Year part of a 'Mon-YYYY' date (characters 5 onwards) as smallint."""
    return F.substring(_c(text), 5, 1 << 20).cast("smallint")


def issue_year(c="issue_d") -> Column:
    return year_number(c)


def issue_month(c="issue_d") -> Column:
    return month_number(c).cast("tinyint")


def credit_history_months(issue="issue_d", earliest="earliest_cr_line") -> Column:
    """12 * (issue year - first year) + (issue month - first month), smallint."""
    months = ((year_number(issue).cast("int") - year_number(earliest).cast("int")) * 12
              + (month_number(issue) - month_number(earliest)))
    return months.cast("smallint")

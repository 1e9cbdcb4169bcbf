"""Years, half-years, quarters and months as reports write them, on one calendar.

A period is ``STRUCT<kind STRING, at INT>``: ``at`` counts months from year 0 to its first month, so that periods of one
kind are ``MONTHS[kind]`` apart and a year is 12 whatever the kind.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions.html import let
from leafgrid.functions.text import strip

MONTHS = {"year": 12, "half": 6, "quarter": 3, "month": 1}

# 2024, 2024년, '24, 24년; two figures alone are no year
_YEAR = r"((?:19|20)[0-9]{2}|['’‘´][0-9]{2}|[0-9]{2}(?= ?년))(?: ?년도?)?"
_QUARTER = r"Q ?[1-4]|[1-4] ?Q|[1-4] ?/ ?4(?: ?분기)?|[1-4] ?분기"
_HALF = r"H ?[12]|[12] ?H|상반기|하반기"
_GAP = r"[ .\-/]*"
#: kind, pattern, and the groups that hold the year and the part of it
SPELLINGS = (
    ("year", rf"(?i)^{_YEAR}$", 1, None),
    ("quarter", rf"(?i)^{_YEAR}{_GAP}({_QUARTER})$", 1, 2),
    ("quarter", r"(?i)^(Q ?[1-4]|[1-4] ?Q)[ .\-/]*(['’‘´]?[0-9]{2}|(?:19|20)[0-9]{2})$", 2, 1),
    ("half", rf"(?i)^{_YEAR}{_GAP}({_HALF})$", 1, 2),
    ("month", rf"^{_YEAR}[ .\-/]*(0?[1-9]|1[0-2]) ?월$", 1, 2),
    ("month", rf"^{_YEAR}[.\-/] ?(0?[1-9]|1[0-2])\.?$", 1, 2),
)


def _year(text: Column) -> Column:
    """Two figures stand for 1970 to 2069."""
    n = F.regexp_extract(text, "([0-9]+)$", 1).try_cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n)


def _part(kind: str, text: Column) -> Column:
    if kind == "half":
        return F.when(text == "상반기", 1).when(text == "하반기", 2).otherwise(F.regexp_extract(text, "([12])", 1).try_cast("int"))
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def period(text: Column) -> Column:
    """The period a text names, else null; the levels of a flat header name count as words."""

    def read(t):
        out = F.lit(None).cast("struct<kind:string,at:int>")
        for kind, pattern, year, part in reversed(SPELLINGS):
            at = _year(F.regexp_extract(t, pattern, year)) * 12
            if part:
                at = at + (_part(kind, F.regexp_extract(t, pattern, part)) - 1) * MONTHS[kind]
            out = F.when(t.rlike(pattern), F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"))).otherwise(out)
        return F.when(t.rlike("[0-9]"), out)

    return let(F.regexp_replace(strip(F.replace(text, F.lit("__"), F.lit(" "))), f"{K.WS}+", " "), read)

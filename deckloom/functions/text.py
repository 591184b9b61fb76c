"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that close a clause.
CLAUSE_MARKS = "。；;，,、！？!?)）】」"
#: White space of any script: what ``\\s`` is in a regular expression with ``(?U)``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space of any script at the ends, which are looked at alone; a regular expression would go over the whole text."""
    return F.btrim(c, F.lit(SPACES))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often, or deep inside lambdas, ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def through_last(c: Column, marks: str) -> Column:
    """The text up to the last of these characters; empty if it has none. What ends in one of them stands in it, and rules with
    many steps at each character need not go over the rest of a long text."""
    return F.regexp_extract(c, f"(?s)^.*[{marks}]", 0)


def looks_like_bullet(c: Column) -> Column:
    """DOC-4: begins with a bullet mark."""
    return c.rlike(r"^\s*[•\-·▪◦*]")


def looks_numeric(c: Column) -> Column:
    """DOC-4: at most 24 characters, of which a digit at least and 35 % are digits."""
    t = stripped(c)
    digits = F.regexp_count(t, F.lit(r"\d"))
    return (F.length(t) > 0) & (F.length(t) <= 24) & (digits >= 1) & (digits >= 0.35 * F.length(t))


def _char(c: Column, i: Column) -> Column:
    return F.substring(c, i + 1, F.lit(1))


def truncate_clause(c: Column, limit: int) -> Column:
    """DOC-14: cut after the last clause mark in the second half of the limit, unless it stands between two digits; else
    at the last space there; else at the limit. Texts within the limit stay."""
    places = F.sequence(F.lit(limit - 1), F.lit(limit // 2), F.lit(-1))
    digit = lambda i: _char(c, i).rlike("[0-9]")
    in_number = lambda i: _char(c, i).isin(",", "，", ".") & (i > 0) & digit(i - 1) & digit(i + 1)
    mark = F.get(F.filter(places, lambda i: _char(c, i).isin(*CLAUSE_MARKS) & ~in_number(i)), F.lit(0))
    space = F.get(F.filter(places, lambda i: _char(c, i) == " "), F.lit(0))
    cut = F.when(mark.isNotNull(), F.substring(c, F.lit(1), mark + 1)).when(space > 0, F.substring(c, F.lit(1), space))
    return F.when(F.length(c) <= limit, c).otherwise(cut.otherwise(F.substring(c, 1, limit)))

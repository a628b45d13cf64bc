"""String functions of network tables, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit letters of engineering notation.
ENG_UNITS = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}


def line_operator(line: Column) -> Column:
    """First two characters of a line id without digits."""
    return F.regexp_replace(F.substring(line, 1, 2), "[0-9]+", "")


def line_route(line: Column) -> Column:
    """All digits of a line id without leading zeros; if none, what follows the operator, less the last character."""
    digits = F.regexp_replace(F.regexp_replace(line, "[^0-9]", ""), "^0+", "")
    start = F.length(line_operator(line)) + 1
    rest = line.substr(start, F.greatest(F.length(line) - start, F.lit(0)))
    return F.when(digits == "", rest).otherwise(digits)


def eng_notation(s: Column) -> Column:
    """'1k5' is 1500 and '12m' 0.012: the unit letter is the decimal point. Signs and '1.5k' work too."""
    t = F.trim(s)
    unit = F.regexp_extract(t, "([A-Za-z])", 1)
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENG_UNITS.items() for x in kv]), F.when(unit != "", unit)), F.lit(1.0))
    plain = F.regexp_replace(F.when(F.instr(t, ".") > 0, F.regexp_replace(t, "[A-Za-z]", "")).otherwise(F.regexp_replace(t, "[A-Za-z]", ".")), "\\.$", "")
    return plain.try_cast("double") * scale


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "\\s+", " ")


def identifier(s: Column) -> Column:
    """Whether a value is a valid Python name (letters of any script) and no keyword."""
    import keyword

    return s.rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$") & ~s.isin(*keyword.kwlist)

"""Text cells to typed values, and what a column of cells should become."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER, FLOAT, DATETIME, STRING = "bigint", "double", "timestamp", "string"
_INT = r"^[+-]?\d{1,19}$"
_REAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Year first or month first, with / or -; then perhaps a time.
_DATE = r"^(\d{3,4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{3,4})([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?Z?)?$"
#: What casts as it is, but for a Z at its end.
_PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}Z?)?\z"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def trimmed(cell: Column) -> Column:
    """Without white space at either end; an empty cell is null."""
    return F.nullif(F.trim(cell), F.lit(""))


def parse_integer(cell: Column) -> Column:
    own = F.trim(cell)
    return F.when(own.rlike(_INT), own.try_cast(INTEGER))


def parse_float(cell: Column) -> Column:
    """Decimal or exponent notation; words such as NaN are text."""
    own = F.trim(cell)
    return F.when(own.rlike(_REAL), own.try_cast(FLOAT))


def parse_datetime(cell: Column) -> Column:
    """Y-M-D or M-D-Y with - or /, and a time if there is one; dates that no calendar has are null."""
    own = F.trim(cell)
    day = F.regexp_extract(own, r"^([\d/-]+)", 1)
    a, b, c = (F.split(F.translate(day, "/", "-"), "-").getItem(i) for i in range(3))
    year_first = F.length(a) > 2
    date = F.concat_ws("-", F.lpad(F.when(year_first, a).otherwise(c), 4, "0"), F.lpad(F.when(year_first, b).otherwise(a), 2, "0"), F.lpad(F.when(year_first, c).otherwise(b), 2, "0"))
    clock = F.regexp_extract(own, r"[T ]([\d:.]+)", 1)
    h, m, s = (F.coalesce(F.get(F.split(clock, ":"), F.lit(i)), F.lit("0")) for i in range(3))
    time = F.when(clock == "", F.lit("00:00:00")).otherwise(F.concat_ws(":", F.lpad(h, 2, "0"), F.lpad(m, 2, "0"), F.when(F.instr(s, ".") == 2, F.concat(F.lit("0"), s)).when(F.length(s) == 1, F.concat(F.lit("0"), s)).otherwise(s)))
    return F.when(own.rlike(_PLAIN), F.substring(own, 1, 19).try_cast(DATETIME)).when(own.rlike(_DATE), F.concat(date, F.lit(" "), time).try_cast(DATETIME))


def valid_datetime(cell: Column) -> Column:
    return parse_datetime(cell).isNotNull()


def format_datetime(value: Column) -> Column:
    return F.date_format(value, ISO)


def kind(cell: Column) -> Column:
    """The narrowest type that holds a cell; null for an empty one."""
    own = trimmed(cell)
    return F.when(own.isNull(), F.lit(None)).when(parse_integer(own).isNotNull(), INTEGER).when(parse_float(own).isNotNull(), FLOAT).when(parse_datetime(own).isNotNull(), DATETIME).otherwise(STRING)


def kind_bit(cell: Column) -> Column:
    """kind() as a bit: 1 integer, 2 real, 4 date, 8 text; 0 for an empty cell. What starts as no number or date does isn't looked at further."""
    own = F.trim(cell)
    first = F.substring(own, 1, 1)
    number = F.when(own.rlike(_INT) & own.try_cast(INTEGER).isNotNull(), 1).when(own.try_cast(FLOAT).isNotNull(), 2).otherwise(8)
    some = F.when(first.isin("+", "-", ".") | first.between("0", "9"), F.when(own.rlike(_REAL), number).when(own.rlike(_DATE) & parse_datetime(own).isNotNull(), 4).otherwise(8)).otherwise(8)
    return F.when(own.isNull() | (own == ""), 0).otherwise(some)


def kind_of_bits(bits: int) -> str:
    """Integers and reals make reals, dates stay dates only among themselves, all else is text. No cells: text."""
    return {1: INTEGER, 2: FLOAT, 3: FLOAT, 4: DATETIME}.get(bits, STRING)


def column_kind(cell: Column) -> Column:
    """kind_of_bits() as an aggregate; each cell is looked at once."""
    bits = F.bit_or(kind_bit(cell))
    return F.when(bits == 1, INTEGER).when(bits.isin(2, 3), FLOAT).when(bits == 4, DATETIME).otherwise(STRING)


def as_kind(cell: Column, kind_name: str) -> Column:
    return {INTEGER: parse_integer, FLOAT: parse_float, DATETIME: parse_datetime, STRING: trimmed}[kind_name](cell)

"""Casts between integers, reals, times (milliseconds since 1970, UTC) and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest
from sparkloom.functions.parsing import format_datetime, parse_datetime

NAMES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "long": "int", "double": "float", "float": "float", "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "string"}


def cast(value: Column, source: str, target: str, strict: bool = True) -> Column:
    """source and target: int, float, datetime or string.

    Reals become integers by dropping the fraction. Strict casts of text fail on what can't be read; others give null.
    """
    to = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
    if {source, target} - {"int", "float", "datetime", "string"}:
        raise InvalidRequest(f"no cast from {source} to {target}")
    if source == target:
        return value
    if source == "datetime":
        value = value.cast("timestamp")  # one without a zone is taken as UTC
        millis = F.unix_millis(value)
        return {"int": millis, "float": millis.cast("double"), "string": format_datetime(value)}[target]
    if target == "datetime":
        if source == "string":
            parsed = parse_datetime(value)
            return F.when(value.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a date: "), value)).cast("timestamp")).otherwise(parsed) if strict else parsed
        return F.timestamp_millis(to(value, "bigint"))
    return to(value, {"int": "bigint", "float": "double", "string": "string"}[target])

"""A typed table over a DataFrame: named, ordered columns, checked names, and rows known by row_id.

Tables are immutable: each operation gives a new one, and Spark plans them all together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest, NotFound, NullValue, OutOfBounds
from sparkloom.functions import named
from sparkloom.functions.casts import NAMES, cast
from sparkloom.sources.delimited import ROW_ID, with_row_id

Value = int | float | str | dt.datetime | None
#: Ranges of first appearance in which labels are ranked: as many as shuffle partitions, at most.
RANGES = 256
_TYPES = {"int": "bigint", "float": "double", "datetime": "timestamp", "string": "string"}


def kind_of(value: Value) -> str:
    if isinstance(value, bool):
        return "int"
    return {int: "int", float: "float", str: "string", dt.datetime: "datetime"}.get(type(value), "string")


class Table:
    """df's columns but row_id, in order. row_id must be unique; with() numbers rows where there is none."""

    def __init__(self, df: DataFrame, row_id: str = ROW_ID):
        self.row_id = row_id
        self.df = df if row_id in df.columns else with_row_id(df, row_id)

    # names and places

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != self.row_id]

    @property
    def column_count(self) -> int:
        return len(self.names)

    def row_count(self) -> int:
        return self.df.count()

    def name(self, column: str | int) -> str:
        """A column's own name, by offset or by name in any case."""
        if isinstance(column, int):
            if not 0 <= column < self.column_count:
                raise OutOfBounds(f"no column {column}")
            return self.names[column]
        for n in self.names:
            if n.lower() == column.lower():
                return n
        raise NotFound(column)

    def __getitem__(self, column: str | int) -> Column:
        return self.df["`" + self.name(column).replace("`", "``") + "`"]

    def kind(self, column: str | int) -> str:
        return NAMES.get(self.df.schema[self.name(column)].dataType.simpleString(), self.df.schema[self.name(column)].dataType.simpleString())

    def is_nullable(self, column: str | int) -> bool:
        return self.df.schema[self.name(column)].nullable

    def _free(self, name: str) -> str:
        if name.lower() in {n.lower() for n in [*self.names, self.row_id]}:
            raise InvalidRequest(f"there is a column {name}")
        return name

    def _new_name(self, name: str | None) -> str:
        if name is not None:
            return self._free(name)
        i = self.column_count
        while f"column_{i}" in {n.lower() for n in self.names}:
            i += 1
        return f"column_{i}"

    def _with(self, df: DataFrame, names: Sequence[str]) -> Table:
        return Table(df.select(self.row_id, *map(named, names)), self.row_id)

    def _insert(self, df: DataFrame, name: str, offset: int | None) -> Table:
        at = self.column_count if offset is None else offset
        if not 0 <= at <= self.column_count:
            raise OutOfBounds(f"no place {at}")
        return self._with(df, [*self.names[:at], name, *self.names[at:]])

    # columns

    def select(self, *columns: str | int) -> Table:
        return self._with(self.df, [self.name(c) for c in columns])

    def add_empty_column(self, kind: str, name: str | None = None, offset: int | None = None) -> Table:
        own = self._new_name(name)
        return self._insert(self.df.withColumn(own, F.lit(None).cast(_TYPES[kind])), own, offset)

    def add_constant_column(self, value: Value, name: str | None = None, offset: int | None = None) -> Table:
        own = self._new_name(name)
        return self._insert(self.df.withColumn(own, F.lit(value).cast(_TYPES[kind_of(value)])), own, offset)

    def add_copy(self, column: str | int, name: str | None = None, offset: int | None = None) -> Table:
        own = self._new_name(name)
        return self._insert(self.df.withColumn(own, self[column]), own, offset)

    def add_expression(self, value: Column, name: str | None = None, offset: int | None = None) -> Table:
        own = self._new_name(name)
        return self._insert(self.df.withColumn(own, value), own, offset)

    def add_values(self, values: Sequence[Value], name: str | None = None, offset: int | None = None) -> Table:
        """A column from the driver, a value a row in row_id's order; there must be as many as rows."""
        if len(values) != self.row_count():
            raise OutOfBounds(f"{len(values)} values for {self.row_count()} rows")
        own, kind = self._new_name(name), kind_of(next((v for v in values if v is not None), None))
        local = self.df.sparkSession.createDataFrame(list(enumerate(values)), f"__place bigint, `{own}` {_TYPES[kind]}")
        placed = factorized(self.df.select(self.row_id), self.row_id, self.row_id, "__place").join(local, "__place").drop("__place")
        return self._insert(self.df.join(placed, self.row_id), own, offset)

    def remove_column(self, column: str | int) -> Table:
        gone = self.name(column)
        return self._with(self.df, [n for n in self.names if n != gone])

    def rename(self, column: str | int, name: str) -> Table:
        old = self.name(column)
        if name.lower() != old.lower():
            self._free(name)
        return Table(self.df.withColumnRenamed(old, name), self.row_id)

    def cast(self, column: str | int, kind: str, strict: bool = True) -> Table:
        own = self.name(column)
        return Table(self.df.withColumn(own, cast(self[own], self.kind(own), kind, strict)), self.row_id)

    def assign(self, column: str | int, value: Value) -> Table:
        """The whole column becomes the value, and of its type."""
        own = self.name(column)
        kind = self.kind(own) if value is None else kind_of(value)
        return Table(self.df.withColumn(own, F.lit(value).cast(_TYPES[kind])), self.row_id)

    def add_to(self, column: str | int, value: float) -> Table:
        """Integers gain the whole part, reals the value, times that many milliseconds, texts the printed number."""
        own = self.name(column)
        return Table(self.df.withColumn(own, self._plus(own, value)), self.row_id)

    def _plus(self, own: str, value: float) -> Column:
        c = self[own]
        return {
            "int": lambda: c + F.lit(int(value)).cast("bigint"),
            "float": lambda: c + F.lit(float(value)),
            "datetime": lambda: F.timestamp_millis(F.unix_millis(c.cast("timestamp")) + F.lit(int(value)).cast("bigint")),
            "string": lambda: F.concat(c, F.lit(f"{value:g}")),
        }[self.kind(own)]()

    def make_nullable(self, column: str | int) -> Table:
        own = self.name(column)
        return Table(self.df.withColumn(own, F.when(F.lit(True), self[own])), self.row_id)

    def make_non_nullable(self, column: str | int) -> Table:
        own = self.name(column)
        if self.df.where(self[own].isNull()).limit(1).count():
            raise NullValue(own)
        never = F.timestamp_millis(F.lit(0)) if self.kind(own) == "datetime" else F.lit("" if self.kind(own) == "string" else 0)
        return Table(self.df.withColumn(own, F.coalesce(self[own], never.cast(self.df.schema[own].dataType))), self.row_id)

    # rows and cells

    def row(self, row: int) -> dict[str, Value]:
        found = self.df.where(F.col(self.row_id) == row).limit(1).collect()
        if not found:
            raise OutOfBounds(f"no row {row}")
        return {n: found[0][n] for n in self.names}

    def cell(self, row: int, column: str | int) -> Value:
        return self.select(column).row(row)[self.name(column)]

    def set_cell(self, row: int, column: str | int, value: Value) -> Table:
        """The value is cast to the column's type; text that can't be is an error."""
        own = self.name(column)
        new = F.lit(None).cast(_TYPES[self.kind(own)]) if value is None else cast(F.lit(value).cast(_TYPES[kind_of(value)]), kind_of(value), self.kind(own))
        return Table(self.df.withColumn(own, F.when(F.col(self.row_id) == row, new).otherwise(self[own])), self.row_id)

    def add_to_cell(self, row: int, column: str | int, value: float) -> Table:
        """One cell gains the value, as add_to() has it; a null stays one."""
        own = self.name(column)
        return Table(self.df.withColumn(own, F.when(F.col(self.row_id) == row, self._plus(own, value)).otherwise(self[own])), self.row_id)

    def append(self, rows: Sequence[Sequence[Value]]) -> Table:
        """New last rows; each cell is cast to its column's type. Missing cells are null, too many an error."""
        if any(len(r) > self.column_count for r in rows):
            raise OutOfBounds("a row has too many cells")
        last = self.df.agg(F.max(self.row_id)).first()[0]
        start = 0 if last is None else last + 1
        alike: dict[tuple[str | None, ...], list[tuple]] = {}
        for i, r in enumerate(rows):
            cells = [*r, *[None] * (self.column_count - len(r))]
            alike.setdefault(tuple(None if v is None else kind_of(v) for v in cells), []).append((start + i, *cells))
        out = self.df
        for kinds, own in alike.items():  # a local table for rows whose cells are of the same kinds
            local = self.df.sparkSession.createDataFrame(own, ", ".join(["__row bigint", *(f"__c{j} {_TYPES[k or 'string']}" for j, k in enumerate(kinds))]))
            cells = [(F.lit(None) if k is None else cast(F.col(f"__c{j}"), k, self.kind(n))).cast(self.df.schema[n].dataType).alias(n) for j, (k, n) in enumerate(zip(kinds, self.names, strict=True))]
            out = out.unionByName(local.select(F.col("__row").alias(self.row_id), *cells))
        return Table(out, self.row_id)

    # labels and matrices

    def factorize(self, column: str | int, name: str | None = None, offset: int | None = None) -> Table:
        return self.factorize_with_labels(column, name, offset)[0]

    def factorize_with_labels(self, column: str | int, name: str | None = None, offset: int | None = None) -> tuple[Table, DataFrame]:
        """Codes by first appearance, null for null; and the labels with their codes."""
        own, new = self.name(column), self._new_name(name)
        if self.kind(own) != "string":
            raise InvalidRequest(f"{own} is no text")
        labels = factorized(self.df, own, self.row_id, new)
        return self._insert(self.df.join(labels.withColumnRenamed(own, "__label"), self[own] == F.col("__label"), "left").drop("__label"), new, offset), labels

    def to_matrix(self, columns: Sequence[str | int] | None = None) -> DataFrame:
        """row_id and features (doubles) of numeric columns; text or nulls are an error."""
        own = [self.name(c) for c in (self.names if columns is None else columns)]
        if text := [n for n in own if self.kind(n) not in ("int", "float", "datetime")]:
            raise InvalidRequest(f"no numbers: {', '.join(text)}")
        numbers = [(F.unix_millis(self[n].cast("timestamp")) if self.kind(n) == "datetime" else self[n]).cast("double") for n in own]
        checked = [F.coalesce(x, F.raise_error(F.lit(f"null in {n}")).cast("double")) for n, x in zip(own, numbers, strict=True)]
        return self.df.select(F.col(self.row_id), F.array(*checked).alias("features"))

    def show(self, n: int = 20) -> None:
        self.df.drop(self.row_id).show(n, truncate=24)


def factorized(df: DataFrame, column: str, order: str, code: str = "code") -> DataFrame:
    """The distinct values of a column with dense codes from 0 by the least `order` of each.

    One aggregation over the rows; only distinct values are ranked. Ranking has no key to be dealt by, so
    values are ranked within ranges of their first appearance, and ranges are shifted by what comes before.
    """
    first = df.where(named(column).isNotNull()).groupBy(named(column).alias(column)).agg(F.min(named(order)).alias("__first"))
    wanted = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(first.approxQuantile("__first", [i / wanted for i in range(1, wanted)], 1 / (8 * wanted))))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__first"))) if cuts else F.lit(0)
    ranges = first.withColumn("__part", part)
    shift, at = [], 0
    for p, n in sorted((r["__part"], r["n"]) for r in ranges.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # RANGES rows at most
        shift.append((p, at))
        at += n
    rank = F.row_number().over(W.partitionBy("__part").orderBy("__first", named(column))) - 1
    starts = df.sparkSession.createDataFrame(shift, "__part int, __start bigint")
    return ranges.withColumn("__rank", rank).join(F.broadcast(starts), "__part").select(named(column), (F.col("__rank") + F.col("__start")).cast("bigint").alias(code))

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest, NotFound, NullValue, OutOfBounds
from sparkloom.operators import containers
from sparkloom.operators import table as table_module
from sparkloom.operators.table import Table, factorized
from sparkloom.sources.delimited import from_delimited, matrix_from_delimited, to_delimited


@pytest.fixture
def mixed(tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text('" id ",f,s,d,b\n1,2,"a, b",2/18/1992,\n2,2.5,c,1992-02-19,\n3,.5,d,2/20/1992\n')
    return str(path)


def test_inference(spark, mixed):
    t = Table(from_delimited(spark, mixed))
    assert t.names == ["id", "f", "s", "d", "b"]
    assert [t.kind(c) for c in t.names] == ["int", "float", "string", "datetime", "string"]
    assert t.row(0) == {"id": 1, "f": 2.0, "s": "a, b", "d": dt.datetime(1992, 2, 18), "b": None}
    assert t.row(2)["b"] is None
    assert t.row_count() == 3
    with pytest.raises(OutOfBounds):
        t.row(3)


def test_kinds_and_counts_take_one_pass(spark, tmp_path):
    path = str(tmp_path / "many")
    to_delimited(spark.range(2000).select("id", F.concat(F.lit("w"), "id").alias("w")), path)

    def read():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = read()
    df = from_delimited(spark, path)
    assert read() - before < 1.5 * 2000
    assert {(r.row_id, r.w) for r in df.collect()} == {(r.row_id, f"w{r.id}") for r in df.collect()} and df.agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first() == (2000, 0, 1999)


def test_long_rows_and_matrices(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        from_delimited(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "m.csv").write_text("1;2.5\n-3;4e1\n")
    assert [(r.row_id, r.features) for r in matrix_from_delimited(spark, str(tmp_path / "m.csv"), sep=";").orderBy("row_id").collect()] == [(0, [1.0, 2.5]), (1, [-3.0, 40.0])]
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="x"):
        matrix_from_delimited(spark, str(tmp_path / "bad.csv")).collect()
    to_delimited(spark.createDataFrame([(1, "q")], "a int, b string"), str(tmp_path / "out"))
    assert Table(from_delimited(spark, str(tmp_path / "out"))).row(0) == {"a": 1, "b": "q"}


@pytest.fixture
def t(spark):
    rows = [(0, 1, 1.5, dt.datetime(2020, 1, 1), "Brand#1"), (1, 2, None, None, "Brand#2"), (2, 3, 2.5, dt.datetime(2021, 1, 1), None), (3, 4, 0.5, None, "Brand#1")]
    return Table(spark.createDataFrame(rows, "row_id long, i long, f double, d timestamp, s string"))


def values(t, column):
    return [r[0] for r in t.df.orderBy(t.row_id).select(t.name(column)).collect()]


def test_columns(t):
    assert t.name("S") == "s"
    assert t.name(1) == "f"
    for bad, error in (("x", NotFound), (9, OutOfBounds)):
        with pytest.raises(error):
            t.name(bad)
    u = t.add_constant_column("k", "c", 0).add_empty_column("int", "e").add_copy("i", "I2").add_values([9, 8, 7, 6], "v", 1)
    assert u.names == ["c", "v", "i", "f", "d", "s", "e", "I2"]
    assert values(u, "v") == [9, 8, 7, 6]
    assert values(u, "e") == [None] * 4
    for make in (lambda: t.add_copy("i", "S"), lambda: t.rename("i", "F")):
        with pytest.raises(InvalidRequest):
            make()
    with pytest.raises(OutOfBounds):
        t.add_values([1], "v")
    with pytest.raises(OutOfBounds):
        t.add_constant_column(1, "v", 9)
    assert t.remove_column(0).remove_column("D").names == ["f", "s"]
    assert t.rename("i", "I").names[0] == "I"
    assert t.add_constant_column(1).names[-1] == "column_4"


def test_values(t):
    assert values(t.add_to("i", 2.9), "i") == [3, 4, 5, 6]
    assert values(t.add_to("f", 0.5), "f") == [2.0, None, 3.0, 1.0]
    assert values(t.add_to("d", 1500), "d")[0] == dt.datetime(2020, 1, 1, 0, 0, 1, 500_000)
    assert values(t.add_to("s", 2), "s") == ["Brand#12", "Brand#22", None, "Brand#12"]
    assert t.assign("i", "x").kind("i") == "string"
    assert values(t.set_cell(1, "f", "3.5"), "f")[1] == 3.5
    assert values(t.set_cell(1, "i", 2.9), "i")[1] == 2
    assert t.cell(2, "i") == 3
    assert values(t.cast("i", "string"), "i") == ["1", "2", "3", "4"]
    u = t.append([[5, 1, None, "z"], [6.7]])
    assert u.row_count() == 6
    assert u.row(4) == {"i": 5, "f": 1.0, "d": None, "s": "z"}
    assert u.row(5) == {"i": 6, "f": None, "d": None, "s": None}
    with pytest.raises(OutOfBounds):
        t.append([[1] * 5])
    with pytest.raises(NullValue):
        t.make_non_nullable("f")
    assert not t.make_non_nullable("i").is_nullable("i")
    assert t.make_nullable("i").is_nullable("i")


def test_factorize(t, spark, monkeypatch):
    u, labels = t.factorize_with_labels("s", "code")
    assert values(u, "code") == [0, 1, None, 0]
    assert sorted(map(tuple, labels.collect())) == [("Brand#1", 0), ("Brand#2", 1)]
    with pytest.raises(InvalidRequest):
        t.factorize("i")
    monkeypatch.setattr(table_module, "RANGES", 4)
    df = spark.range(500).select((499 - F.col("id")).alias("o"), F.concat(F.lit("v"), F.col("id") % 200).alias("v"))
    got = {r.v: r.code for r in factorized(df, "v", "o").collect()}
    seen = list(dict.fromkeys(f"v{(499 - o) % 200}" for o in range(500)))
    assert got == {v: i for i, v in enumerate(seen)}
    assert factorized(df.limit(0), "v", "o").count() == 0


def test_to_matrix(t):
    assert [r.features for r in t.to_matrix(["i", "i"]).orderBy("row_id").collect()] == [[i, i] for i in (1.0, 2.0, 3.0, 4.0)]
    with pytest.raises(InvalidRequest):
        t.to_matrix()
    with pytest.raises(Exception, match="null in f"):
        t.to_matrix(["f"]).collect()


def test_containers(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, "b", 2), (5, None, 9)], "o int, k string, v int")
    assert [r.o for r in containers.smallest(df, 2, "v", "o").collect()] == [2, 3]
    assert [r.o for r in containers.largest(df, 3, "v", "o").collect()] == [5, 1, 3]
    assert {(r.k, r.v) for r in containers.first_wins(df, "k", "v", "o").collect()} == {("a", 3), ("b", 2), (None, 9)}
    assert sorted(r.o for r in containers.smallest_per_key(df, 1, "k", "v", "o").collect()) == [2, 3, 5]
    keys = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(r.o for r in containers.members(df, keys, "k").collect()) == [1, 2]
    assert sorted(r.o for r in containers.others(df, keys, "k").collect()) == [3, 4, 5]
    assert tuple(containers.both_ends(df, "v").first()) == (1, 9)
    assert [r.v for r in containers.ordered(df, "v", unique=True).collect()] == [1, 2, 3, 9]
    assert [r.v for r in containers.ordered(df, "v").collect()] == [1, 2, 2, 3, 9]
    with pytest.raises(InvalidRequest):
        containers.smallest(df, -1, "v")


def test_names_with_dots(spark):
    from sparkloom.operators.regression import multinomial, ols

    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), "ab"[i % 2]) for i in range(60)], "row_id long, `x.a` double, `x.b` double, `the.label` string")
    u = Table(df).factorize("the.label", "label", 0).remove_column("the.label")
    assert u.names == ["label", "x.a", "x.b"]
    assert multinomial(u.df, "label", ["x.a", "x.b"]).n == 60
    assert abs(ols(u.df, "x.a", ["x.b"]).beta).max() < 10
    assert u.to_matrix(["x.a"]).count() == 60


def test_cells_gain_and_rows_of_several_kinds(t):
    n = t.row_count()
    first = t.names[0]
    more = t.append([[7], [7.9], ["8"], [None], []])
    assert more.row_count() == n + 5
    assert [more.cell(n + i, first) for i in range(5)] == [7, 7, 8, None, None]
    assert more.append([]).row_count() == n + 5
    up = more.add_to_cell(n, first, 2.7).add_to_cell(n + 3, first, 1)
    assert [up.cell(n + i, first) for i in range(4)] == [9, 7, 8, None]

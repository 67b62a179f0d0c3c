"""Inferred column types: the least type that holds all rows."""

import datetime

import pytest

from basketry.sources import schemas
from basketry.sources.inference import inferred_types, read_inferred


def kinds(df):
    return {r["column_name"]: r["type"] for r in inferred_types(df).collect()}


def test_an_odd_last_row_widens_the_column(spark):
    rows = [(str(i), str(i), str(i), "true", "03-02-18 10:05") for i in range(500)]
    schema = "a string, b string, c string, d string, e string"
    assert kinds(spark.createDataFrame(rows, schema)) == dict(zip("abcde", ["bigint"] * 3 + ["boolean", "day_first"], strict=True))
    odd = [*rows, ("7", "7.5", "seven", "2", "31-02-18 10:05")]
    assert kinds(spark.createDataFrame(odd, schema).repartition(7)) == dict(
        zip("abcde", ["bigint", "double", "string", "string", "string"], strict=True)
    )


@pytest.mark.parametrize(
    "texts, kind",
    [
        ([None, "", "  "], "string"),
        ([], "string"),
        ([" 12 ", "-3", "+4"], "bigint"),
        (["9223372036854775807", "9223372036854775808"], "double"),
        (["1e3", ".5", "2."], "double"),
        (["1d", "2"], "string"),
        (["NaN", "1"], "string"),
        (["True", "FALSE", None], "boolean"),
        (["true", "1"], "string"),
    ],
)
def test_kinds(spark, texts, kind):
    assert kinds(spark.createDataFrame([(t,) for t in texts], "`a.b` string")) == {"a.b": kind}


def test_typed_read_and_declared_schema_agree(spark, tmp_path):
    lines = ["order_id,payment_type,payment_installments,payment_value,paid", "o1,card,3,70.5,01-02-17 08:00", "o2,,1,8,"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    typed = read_inferred(spark, str(tmp_path))
    assert [tuple(r) for r in typed.orderBy("order_id").collect()] == [
        ("o1", "card", 3, 70.5, datetime.datetime(2017, 2, 1, 8, 0)),
        ("o2", None, 1, 8.0, None),
    ]
    wider = {"int": "bigint"}
    declared = {h: wider.get(kind, kind) for h, (_, kind) in schemas.PAYMENTS.items()}
    assert {f.name: f.dataType.simpleString() for f in typed.schema if f.name in declared} == declared

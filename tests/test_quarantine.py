"""Malformed CSV rows: fail or are kept apart, never shifted."""

from __future__ import annotations

import pytest

from basketry.functions.memo import Memo, stamp
from basketry.functions.workspace import Workspace
from basketry.plans import registry
from basketry.sources import csv as csv_source
from basketry.sources import quarantine as q

HEADER = "order_id,payment_type,payment_installments,payment_value\n"
GOOD = "o1,boleto,2,50.0\no2,voucher,1,0.5\n"
LONG, SHORT = "o3,credit,card,3,70.0\n", "o4,boleto\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + GOOD + LONG)
    (tmp_path / "b.csv").write_text(HEADER + "o5,boleto,1,9.0\n\n" + SHORT + '"o,6",boleto,"1",3\n')
    return tmp_path


def test_a_malformed_row_fails_whatever_columns_are_read(spark, folder):
    rows = csv_source.read_payments(spark, str(folder))
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.select("payment_type").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.agg({"payment_value": "sum"}).collect()


def test_quarantine_keeps_good_rows_as_they_are(spark, folder):
    rows = csv_source.read_payments(spark, str(folder), malformed=q.QUARANTINE)
    expected = [("o,6", "boleto", 1, 3.0), ("o1", "boleto", 2, 50.0), ("o2", "voucher", 1, 0.5), ("o5", "boleto", 1, 9.0)]
    assert sorted(map(tuple, rows.collect())) == expected
    assert sorted(r[0] for r in rows.select("payment_type").collect()) == ["boleto", "boleto", "boleto", "voucher"]
    assert rows.count() == 4


def test_malformed_rows_and_counts_by_file(spark, folder):
    bad = {r["file"].rsplit("/", 1)[1]: r["row"] for r in q.malformed_rows(spark, str(folder)).collect()}
    assert bad == {"a.csv": LONG.strip(), "b.csv": SHORT.strip()}
    counts = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in q.row_counts(spark, str(folder)).collect()}
    assert counts == {"a.csv": (3, 2, 1), "b.csv": (3, 2, 1)}
    with Workspace(spark) as work:
        table = q.quarantine(spark, str(folder), work.path("payments"))
        assert sorted(r["row"] for r in table.collect()) == sorted([LONG.strip(), SHORT.strip()])


def test_padding_is_a_choice(spark, folder):
    rows = {r["order_id"]: tuple(r) for r in csv_source.read_payments(spark, str(folder), malformed=q.PAD).collect()}
    assert rows["o4"] == ("o4", "boleto", None, None)
    with pytest.raises(ValueError):
        q.read_rows(spark, str(folder), malformed="drop")


def test_line_breaks_in_quotes_are_no_malformed_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text('review_id,order_id,review_score,review_comment_message\nr1,o1,5,"a\nb, c"\nr2,o2,4\nr3,o3,1,x\n')
    rows = csv_source.read_reviews(spark, str(tmp_path), malformed=q.QUARANTINE).collect()
    assert sorted(map(tuple, rows)) == [("o1", 5, "a\nb, c"), ("o3", 1, "x")]
    assert [r["row"] for r in q.malformed_rows(spark, str(tmp_path), multi_line=True).collect()] == ["r2,o2,4"]


def test_views_of_exports_with_malformed_rows(spark, folder, tmp_path):
    paths = {"payments": str(folder)}
    texts = {
        "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\no1,c1,delivered,07-08-18 15:27,,,10-08-18 09:00,12-08-18 00:00\n",
        "customers": "customer_id,customer_unique_id\nc1,u1\nc2\n",
        "reviews": "order_id,review_score\no1,5\n",
    }
    apart = tmp_path.parent / f"{tmp_path.name}-views"
    apart.mkdir()
    for name, text in texts.items():
        (apart / f"{name}.txt").write_text(text)
        paths[name] = str(apart / f"{name}.txt")
    with Workspace(spark) as work:
        target = work.path("quarantine")
        v = csv_source.read_csv_views(spark, paths, malformed=q.QUARANTINE, quarantine=target)
        assert v.payments.count() == 4 and v.customers.count() == 1
        kept = {t: spark.read.parquet(f"{target}/{t}").count() for t in paths}
        assert kept == {"payments": 2, "customers": 1, "orders": 0, "reviews": 0}
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_source.read_csv_views(spark, paths).customers.count()


def test_a_rewritten_input_gives_a_new_result(spark, tmp_path):
    memo, made = Memo(), []

    def make():
        made.append(1)
        return spark.read.parquet(path).count()

    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    assert [memo.get(spark, "n", [path], make) for _ in range(3)] == [5, 5, 5] and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert memo.get(spark, "n", [path], make) == 7 and len(made) == 2
    spark.range(7, 9).write.mode("append").parquet(path)
    assert memo.get(spark, "n", [path], make) == 9 and len(made) == 3
    assert memo.get(spark, "other", [path], make) == 9 and len(made) == 4
    assert stamp(spark, [str(tmp_path / "none")]) == ((str(tmp_path / "none"), -1, -1),)


def test_jobs_see_a_rewritten_data_set(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    for t in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    scores = registry.queries()["rfm_scores"]
    before = scores(spark, str(tmp_path)).count()
    assert scores(spark, str(tmp_path)).count() == before
    some = spark.read.parquet(f"{small}/orders.parquet").filter("o_orderkey % 3 = 0")
    some.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    after = scores(spark, str(tmp_path)).count()
    assert 0 < after < before

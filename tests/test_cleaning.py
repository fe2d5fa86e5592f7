from datetime import datetime
from decimal import Decimal

import pytest

from tillroll import schemas
from tillroll.operators import cleaning
from tillroll.sources import files
from tillroll.sources.staging import staging_path


def raw_rows(spark, *changes):
    usual = {"Invoice": "1", "StockCode": "s", "Description": "lamp", "Quantity": 2,
             "InvoiceDate": datetime(2010, 1, 4, 9, 30), "Price": Decimal("1.50"), "Customer ID": 7.0, "Country": "France"}
    rows = [tuple({**usual, **c}.values()) for c in changes]
    return spark.createDataFrame(rows, schemas.RAW_TRANSACTIONS)


def test_identical_lines_collapse(spark):
    assert cleaning.clean_transactions(raw_rows(spark, {}, {}, {"Quantity": 3})).count() == 2


@pytest.mark.parametrize("change", [
    {"Customer ID": None}, {"Description": None}, {"Quantity": 0}, {"Quantity": -1}, {"Quantity": 10000},
    {"Price": Decimal("0")}, {"Invoice": "C1"},
])
def test_faulty_lines_are_dropped(spark, change):
    assert cleaning.clean_transactions(raw_rows(spark, change)).count() == 0


def test_kept_line(spark):
    row = cleaning.clean_transactions(raw_rows(spark, {"Invoice": "c1", "Quantity": 9999})).first()
    assert row["CustomerID"] == 7 and row["TotalPrice"] == Decimal("14998.50")


def test_charges_by_letter_case(spark):
    raw = raw_rows(spark, {"Description": "Postage"}, {"Description": "MANUAL"}, {"Description": "lamp"})
    assert cleaning.products_only(raw).count() == 1
    assert cleaning.products_only_exact_case(raw).count() == 2


def test_parts_are_stacked_and_round_trip(spark):
    raw = raw_rows(spark, {}, {"Description": None, "Customer ID": None}, {"Invoice": "2"})
    paths = [staging_path(spark, "test-part") for _ in range(2)]
    for path in paths:
        raw.write.option("header", True).csv(path)
    loaded = files.load_raw(spark, paths)
    assert loaded.schema.fieldNames() == raw.schema.fieldNames()
    assert sorted(map(str, loaded.collect())) == sorted(map(str, raw.collect() * 2))


def test_tables_written_by_month(spark):
    clean = cleaning.clean_transactions(raw_rows(spark, {}, {"InvoiceDate": datetime(2010, 2, 1)}))
    path = staging_path(spark, "test-clean")
    files.write_transactions(clean, path)
    assert spark.read.parquet(path).select("month").distinct().count() == 2
    assert sorted(map(str, files.read_transactions(spark, path).collect())) == sorted(
        map(str, clean.select(schemas.TRANSACTIONS.fieldNames()).collect()))


def test_reader_keeps_quoted_fields_and_small_prices(spark, tmp_path):
    from tillroll.sources import files

    path = tmp_path / "raw.csv"
    path.write_text(
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '1,a,"BOX ""LARGE"", BLUE",2,2010-12-01T08:26:00,4.255,17850.0,France\n'
        '2,b,"two\nlines",1,2010-12-01T08:26:00,0.001,17850.0,France\n')
    rows = sorted(files.load_raw(spark, [str(path)]).collect())
    assert [r.Description for r in rows] == ['BOX "LARGE", BLUE', "two\nlines"]
    assert [float(r.Price) for r in rows] == [4.255, 0.001] and rows[0]["Customer ID"] == 17850.0


def test_reader_refuses_values_it_cannot_hold(spark, tmp_path):
    import pytest

    from tillroll.sources import files

    path = tmp_path / "raw.csv"
    path.write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n1,a,x,abc,2010-12-01T08:26:00,1,1.0,F\n")
    with pytest.raises(Exception, match="abc|MALFORMED"):
        files.load_raw(spark, [str(path)]).collect()

import csv
import random
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import cleaning
from tillroll.sources import csv_records, files, views
from tillroll.sources.staging import staging_path

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges far smaller than a file, so that records run over their ends."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b", " ", ",", '"', "\n", "\r\n", "é", "x" * 40, "line\n" * 3]) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow(["id", "text", "x"])
        out.writerows(rows)


def test_many_tasks_read_one_file_of_quoted_line_breaks(spark, tmp_path, small_ranges):
    rows = [(k, t, k / 2) for k, t in enumerate(texts(1, 400))]
    rows.insert(200, (1000, "a long field\n" * 900, 1.0))
    write(tmp_path / "one.csv", rows)
    lines = csv_records._lines(spark, str(tmp_path / "one.csv"))
    assert lines.rdd.getNumPartitions() > 20
    found = csv_records.read_csv(spark, str(tmp_path / "one.csv"), SCHEMA).collect()
    assert sorted(map(tuple, found)) == sorted(rows)


def test_several_files_and_header_in_each(spark, tmp_path, small_ranges):
    rows = [(k, t, 0.0) for k, t in enumerate(texts(2, 90))]
    for part in range(3):
        write(tmp_path / f"{part}.csv", rows[part::3])
    write(tmp_path / "none.csv", [])
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(tuple, csv_records.read_csv(spark, str(tmp_path), SCHEMA).collect())) == sorted(rows)


def test_a_header_with_a_line_break(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('id,"te\nxt",x\r\n1,"p\nq",2\r\n\r\n2,,\r\n')
    assert [tuple(r) for r in csv_records.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).orderBy("id").collect()] == [
        (1, "p\nq", 2.0), (2, None, None)]


def test_rejected_records_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,x\n1,good,2\nno,"bad\nid",1\n3,too,many,4\n4,good,1\n')
    path = str(tmp_path / "a.csv")
    counts = csv_records.rejected_counts(spark, path, SCHEMA).first()
    assert (counts.records, counts.rejected) == (4, 2)
    rows = csv_records.read_csv_or_reject(spark, path, SCHEMA)
    assert {r.id for r in rows.filter(f"{csv_records.REJECTED} IS NULL").collect()} == {1, 4}
    assert {r[csv_records.REJECTED] for r in rows.collect() if r[csv_records.REJECTED]} == {'no,"bad\nid",1', "3,too,many,4"}
    with pytest.raises(Exception, match="MALFORMED"):
        csv_records.read_csv(spark, path, SCHEMA).collect()


def transactions(make_transactions):
    return make_transactions([(1, "a", "2010-01-05", 5), (2, "b", "2010-02-05", 7), (3, "c", "2010-02-06", 9)])


def test_a_failing_write_leaves_the_old_table(spark, make_transactions, tmp_path):
    tx, path = transactions(make_transactions), str(tmp_path / "table")
    for fmt in ("parquet", "csv"):
        files.write_transactions(tx, path, fmt)
        broken = tx.withColumn("Invoice", F.when(F.col("CustomerID") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("Invoice")))
        with pytest.raises(Exception, match="no"):
            files.write_transactions(broken, path, fmt)
        assert files.read_transactions(spark, path, fmt).count() == 3
        assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_table_is_replaced(spark, make_transactions, tmp_path):
    tx, path = transactions(make_transactions), str(tmp_path / "table")
    files.write_transactions(tx, path)
    files.write_transactions(tx.filter("CustomerID = 1"), path)
    assert [r.CustomerID for r in files.read_transactions(spark, path).collect()] == [1]


def test_one_month_is_written_again_alone(spark, make_transactions):
    tx, path = transactions(make_transactions), staging_path(spark, "months")
    files.write_transactions(tx, path)
    files.write_months(tx.filter("CustomerID = 2").withColumn("Invoice", F.lit("new")), path)
    found = {(r.CustomerID, r.Invoice) for r in files.read_transactions(spark, path).collect()}
    assert found == {(1, "a"), (2, "new")}
    broken = tx.filter("CustomerID = 2").withColumn("Invoice", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        files.write_months(broken, path)
    assert {(r.CustomerID, r.Invoice) for r in files.read_transactions(spark, path).collect()} == found


def test_statements_in_two_threads_keep_their_tables(spark, make_transactions):
    found = {}

    def run(customer):
        tx = make_transactions([(customer, "a", "2010-01-05", customer)])
        for _ in range(4):
            frame = views.run_query(spark, "WITH x AS (SELECT CustomerID c, '{}' b FROM transactions) SELECT * FROM x ORDER BY c", transactions=tx)
            found.setdefault(customer, set()).update((r.c, r.b) for r in frame.collect())

    threads = [threading.Thread(target=run, args=(c,)) for c in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {1: {(1, "{}")}, 2: {(2, "{}")}}


def test_line_totals_keep_parts_of_a_cent(spark):
    row = ("1", "s", "pin", 3, datetime(2010, 1, 1), 0.001, 1.0, "France")
    raw = spark.createDataFrame([row], "Invoice string, StockCode string, Description string, Quantity bigint, InvoiceDate timestamp_ntz, "
                                "Price double, `Customer ID` double, Country string")
    raw = raw.withColumn("Price", F.col("Price").cast("decimal(18,6)"))
    assert float(cleaning.clean_transactions(raw).first()["TotalPrice"]) == 0.003

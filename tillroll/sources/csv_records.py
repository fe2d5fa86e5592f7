"""CSV files with quoted line breaks, read by many tasks per file.

A line break ends a record only where an even number of quotes precedes it in the file. One pass
counts the quotes of each byte range; their sums tell whether a range begins inside a field. The
second pass puts the lines of each range together to records. A record that runs over the end of
a range is put together from its pieces, of which each range has two at most.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Name of the column that holds the record where it does not fit the schema.
REJECTED = "_rejected"
_WHOLE, _END, _BEGIN = 0, 1, 2
_FORMAT = {"quote": '"', "escape": '"', "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, line) in the order of the file within each range. Only \\n ends a line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"))


def _ranges(lines: DataFrame) -> dict[str, dict[int, bool]]:
    """For each byte range of each file, whether it begins inside a quoted field."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "range").agg((F.sum(quotes) % 2 == 1).alias("odd")).collect()
    found: dict[str, dict[int, bool]] = {}
    inside: dict[str, bool] = {}
    for row in sorted(odd, key=lambda r: (r["file"], r["range"])):
        before = inside.get(row["file"], False)
        found.setdefault(row["file"], {})[row["range"]] = before
        inside[row["file"]] = before != row["odd"]
    return found


def _assembler(ranges, header: bool):
    """The function for mapInArrow that gives (file, range, piece, record) from lines; `ranges` is a broadcast."""
    whole, end, begin = _WHOLE, _END, _BEGIN

    def assemble(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(file, start, piece, records):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([piece] * n, pa.int32()), records],
                names=["file", "range", "piece", "record"])

        def one(file, start, piece, parts):
            return rows(file, start, piece, pa.array(["\n".join(parts)], pa.string()))

        here, parts, piece, skip = None, [], whole, False
        for batch in batches:
            files, starts, lines = batch.columns
            keys = list(zip(files.to_pylist(), starts.to_pylist()))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != here:
                    if parts:
                        yield one(*here, begin if piece == whole else end, parts)
                    here, parts = keys[a], []
                    if here[1] not in ranges.value.get(here[0], {}):
                        raise RuntimeError(f"{here[0]} was cut into other ranges than when its quotes were counted; read it again")
                    open_ = ranges.value[here[0]][here[1]]
                    piece = end if open_ else whole
                    skip = header and here[1] == 0
                part = lines.slice(a, b - a)
                quotes = pc.count_substring(part, '"').to_numpy(zero_copy_only=False)
                after = (int(open_) + np.cumsum(quotes)) % 2 == 1
                before = np.append(open_, after[:-1])
                first = np.flatnonzero(~before)
                lead = int(first[0]) if len(first) else len(part)
                if lead:
                    parts += part.slice(0, lead).to_pylist()
                    if not after[lead - 1]:
                        done = one(*here, piece, parts)
                        parts, was, piece = [], piece, whole
                        if skip and was == whole:
                            skip = False
                        else:
                            yield done
                if len(first):
                    last = int(first[-1]) if after[-1] else len(part)
                    closed = first[first < last]
                    if len(closed):
                        offsets = pa.array(np.append(closed, last).astype(np.int32))
                        records = pc.binary_join(pa.ListArray.from_arrays(offsets, part), "\n")
                        if skip:
                            records, skip = records.slice(1), False
                        if len(records):
                            yield rows(*here, whole, records)
                    if after[-1]:
                        parts = part.slice(last).to_pylist()
                open_ = bool(after[-1])
        if parts:
            yield one(*here, begin if piece == whole else end, parts)

    return assemble


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, record): the records of the CSV files at path, without header lines and empty records.

    A quote in a field must be doubled and the field quoted, as CSV writers do. A file that is not
    compressed is read by as many tasks as it has byte ranges.
    """
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    pieces = lines.mapInArrow(
        _assembler(spark.sparkContext.broadcast(ranges), header), "file string, range bigint, piece int, record string")
    records = pieces.filter(F.col("piece") == _WHOLE).select("file", "record")
    if any(inside for starts in ranges.values() for inside in starts.values()):
        # A piece that begins a record takes its number, those after it up to its end follow.
        order = Window.partitionBy("file").orderBy("range", "piece")
        numbered = pieces.filter(F.col("piece") != _WHOLE).withColumn(
            "number", F.count_if(F.col("piece") == _BEGIN).over(order))
        joined = numbered.groupBy("file", "number").agg(
            F.array_sort(F.collect_list(F.struct("range", "piece", "record"))).alias("parts"))
        text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        whole = joined.select("file", text.alias("record"))
        records = records.unionByName(whole.filter("number > 0") if not header else whole)
    record = F.regexp_replace("record", "\r$", "")
    return records.select("file", record.alias("record")).filter(F.col("record") != "")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV files at path under a schema. A record that does not fit it ends the read."""
    fields = F.from_csv("record", _ddl(schema), _FORMAT | {"mode": "FAILFAST"})
    return read_records(spark, path).select(fields.alias("row")).select("row.*")


def read_csv_or_reject(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As `read_csv`, with a column `_rejected`: the record itself where it does not fit the schema, else NULL."""
    kept = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    fields = F.from_csv("record", _ddl(kept), _FORMAT | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
    return read_records(spark, path).select(fields.alias("row")).select("row.*")


def rejected_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, records, rejected) of the CSV files at path."""
    kept = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    fields = F.from_csv("record", _ddl(kept), _FORMAT | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
    return read_records(spark, path).select("file", fields[REJECTED].isNotNull().alias("bad")).groupBy("file").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("rejected"))

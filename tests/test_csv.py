from datetime import datetime

import pytest

from tickloom import errors
from tickloom.sources.csv_bars import HEADERLESS, BarLoader, ColumnMapping, detect_mapping, parse_timestamp, stream_bars

HEAD = "timestamp,open,high,low,close,volume\n"
GOOD = "2023-01-01T00:00:00Z,100.0,105.0,98.0,102.0,1000\n2023-01-01T01:00:00Z,102.0,107.0,100.0,104.0,1200\n"


@pytest.fixture
def write(tmp_path):
    def put(text, name="a.csv"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def test_basic_and_case_and_order(spark, write):
    want = [(0, 100.0, 105.0, 98.0, 102.0, 1000), (1, 102.0, 107.0, 100.0, 104.0, 1200)]
    for text in (HEAD + GOOD, HEAD.upper() + GOOD, "volume,close,low,high,open,timestamp\n1000,102.0,98.0,105.0,100.0,2023-01-01T00:00:00Z\n1200,104.0,100.0,107.0,102.0,2023-01-01T01:00:00Z\n"):
        rows = BarLoader(write(text)).load(spark).orderBy("row_idx").collect()
        assert [(r.row_idx, r.open, r.high, r.low, r.close, r.volume) for r in rows] == want


def test_headers():
    assert detect_mapping(["Vol", "c", "l", "h", "o", "dt"]) == ColumnMapping(5, 4, 3, 2, 1, 0)
    assert detect_mapping(["ts", "open", "high", "low", "close", "volume", "v"]).volume == 6
    with pytest.raises(errors.MissingColumn, match="volume"):
        detect_mapping(["timestamp", "open", "high", "low", "close"])
    with pytest.raises(errors.MissingColumn, match="timestamp"):
        detect_mapping([" timestamp", "open", "high", "low", "close", "volume"])


@pytest.mark.parametrize(
    ("row", "error", "text"),
    [
        ("2023-01-01T00:00:00Z,invalid,1,1,1,1", errors.InvalidDataType, "Invalid data type for column open: expected float, got invalid"),
        ("2023-01-01T00:00:00Z,1,1,1,1,1.5", errors.InvalidDataType, "column volume: expected unsigned integer, got 1.5"),
        ("2023-01-01T00:00:00Z,1,1,1,1,-1", errors.InvalidDataType, "got -1"),
        ("never,1,1,1,1,1", errors.InvalidCsvFormat, "Unable to parse timestamp at row 2: never"),
        ("2023-01-01T00:00:00Z,1,1", errors.InvalidCsvFormat, "Missing low field at row 2"),
        ("2023-01-01T00:00:00Z,100,95,98,99,1", errors.InvalidBar, "High price cannot be less than low price"),
    ],
)
def test_bad_rows(spark, write, row, error, text):
    path = write(HEAD + GOOD.split("\n")[0] + "\n" + row + "\n" + GOOD.split("\n")[1] + "\n")
    with pytest.raises(error) as e:
        BarLoader(path).load(spark)
    assert text in str(e.value)
    assert BarLoader(path, mode="drop").load(spark).count() == 2
    kept = BarLoader(path, mode="quarantine").load(spark).collect()
    assert [r.row_idx for r in kept if r.error] == [1] and text in [r.error for r in kept if r.error][0]


def test_validation_can_be_off(spark, write):
    path = write(HEAD + "2023-01-01T00:00:00Z,100,95,98,99,1\n")
    assert BarLoader(path).with_validation(False).load(spark).count() == 1


def test_empty(spark, write):
    for text in ("", HEAD):
        with pytest.raises(errors.EmptyDataset):
            BarLoader(write(text)).load(spark)


def test_without_headers(spark, write):
    text = "5.5,6.25,5.0,17,6.0,2019-03-01 10:30:00,1200,5.8\n6.0,6.5,5.75,5,5.9,2019-03-02 10:30:00,340,6.1\n"
    rows = BarLoader.without_headers(write(text)).load(spark).orderBy("row_idx").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(5.5, 6.25, 5.0, 6.0, 1200), (6.0, 6.5, 5.75, 5.9, 340)]
    assert HEADERLESS.timestamp == 5


def test_rows_are_numbered_over_splits_and_files(spark, tmp_path):
    """A folder of files that are read in many splits: consecutive numbers in order, the right row in the error, and rolling windows that are full."""
    from tickloom.operators import vwap

    (tmp_path / "in").mkdir()
    for f in range(3):
        lines = "".join(f"{1600000000 + 60 * (200 * f + k)},{10 + k % 7}.5,20,1,{10 + k % 5},{200 * f + k}\n" for k in range(200))
        (tmp_path / f"in/part{f}.csv").write_text(HEAD + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        bars = BarLoader(str(tmp_path / "in"), symbol="x").load(spark)
        assert bars.rdd.getNumPartitions() > 5
        assert [(r.row_idx, r.volume) for r in bars.orderBy("row_idx").collect()] == [(k, k) for k in range(600)]
        got = vwap.rolling_at_every_bar(bars, 20).where("data_points < 20").count()
        assert got == 19 and vwap.rolling(bars, 20).collect()[0].data_points == 20
        text = (tmp_path / "in/part2.csv").read_text().splitlines()
        text[100] = ",".join([text[100].split(",")[0], "bad", *text[100].split(",")[2:]])
        (tmp_path / "in/part2.csv").write_text("\n".join(text) + "\n")
        with pytest.raises(errors.InvalidDataType):
            BarLoader(str(tmp_path / "in")).load(spark).count()
        assert [r.row_idx for r in BarLoader(str(tmp_path / "in")).records(spark).where("error IS NOT NULL").collect()] == [499]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


TIMES = [
    ("2023-01-01T12:00:00Z", datetime(2023, 1, 1, 12), True),
    ("2023-01-01T12:00:00+02:00", datetime(2023, 1, 1, 10), True),
    ("2023-01-01 12:00:00-0100", datetime(2023, 1, 1, 13), True),
    ("2023-01-01 12:00:00", datetime(2023, 1, 1, 12), True),
    ("1672531200", datetime(2023, 1, 1), True),
    ("1672531200000", datetime(2023, 1, 1), True),
    ("03/04/2024 05:06:07", datetime(2024, 3, 4, 5, 6, 7), True),
    ("25/12/2024 05:06:07", datetime(2024, 12, 25, 5, 6, 7), True),
    ("2023-01-01", datetime(2023, 1, 1), False),
    ("2025-07-01T09:30:00", datetime(2025, 7, 1, 9, 30), False),
    ("2025-07-01T09:30:00.250Z", datetime(2025, 7, 1, 9, 30, 0, 250000), False),
    ("2023-01-01", None, True),
    ("2025-07-01T09:30:00", None, True),
    (" 2023-01-01 12:00:00", None, False),
    ("", None, False),
    ("2023-13-01 00:00:00", None, False),
]


def test_timestamps(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, t, strict) for k, (t, _, strict) in enumerate(TIMES)], "k int, t string, strict boolean")
    both = F.when(F.col("strict"), parse_timestamp(F.col("t"), True)).otherwise(parse_timestamp(F.col("t"), False))
    got = [r.x for r in rows.select("k", both.cast("timestamp_ntz").alias("x")).orderBy("k").collect()]
    assert got == [want for _, want, _ in TIMES]


def test_many_rows_keep_their_order(spark, write):
    text = "volume,timestamp,close,high,low,open\n" + "".join(f"{k},{1600000000 + 60 * k},{10 + k % 7}.5,20,1,{10 + k % 5}\n" for k in range(500))
    rows = BarLoader(write(text)).load(spark).orderBy("row_idx").collect()
    assert [(r.row_idx, r.volume, r.open) for r in rows] == [(k, k, 10 + k % 5) for k in range(500)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(HEAD + GOOD)
    (tmp_path / "in/b.csv").write_text(HEAD + "2023-01-02T00:00:00Z,bad,1,1,1,1\n2023-01-02T01:00:00Z,1,1,1,1,1\n")
    q = stream_bars(spark, str(tmp_path / "in"), ColumnMapping(0, 1, 2, 3, 4, 5)).writeStream.format("memory").queryName("csv_bars").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("csv_bars").count() == 3

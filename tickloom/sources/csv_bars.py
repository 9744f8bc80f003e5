"""CSV bars: flexible headers, explicit columns, strict parsing.

All columns are read as strings and parsed by expressions, so that a bad cell is known by its row and text. Headers are
matched by name, whatever their order and case. `mode`: "failfast" raises the error of the first bad row,
"quarantine" keeps rows with their error in a column `error`, "drop" leaves bad rows out.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import errors
from tickloom.operators.validation import bar_error

#: Header names by field.
ALIASES = {
    "timestamp": ("timestamp", "time", "date", "datetime", "dt", "ts"),
    "open": ("open", "o", "opening", "open_price"),
    "high": ("high", "h", "highest", "high_price"),
    "low": ("low", "l", "lowest", "low_price"),
    "close": ("close", "c", "closing", "close_price"),
    "volume": ("volume", "vol", "v", "quantity", "shares"),
}
FIELDS = tuple(ALIASES)
MODES = ("failfast", "quarantine", "drop")


@dataclass(frozen=True)
class ColumnMapping:
    """Positions of the fields."""

    timestamp: int
    open: int
    high: int
    low: int
    close: int
    volume: int


#: The eight-column layout without a header (trade_count and vwap are skipped).
HEADERLESS = ColumnMapping(timestamp=5, open=0, high=1, low=2, close=4, volume=6)


def detect_mapping(header: list[str]) -> ColumnMapping:
    """Positions by header name; of several headers for a field the last counts."""
    at: dict[str, int] = {}
    for k, name in enumerate(header):
        field = next((f for f, names in ALIASES.items() if name.lower() in names), None)
        if field:
            at[field] = k
    for field in FIELDS:
        if field not in at:
            raise errors.MissingColumn(field)
    return ColumnMapping(**at)


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    """The first format that fits; null if none does. Without `strict` also dates alone, fractions of a second and a T without zone.

    A pattern decides the format and one cast does the rest, which keeps the expression small enough to be compiled."""
    day, clock, zone = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}", r"[+-][0-9]{2}:?[0-9]{2}"
    forms = [f"{day}T{clock}(Z|{zone})", f"{day} {clock}({zone})?"]
    if not strict:
        forms += [day, f"{day}T{clock}", rf"{day}[T ]{clock}\.[0-9]{{1,6}}(Z|{zone})?"]
    iso = F.when(text.rlike(f"^({'|'.join(forms)})$"), F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))
    slashes = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) (" + clock + ")$"
    slashed = F.when(text.rlike(slashes), F.coalesce(F.regexp_replace(text, slashes, "$3-$1-$2 $4").try_cast("timestamp"), F.regexp_replace(text, slashes, "$3-$2-$1 $4").try_cast("timestamp")))
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("long"))
    return F.coalesce(iso, slashed, F.when(number > 1_000_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number)))


def parse_float(text: Column) -> Column:
    """Decimal numbers, inf, infinity and nan, without blanks around them."""
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.coalesce(number, F.when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(word == "nan", F.lit(float("nan"))))


def parse_volume(text: Column) -> Column:
    """Whole numbers without a minus sign."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))


@dataclass(frozen=True)
class BarLoader:
    """Options of a load; each with_ method returns a changed copy. memory_mapping and buffer_size are accepted and have
    no effect: Spark reads files in splits of its own."""

    path: str
    mapping: ColumnMapping | None = None
    header: bool | None = None
    validate: bool = True
    mode: str = "failfast"
    symbol: str | None = None
    strict: bool = False
    memory_mapping: bool = False
    buffer_size: int = 8192

    @classmethod
    def without_headers(cls, path: str) -> BarLoader:
        return cls(path, mapping=HEADERLESS)

    def with_column_mapping(self, mapping: ColumnMapping) -> BarLoader:
        """Positions also mean that the file has no header, unless `header` says otherwise."""
        return replace(self, mapping=mapping)

    def with_validation(self, on: bool) -> BarLoader:
        return replace(self, validate=on)

    def with_memory_mapping(self, on: bool) -> BarLoader:
        return replace(self, memory_mapping=on)

    def with_buffer_size(self, size: int) -> BarLoader:
        return replace(self, buffer_size=size)

    def _raw(self, spark: SparkSession) -> tuple[DataFrame, ColumnMapping]:
        has_header = self.mapping is None if self.header is None else self.header
        lines = spark.read.text(self.path)
        first = lines.limit(1).collect()
        if not first:
            raise errors.EmptyDataset
        names = next(csv.reader([first[0][0]]))
        mapping = self.mapping or detect_mapping(names)
        width = max(len(names), *(getattr(mapping, f) + 1 for f in FIELDS))
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
        return spark.read.schema(schema).csv(self.path, header=has_header, mode="PERMISSIVE", enforceSchema=True).select("*", *_place()), mapping

    def records(self, spark: SparkSession) -> DataFrame:
        """All rows with row_idx (0, 1, ... over the splits of a file and over files by path) and error (null for a good row). Rows aren't dropped
        and nothing is raised for them."""
        raw, mapping = self._raw(spark)
        return parse_rows(raw, mapping, self.symbol or "", self.validate, self.strict)

    def load(self, spark: SparkSession) -> DataFrame:
        """The bars. An empty file raises EmptyDataset, and in mode failfast the first bad row its error."""
        if self.mode not in MODES:
            raise errors.ConfigError("mode", f"must be one of {', '.join(MODES)}")
        rows = self.records(spark)
        if self.mode == "quarantine":
            return rows
        if self.mode == "failfast":
            bad = rows.where("error IS NOT NULL").orderBy("row_idx").limit(1).collect()
            if bad:
                raise _raised(bad[0])
            if rows.isEmpty():
                raise errors.EmptyDataset
        return rows.where("error IS NULL").drop("error", "error_kind", "error_column", "error_text")


def parse_rows(raw: DataFrame, mapping: ColumnMapping, symbol: str, validate: bool = True, strict: bool = False) -> DataFrame:
    """Bars with error columns from string columns c0, c1, ... In a stream row_idx is null: bars are told apart by time."""
    text = {f: F.col(f"c{getattr(mapping, f)}") for f in FIELDS}
    value = {"timestamp": parse_timestamp(text["timestamp"], strict), "volume": parse_volume(text["volume"])} | {f: parse_float(text[f]) for f in FIELDS[1:5]}
    numbered = raw.withColumn("row_idx", F.lit(None).cast("long")) if raw.isStreaming else numbered_lines(raw)
    cells = F.struct(*[text[f].alias(f"t_{f}") for f in FIELDS], *[value[f].alias(f) for f in FIELDS])
    parsed = numbered.select("row_idx", F.explode(F.array(cells)).alias("v")).select("row_idx", "v.*")  # filters aren't pushed through it: each cell is parsed once
    expected = {"timestamp": "timestamp", "volume": "unsigned integer"}
    bad = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("column"), F.col(f"t_{f}").alias("text"), F.lit(expected.get(f, "float")).alias("expected"))) for f in FIELDS]
    out = parsed.select(F.lit(symbol).alias("symbol"), "row_idx", *FIELDS, F.coalesce(*bad).alias("bad"))
    out = out.withColumn("invalid", F.when(F.col("bad").isNull(), bar_error()) if validate else F.lit(None).cast("string"))
    kind = F.when(F.col("bad").isNotNull(), F.when(F.col("bad.text").isNull(), "missing").otherwise("type")).when(F.col("invalid").isNotNull(), "invalid")
    out = out.select("symbol", "row_idx", *FIELDS, kind.alias("error_kind"), F.col("bad.column").alias("error_column"), F.coalesce("bad.text", "invalid", F.when(F.col("bad").isNotNull(), "")).alias("error_text"), F.col("bad.expected").alias("expected"))
    row, kind, time = (F.col("row_idx") + 1).cast("string"), F.col("error_kind"), F.col("error_column") == "timestamp"
    message = (
        F.when((kind == "missing") & time, F.concat(F.lit("Invalid CSV format: Missing timestamp column at row "), row))
        .when(kind == "missing", F.concat(F.lit("Invalid CSV format: Missing "), "error_column", F.lit(" field at row "), row))
        .when((kind == "type") & time, F.concat(F.lit("Invalid CSV format: Unable to parse timestamp at row "), row, F.lit(": "), "error_text"))
        .when(kind == "type", F.concat(F.lit("Invalid data type for column "), "error_column", F.lit(": expected "), "expected", F.lit(", got "), "error_text"))
        .when(kind == "invalid", F.concat(F.lit("Invalid OHLCV data: "), "error_text"))
    )
    return out.select("symbol", "row_idx", *FIELDS, message.alias("error"), "error_kind", "error_column", "error_text")


def _place() -> list[Column]:
    """Where a row stands: its file, the start of its split there, and a number that grows by one from row to row of a split."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at")]


def numbered_lines(raw: DataFrame) -> DataFrame:
    """row_idx over all splits, in order of file and place: rows are counted per split (one row each), the counts are prefixed, and a row's
    number within its split is added. The rows themselves aren't dealt."""
    splits = raw.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("__file").alias("f"), F.col("__start").alias("s"), (before - F.col("first")).alias("shift"))
    joined = raw.join(splits, (F.col("__file") == F.col("f")) & (F.col("__start") == F.col("s")))
    return joined.withColumn("row_idx", F.col("__at") + F.col("shift")).drop("__file", "__start", "__at", "f", "s", "shift")


def _raised(row: T.Row) -> errors.DataError:
    number = row.row_idx + 1
    if row.error_kind == "invalid":
        return errors.InvalidBar(row.error_text)
    if row.error_kind == "type" and row.error_column != "timestamp":
        return errors.InvalidDataType(row.error_column, "unsigned integer" if row.error_column == "volume" else "float", row.error_text)
    if row.error_kind == "type":
        return errors.InvalidCsvFormat(f"Unable to parse timestamp at row {number}: {row.error_text}")
    what = "timestamp column" if row.error_column == "timestamp" else f"{row.error_column} field"
    return errors.InvalidCsvFormat(f"Missing {what} at row {number}")


@dataclass(frozen=True)
class StreamingLoader:
    """Options of a stream of files; each with_ method returns a changed copy. chunk_size bounds the rows that a batch function gets at once, parallel is
    accepted and has no effect: splits are read in parallel anyway."""

    directory: str
    mapping: ColumnMapping | None = None
    chunk_size: int = 1000
    parallel: bool = True
    validate: bool = True
    symbol: str = ""
    files_per_batch: int = 1

    def with_chunk_size(self, rows: int) -> StreamingLoader:
        return replace(self, chunk_size=rows)

    def with_parallel(self, on: bool) -> StreamingLoader:
        return replace(self, parallel=on)

    def with_validation(self, on: bool) -> StreamingLoader:
        return replace(self, validate=on)

    def stream(self, spark: SparkSession) -> DataFrame:
        """Good rows of the files that arrive; the header of those that are there now gives the mapping unless one was given."""
        mapping = self.mapping or BarLoader(self.directory)._raw(spark)[1]
        return stream_bars(spark, self.directory, mapping, self.symbol, self.mapping is None, self.files_per_batch, self.validate)

    def chunks(self, spark: SparkSession) -> DataFrame:
        """The rows that are there now, with chunk: row_idx // chunk_size."""
        loaded = BarLoader(self.directory, self.mapping, validate=self.validate, symbol=self.symbol).load(spark)
        return loaded.withColumn("chunk", F.floor(F.col("row_idx") / self.chunk_size).cast("long"))


def stream_bars(spark: SparkSession, directory: str, mapping: ColumnMapping, symbol: str = "", header: bool = True, files_per_batch: int = 1, validate: bool = True) -> DataFrame:
    """A streaming DataFrame of the good rows of CSV files that arrive in a folder."""
    width = max(getattr(mapping, f) for f in FIELDS) + 1
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    raw = spark.readStream.schema(schema).option("header", header).option("maxFilesPerTrigger", files_per_batch).csv(directory)
    rows = parse_rows(raw, mapping, symbol, validate)
    return rows.where("error IS NULL").drop("error", "error_kind", "error_column", "error_text")

"""Tick files: reading, format detection, conversion, profiles, synthetic ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import with_prefix
from ..functions.quantiles import exact_quantiles
from ..operators.clean import cast_timestamp
from ..operators.validate import SchemaReport, schema_report
from ..schema import nan_to_null

#: CSV files of ticks: milliseconds since 1970, then prices and, perhaps, volumes. The header names the columns.
CSV_COLUMNS = {"timestamp": T.LongType(), "askPrice": T.DoubleType(), "bidPrice": T.DoubleType(), "askVolume": T.DoubleType(), "bidVolume": T.DoubleType()}


def resolve_format(path: str, fmt: str = "auto") -> str:
    if fmt != "auto":
        return fmt
    return "csv" if path.lower().rstrip("/").endswith(".csv") else "parquet"


def detect_format(spark: SparkSession, path: str) -> str:
    """By suffix, else by content: Parquet if its footer can be read, CSV if its header names the tick columns."""
    name = path.lower().rstrip("/")
    for suffix, fmt in ((".csv", "csv"), (".parquet", "parquet"), (".pq", "parquet")):
        if name.endswith(suffix):
            return fmt
    try:
        spark.read.parquet(path)
        return "parquet"
    except Exception as parquet_error:  # any failure to read the footer means another format
        first = spark.read.text(path).first()
        if first and {"timestamp", "askPrice", "bidPrice"} <= {x.strip() for x in first["value"].split(",")}:
            return "csv"
        raise ValueError(f"neither CSV nor Parquet ticks: {path}") from parquet_error


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, CSV_COLUMNS.get(c, T.StringType())) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_ticks(spark: SparkSession, path: str, fmt: str = "auto", symbol: str | None = None) -> DataFrame:
    """Ticks of one file or folder, timestamps as instants, NaN as null; symbol and seq are added where they lack.

    seq follows the file's order as Spark's splits keep it.
    """
    raw = _read_csv(spark, path) if resolve_format(path, fmt) == "csv" else spark.read.parquet(path)
    ticks = nan_to_null(cast_timestamp(raw))
    if symbol is not None or "symbol" not in ticks.columns:
        ticks = ticks.withColumn("symbol", F.lit(symbol or "?"))
    return ticks if "seq" in ticks.columns else ticks.withColumn("seq", F.monotonically_increasing_id())


def validate_file(spark: SparkSession, path: str, n_rows: int = 1000) -> tuple[SchemaReport, DataFrame]:
    """The schema's report, and a sample of n_rows of the file."""
    fmt = detect_format(spark, path)
    sample = (_read_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)).limit(n_rows)
    return schema_report(sample), sample


def csv_to_parquet(spark: SparkSession, path: str, out: str) -> None:
    ticks = _read_csv(spark, path)
    missing = [c for c in CSV_COLUMNS if c not in ticks.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    ticks.select(*CSV_COLUMNS).write.option("compression", "snappy").parquet(out)


def convert_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """CSV path -> Parquet path for several files; says what became of each. An empty or broken file doesn't stop the others."""
    done = {}
    for path, out in paths.items():
        try:
            if not _read_csv(spark, path).columns:
                done[path] = "empty"
                continue
            csv_to_parquet(spark, path, out)
            done[path] = "converted"
        except Exception as error:
            done[path] = f"failed: {error}"
    return done


def first_rows(ticks: DataFrame, n: int, order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    return ticks.orderBy(*order).limit(n)


def profile(ticks: DataFrame) -> DataFrame:
    """A row for each column: type, values, nulls, and of numbers least, most, mean and deviation. One pass."""
    numeric = {"double", "float", "bigint", "int"}
    cells = []
    for c, kind in ticks.dtypes:
        v = F.col(c).cast("double") if kind in numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.count(c).alias("n_values"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")))
    return ticks.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def spread_profile(ticks: DataFrame) -> DataFrame:
    s = F.col("askPrice") - F.col("bidPrice")
    rows = ticks.agg(F.count(s).alias("n"), F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.count_if(s == 0).alias("n_zero"))
    return rows.join(F.broadcast(exact_quantiles(ticks, {"median": (s, 0.5)}))).select("n", "low", "high", "mean", "median", "n_zero")  # one row each


def synthetic_ticks(spark: SparkSession, n: int, seed: int = 42, symbol: str = "SYN", start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Seeded ticks a second apart: a walk with steps of N(0, 1e-4), spreads of 1e-5 to 5e-5, volumes of 100 to 1000.

    Draws depend on a tick's number and the seed, so neither on partitions.
    """
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    rows = spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("seq"), (F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id"))).alias("timestamp"), (normal * 1e-4).alias("step"), (1e-5 + 4e-5 * u(2)).alias("spread"), (100 + 900 * u(3)).alias("bidVolume"), (100 + 900 * u(4)).alias("askVolume"))
    bid = 1.1 + F.col("walk")
    return with_prefix(rows, sums={"walk": "step"}).select("symbol", "seq", "timestamp", bid.alias("bidPrice"), (bid + F.col("spread")).alias("askPrice"), "bidVolume", "askVolume")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")

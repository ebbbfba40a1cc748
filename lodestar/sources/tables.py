"""Delimited rates, the partitioned price store and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.functions.scalars import number

FX_COLUMNS = "BASE_CUR string, UNIT_MULT string, TIME_PERIOD string, OBS_VALUE string"
RATE_COLUMNS = "FREQ string, INSTRUMENT_TYPE string, TENOR string, UNIT_MEASURE string, TIME_PERIOD string, OBS_VALUE string"


def read_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon file with a header; every column as text, no inference pass."""
    return spark.read.option("sep", ";").option("header", True).csv(path)


def fx_rates(rows: DataFrame) -> DataFrame:
    """Rate per one unit of currency; rows that do not parse are dropped."""
    rate = number(F.col("OBS_VALUE")) / F.pow(F.lit(10.0), F.col("UNIT_MULT").try_cast("int"))
    return rows.select(F.col("TIME_PERIOD").try_cast("date").alias("date"), F.col("BASE_CUR").alias("currency"), rate.alias("rate")).dropna()


def policy_rates(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("TIME_PERIOD").try_cast("date").alias("date"), number(F.col("OBS_VALUE")).alias("rate")).dropna()


# ------------------------------------------------------------------ price store: parquet partitioned by year

def write_store(closes: DataFrame, root: str, years: DataFrame | None = None) -> None:
    """Write closes by year; with ``years`` only those partitions are replaced."""
    df = closes.withColumn("year", F.year("date"))
    if years is not None:
        df = df.join(years.select("year"), "year", "left_semi")
    (df.repartitionByRange("year", "asset").sortWithinPartitions("year", "asset", "date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{root}/close"))


def read_store(spark: SparkSession, root: str, since_year: int | None = None) -> DataFrame:
    df = spark.read.schema("asset string, date date, close double, year int").parquet(f"{root}/close")
    return df if since_year is None else df.where(F.col("year") >= since_year)


def drop_years(spark: SparkSession, root: str, years: list[int]) -> None:
    """Delete the partitions of years without rows, in whatever file system the store is."""
    for y in years:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/close/year={y}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ------------------------------------------------------------------ exports

def clean_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    def fix(c: str, t: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(~bad, F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
    return df.select(*[fix(c, t) for c, t in df.dtypes])


def json_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, compact JSON document) with nulls kept."""
    return clean_floats(df).select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def csv_decimal(c: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def csv_lines(df: DataFrame, key: str, digits: dict[str, int], comma: bool = False) -> DataFrame:
    """(key, line): numbers with fixed decimals; with ``comma`` a semicolon line with decimal commas, quoted where needed."""
    sep = ";" if comma else ","
    cells = []
    for c in df.columns:
        v = csv_decimal(F.col(c), digits[c]) if c in digits else F.col(c).cast("string")
        v = F.replace(v, F.lit("."), F.lit(",")) if comma and c in digits else v
        v = F.coalesce(v, F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.when(v.rlike(f'["{sep}\n]'), quoted).otherwise(v))
    return df.select(key, F.concat_ws(sep, *cells).alias("line"))


def write_json(df: DataFrame, path: str) -> None:
    clean_floats(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)

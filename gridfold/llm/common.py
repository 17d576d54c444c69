"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.session import scratch_path

# the white space of all word rules: blank and the five controls 0x09-0x0D
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name (names may hold dots or blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct, so that operators can add columns
    without clashing with the caller's; ``unpack`` restores them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpack(df: DataFrame, columns: list[str], name: str = "_row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: maximal runs without white space (in SPACE_CHARS)."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column by way of a generator that gives one row for each row.  No
    condition is moved below it and its expression is never copied into others,
    so it is computed once a row, whatever is later done with the result."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the cluster's shared folder and reread:
    later jobs start from the files, whichever executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

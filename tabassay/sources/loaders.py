"""Tables in and out: CSV with many spellings of null, Parquet, and what a file holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabassay.errors import ConfigError, PreparationError
from tabassay.operators.caster import quoted

# Spellings of a missing value in CSV.
MISSING = ("", "NA", "N/A", "n/a", "null", "NULL", "None", "NaN", "nan", "-NaN", "-nan", "#N/A", "#NA", "<NA>", "NULL", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def clean(table: DataFrame) -> DataFrame:
    """Strings stripped, empty and null spellings null, rows and columns of nulls alone left out."""
    texts = {n for n, t in table.dtypes if t == "string"}
    stripped = table.select(*[F.when(~F.trim(quoted(n)).isin(*MISSING), F.trim(quoted(n))).alias(n) if n in texts else quoted(n) for n in table.columns])
    seen = stripped.agg(*[F.count(quoted(n)).alias(f"n{k}") for k, n in enumerate(stripped.columns)]).first()
    kept = [n for k, n in enumerate(stripped.columns) if seen[f"n{k}"]]
    if not kept:
        raise PreparationError("the table is empty")
    return stripped.select(*map(quoted, kept)).na.drop("all")


def load_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = True, **options) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).options(**options)
    return clean(retyped(clean(reader.csv(path)))) if infer else clean(reader.csv(path))


def retyped(table: DataFrame) -> DataFrame:
    """String columns whose every value is a number become numbers; one aggregate decides for all."""
    texts = [n for n, t in table.dtypes if t == "string"]
    if not texts:
        return table
    bad = table.agg(*[F.count(F.when(quoted(n).isNotNull() & quoted(n).try_cast("double").isNull(), 1)).alias(f"d{k}") for k, n in enumerate(texts)], *[F.count(F.when(quoted(n).isNotNull() & ~quoted(n).rlike(r"^[+-]?[0-9]{1,18}$"), 1)).alias(f"i{k}") for k, n in enumerate(texts)]).first()
    kind = {n: "bigint" if not bad[f"i{k}"] else "double" if not bad[f"d{k}"] else "string" for k, n in enumerate(texts)}
    return table.select(*[quoted(n).try_cast(kind[n]).alias(n) if kind.get(n, "string") != "string" else quoted(n) for n in table.columns])


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*map(quoted, columns)) if columns else table


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix; anything but .csv, .tsv and .txt is read as Parquet."""
    if not path or path == "None":
        raise ConfigError("a table's path is missing")
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv", "txt"):
        return load_csv(spark, path, **({"sep": "\t"} if suffix == "tsv" else {}) | options)
    return load_parquet(spark, path)


def load_pair(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """real and synthetic of a configuration's data section, each with its own separator."""
    out = []
    for side in ("real", "synthetic"):
        sep = data.get(f"{side}_sep", data.get("sep"))
        out.append(load(spark, data.get(side), **({"sep": sep} if sep else {})))
    return out[0], out[1]


def save_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def file_info(spark: SparkSession, path: str) -> dict:
    """Size, suffix, and the types of a few rows, through Hadoop's file system, so any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    return {"path": path, "bytes": size, "suffix": path.rsplit(".", 1)[-1], "types": dict(load(spark, path).limit(5).dtypes) if size else {}}

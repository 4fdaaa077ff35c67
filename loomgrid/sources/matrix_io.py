"""Writing and reading matrices, tables and their JSON companions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.resolver import list_files


def save_matrix(cells: DataFrame, path: str) -> None:
    """Long cells as parquet, values as FLOAT, laid out by column for column-wise readers."""
    cells.withColumn("value", F.col("value").cast("float")).write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet if the path holds such files, else CSV; what cannot be read is the reader's error."""
    if path.endswith(".parquet") or list_files(spark, f"{path}/*.parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_text(spark: SparkSession, path: str, chunks: Iterable[str]) -> None:
    """A text file in any file system that Spark knows, chunk by chunk."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk, "utf-8"))
    finally:
        out.close()


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_json(spark: SparkSession, document: dict, path: str) -> None:
    write_text(spark, path, [json.dumps(document, indent=2, default=str)])


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """``model_id, split`` from a frozen assignment; the document is parsed in a task, not on the driver."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "assignment map<string,string>").alias("d"))
    return text.select(F.explode("d.assignment").alias("model_id", "split"))


def save_splits(assigned: DataFrame, path: str, provenance: dict | None = None, verification: dict | None = None, summary: dict | None = None) -> None:
    """The frozen assignment with what is known of it; models stream through the driver in order, a few at a time."""
    head = json.dumps({"provenance": provenance or {}, "verification": verification or {}, "summary": summary or {}}, indent=2, default=str)

    def chunks() -> Iterator[str]:
        yield head.rstrip()[:-1].rstrip() + ',\n  "assignment": {'
        comma, batch = "", []
        for r in assigned.select("model_id", "split").orderBy("model_id").toLocalIterator():
            batch.append(f"{comma}\n    {json.dumps(r['model_id'])}: {json.dumps(r['split'])}")
            comma = ","
            if len(batch) == 10_000:
                yield "".join(batch)
                batch = []
        yield "".join(batch) + "\n  }\n}\n"

    write_text(assigned.sparkSession, path, chunks())


def cached_table(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The CSV at ``path`` with the given types, built and written first if it is not there; rows with a missing value are left out."""
    if not list_files(spark, f"{path}*"):
        build().write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(schema).csv(path).na.drop("any")


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """``row_key, x`` as parquet, under the name that :func:`load_embeddings` looks for."""
    vectors.select(F.col("row_key").alias("ModelID"), F.col("x").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str, key: str = "ModelID") -> DataFrame:
    """``row_key, x``: the numeric columns (or one array column) as an array; none is an error."""
    df = load_table(spark, path)
    arrays = [c for c, t in df.dtypes if t.startswith("array<")]
    if arrays:
        return df.select(F.col(key).cast("string").alias("row_key"), F.col(arrays[0]).cast("array<double>").alias("x"))
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != key]
    if not numbers:
        raise ValueError(f"{path} has no numeric column")
    return df.select(F.col(key).cast("string").alias("row_key"), F.array(*[F.col(f"`{c}`").cast("double") for c in numbers]).alias("x"))


def save_components(cells: DataFrame, rows: DataFrame, columns: DataFrame, path: str) -> None:
    """The sparse matrix and its row and column tables as three tables."""
    cells.filter(F.col("value") != 0).write.mode("overwrite").parquet(f"{path}/X")
    rows.write.mode("overwrite").parquet(f"{path}/obs")
    columns.write.mode("overwrite").parquet(f"{path}/var")

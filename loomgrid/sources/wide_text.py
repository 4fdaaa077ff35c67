"""Very wide delimited matrices read as text and turned into long cells.

A matrix of 20,000 columns is never a table of 20,000 columns: each line is
split once, in the JVM, and exploded with its column position.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.operators.cells import keep_first, non_numeric_columns


def read_header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [h.strip() for h in next(csv.reader([line[0].lstrip("\ufeff")]))]


#: A field after a comma that is put before the line: quoted, with doubled quotes inside, or plain.
_FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def split_line(line: Column) -> Column:
    """The fields of a delimited line; lines without a quote take the plain way."""
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1)), lambda x: F.trim(x))


def line_order() -> Column:
    """Where a line stands: file, block of the file, place in the partition that reads the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def not_missing(text: Column) -> Column:
    return F.when(text.isin(config.NA_TOKENS), None).otherwise(text)


def read_wide(spark: SparkSession, path: str, key: str | None = None, drop: list[str] = (), rows: int | None = None, keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """``ord, row_key, col_key, col_pos, raw``, the columns ``keep``, and the feature labels in order.

    ``path``: a file, or a folder of files each with the same header.  ``key``:
    header of the key column; None for the first column, whatever its header.
    Columns without a header or called ``Unnamed:`` are no features, nor are
    those in ``drop``; those in ``keep`` stay as columns of the row.  ``rows``
    reads only the first lines.  Missing tokens become NULL.  ``ord`` follows the
    files by name and their lines.  A missing column is a KeyError.  Fields may
    be quoted and hold commas, but no line ends.
    """
    header = read_header(spark, path)
    for name in [*([key] if key is not None else []), *keep]:
        if name not in header:
            raise KeyError(f"{path} has no column {name!r}")
    at = header.index(key) if key is not None else 0
    skip = {at} | {i for i, h in enumerate(header) if not h or h.startswith("Unnamed:") or h in drop or h in keep}
    labels = [(i, h) for i, h in enumerate(header) if i not in skip]
    lines = spark.read.text(path).select(line_order().alias("ord"), "value").filter(F.trim("value") != "")
    if rows is not None:
        lines = lines.orderBy("ord").limit(rows + 1)
    kept = [not_missing(F.get("f", F.lit(header.index(k)))).alias(k) for k in keep]
    fields = lines.select("ord", split_line(F.col("value")).alias("f"))
    # each file begins with the header
    heads = F.array(*[F.lit(h) for h in header[:50]])
    fields = fields.filter(~(F.transform(F.slice("f", 1, 50), lambda x: F.regexp_replace(x, "^\ufeff", "")) == heads))
    split = fields.select("ord", not_missing(F.get("f", F.lit(at))).alias("row_key"), *kept, "f")
    # one row per header field, which the driver has just read
    names = F.broadcast(spark.createDataFrame([(i, n, h) for n, (i, h) in enumerate(labels)], "i int, col_pos int, col_key string"))
    long = split.select("ord", "row_key", *[F.col(f"`{k}`") for k in keep], F.posexplode("f").alias("i", "raw")).join(names, "i")
    return long.select("ord", "row_key", *[F.col(f"`{k}`") for k in keep], "col_key", "col_pos", not_missing(F.col("raw")).alias("raw")), [h for _, h in labels]


def read_metadata(spark: SparkSession, path: str, wanted: list[str] = config.METADATA_COLUMNS) -> tuple[DataFrame, list[str]]:
    """The wanted columns that are there (all text, missing tokens NULL) with ``_ord``, and the names of the others."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = [c for c in wanted if c in df.columns]
    if wanted[0] not in df.columns:
        raise KeyError(f"{path} has no column {wanted[0]!r}")
    return df.select(line_order().alias("_ord"), *[not_missing(F.col(f"`{c}`")).alias(c) for c in have]), [c for c in wanted if c not in df.columns]


def read_response(spark: SparkSession, path: str | None) -> tuple[DataFrame | None, dict]:
    """An optional matrix of responses as cells, lines on the rows whatever the file has, and what was found.

    No file: ``status`` is ``absent``.  Neither axis with model ids:
    ``unrecognised_layout``.  Of repeated lines or compounds the first counts.
    """
    if path is None:
        return None, {"status": "absent"}
    raw, labels = read_wide(spark, path)
    found = numeric_cells(raw)
    first = [r[0] for r in spark.read.text(path).select(F.trim(split_line(F.col("value"))[0]).alias("k")).limit(config.LOOK + 1).collect()][1:]
    # the first labels of each axis
    keys = lambda names: sum(str(n).startswith(config.MODEL_PREFIX) for n in names) >= max(1, len(names) // 2)
    if not keys(first):
        if not keys(labels[: config.LOOK]):
            return None, {"status": "unrecognised_layout"}
        found = found.select(F.struct(F.col("col_pos").alias("pos"), "ord").alias("ord"), F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value")
    report = {"status": "present", "transposed": not keys(first)}
    return keep_first(found.filter("row_key is not null and col_key is not null").select("ord", "row_key", "col_key", "value"), ["row_key", "col_key"], "ord").drop("ord"), report


def numeric_cells(raw: DataFrame) -> DataFrame:
    """Cells as FLOAT without the columns that hold a text that is no number."""
    bad = non_numeric_columns(raw).select("col_key")
    return raw.join(bad, "col_key", "left_anti").withColumn("value", F.trim("raw").try_cast("float")).drop("raw")

"""Result-table sinks (A5) and keyed upsert of stored tables.

Result tables are small (one row per metric, level, fold or threshold);
``single_file=True`` writes them as one file for people to read, which is
only offered for such bounded tables.  Data-sized frames keep Spark's
parallel part files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import upsert_by_key
from ..session import ensure_checkpoint_dir


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False,
                mode: str = "overwrite") -> str:
    """Write one table as parquet (default), csv (header, no index) or json."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 single_file: bool = False) -> dict[str, str]:
    return {name: write_table(df, f"{root.rstrip('/')}/{name}", fmt, single_file)
            for name, df in tables.items()}


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def upsert_table(spark: SparkSession, path: str | None, new: DataFrame, key: str = "slug",
                 fmt: str = "parquet") -> str:
    """Replace the rows of every ``key`` value in ``new`` in the table at
    ``path`` (created if absent).  Spark cannot overwrite a path it is
    reading, so the merged table goes to a new path, which is returned."""
    out = scratch_path(spark, "upserts")
    current = None
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            current = spark.read.format(fmt).load(path)
    merged = new if current is None else upsert_by_key(current, new, key)
    merged.write.format(fmt).mode("overwrite").save(out)
    return out

"""CSV scan with an explicit schema (A1) and null-token normalisation (A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..presets import NULL_TOKENS, UK_COLUMNS, UK_DOUBLE_COLUMNS, UK_LONG_COLUMNS


def uk_schema() -> T.StructType:
    """Explicit 33-field schema of the collision CSV, in file order.

    No inference: ``Accident_Index`` is always a string, so scientific-notation
    identifiers cannot turn into floats in one file split and stay strings in
    another.
    """
    def kind(name: str) -> T.DataType:
        if name in UK_LONG_COLUMNS:
            return T.LongType()
        if name in UK_DOUBLE_COLUMNS:
            return T.DoubleType()
        return T.StringType()
    return T.StructType([T.StructField(c, kind(c), True) for c in UK_COLUMNS])


#: What `read_raw` does with a cell that its column's type can't hold.
BAD_CELLS = ("raise", "null", "ledger")
#: Column of the ledger: the row's bad cells as ``column, value``.
LEDGER = "_bad_cells"


def _typed(name: str, kind: T.DataType) -> Column:
    """The cell as its type, null if it isn't one.  Whole numbers may have a decimal point or
    an exponent (``3.0``), as writers that know one kind of number only put them."""
    c = F.col(f"`{name}`")
    plain = c.try_cast(kind)
    if not isinstance(kind, T.IntegralType):
        return plain
    wide = c.try_cast("decimal(38, 6)")
    return F.coalesce(plain, F.when(wide == F.floor(wide), wide.try_cast(kind)))


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             tokens: tuple[str, ...] = NULL_TOKENS, bad_cells: str = "raise") -> DataFrame:
    """Scan a headered CSV with a fixed schema.

    Every field is read as a string first so the full null-token set can be
    applied (Spark's reader knows one ``nullValue``), and then becomes its type.  A cell that doesn't:
    ``raise`` fails the job and names column and value; ``null`` makes it null; ``ledger`` does so and
    lists the row's bad cells in the further column ``_bad_cells``, which `bad_cell_counts` sums up.
    Doubled quotes inside quoted fields are quotes, and a header that
    differs from the schema's columns or order fails.  A missing path raises ``FileNotFoundError`` with a hint.
    """
    if bad_cells not in BAD_CELLS:
        raise ValueError(f"bad_cells is one of {BAD_CELLS}, not {bad_cells!r}")
    schema = schema or uk_schema()
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"no CSV at {path}; it holds the collision table")
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    text = (spark.read.schema(as_text).option("header", True).option("mode", "PERMISSIVE")
            .option("nullValue", None).option("emptyValue", "")
            .option("escape", '"').option("enforceSchema", False).csv(path))
    text = normalise_null_tokens(text, [f.name for f in schema.fields], tokens)
    columns, ledger = [], []
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            columns.append(cell)
            continue
        value = _typed(f.name, f.dataType)
        bad = cell.isNotNull() & value.isNull()
        if bad_cells == "raise":
            fault = F.raise_error(F.concat(F.lit(f"{f.name} holds no {f.dataType.simpleString()}: "), cell))
            value = F.when(bad, fault.cast(f.dataType)).otherwise(value)
        ledger.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), cell.alias("value"))))
        columns.append(value.alias(f.name))
    if bad_cells == "ledger":
        found = F.array_compact(F.array(*ledger)) if ledger else F.array().cast("array<struct<column: string, value: string>>")
        columns.append(found.alias(LEDGER))
    return text.select(*columns)


def bad_cell_counts(df: DataFrame) -> DataFrame:
    """``column, value, rows``: how often each value stands where its column's type can't hold it."""
    return (df.select(F.inline(LEDGER)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")))


def normalise_null_tokens(df: DataFrame, columns: list[str] | None = None,
                          tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Turn every listed token (exact, case-sensitive) into null, in one
    projection.  The listed columns come back as strings, the others as they are."""
    columns = columns if columns is not None else df.columns
    target = set(columns)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in target:
            s = c.cast("string")
            out.append(F.when(s.isin(*tokens), F.lit(None).cast("string"))
                       .otherwise(s).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that separate words, the same in every engine.
SPACE = r"\x20\x09-\x0D"
#: A word.
WORD = rf"[^{SPACE}]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def whole_text(text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def with_row_number_ids(df: DataFrame, name: str) -> DataFrame:
    """Adds a number that identifies the row.  It is only stable once the
    result is stored (`stratakit.session.write_once`)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def gapless_rank(stored: DataFrame, by: list[str], row: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each ``by`` group of a stored table.

    ``row`` is the table's row number from `with_row_number_ids`, whose upper
    bits name the task that wrote the row.  Rows are numbered within (group,
    task), so a group that holds a third of all rows is spread over as many
    tasks as wrote it; the groups' offsets come from counts per (group, task),
    of which there are at most as many as tasks in a group's window.  The result
    doesn't depend on which rows share a key, and no row leaves its order of
    storage."""
    part = F.shiftright(F.col(row), 33)
    tagged = stored.withColumn("__part", part)
    keys = [*by, "__part"]
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(*keys).agg(F.count("*").alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before"))
    local = Window.partitionBy(*keys).orderBy(row)
    ranked = tagged.withColumn("__rank", F.row_number().over(local) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return (ranked.join(offsets, on=same, how="inner")
            .withColumn(name, (F.col("__rank") + F.col("__before")).cast("long"))
            .drop("__rank", "__before", "__part", *(f"__k{i}" for i in range(len(keys)))))


#: A group is hot from this share of all rows on, so at most its inverse of them are.
HOT_SHARE = 1e-3


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: Column | None = None) -> DataFrame:
    """``rows`` joined with their group's line of ``groups``; both are stored tables, no key is null, and
    ``size`` is the group's number of rows, kept as a column.

    Rows of hot groups, of which there are at most 1,000 whatever the data, find
    their line by broadcast and are never brought to one task; all others are
    joined by key.  ``hot`` narrows the hot groups further, for lines without a
    bounded size; those it leaves out are joined by key too."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(HOT_SHARE * total, 1)
    if hot is not None:
        is_hot = is_hot & hot
    few = F.broadcast(groups.filter(is_hot))
    return rows.join(few, keys).unionByName(
        rows.join(F.broadcast(groups.filter(is_hot).select(*keys)), keys, "left_anti").join(groups.filter(~is_hot), keys))


def keep_rows(docs: DataFrame, decided: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that
    ``decided`` (``__id``, ``__digest``) names; of several rows with the same
    id and digest, one.  ``digest`` is an expression over the row's columns,
    reached as ``__doc.<name>``."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")).withColumn("__mine", digest)
    found = whole.join(decided, F.col(f"__doc.`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__mine") == F.col("__digest")))
    first = Window.partitionBy("__id", "__mine").orderBy(F.xxhash64("__doc"))
    return (found.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
            .select(*(F.col(f"__doc.`{c}`") for c in docs.columns)))

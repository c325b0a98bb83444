"""Writing results: text with a header, tables, JSON rows, and dry runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def write_csv(df: DataFrame, path: str, append: bool = False, overwrite: bool = False) -> None:
    """CSV with a header in every part file; quotes inside values are doubled. Append wins over overwrite."""
    mode = "append" if append else "overwrite" if overwrite else "error"
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """What :func:`write_csv` wrote; statements may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_table(df: DataFrame, name: str, append: bool = False, overwrite: bool = False) -> None:
    """A table: made anew with ``overwrite``, kept and added to with ``append``, else emptied and filled."""
    if not _NAME.match(name):
        raise ValueError(f"{name}: not a plain table name")
    spark = df.sparkSession
    if overwrite or not spark.catalog.tableExists(name):
        df.write.mode("overwrite").saveAsTable(name)
    elif append:
        df.write.mode("append").saveAsTable(name)
    else:
        df.write.insertInto(name, overwrite=True)


def write_templates(stats: DataFrame, csv_path: str | None = None, table: str | None = None, overwrite: bool = True) -> None:
    """Template statistics beside an export: a CSV folder ``<stem>_templates``, always new, or table ``sql_templates``."""
    if csv_path:
        write_csv(stats, re.sub(r"(\.csv)?/?\Z", "_templates.csv", csv_path, count=1), overwrite=True)
    if table:
        write_table(stats, table, overwrite=overwrite)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def dry_run(df: DataFrame) -> dict[str, int]:
    """Run everything, write nothing, count what an export would have written."""
    seen = Observation("export")
    df.observe(seen, F.count(F.lit(1)).alias("exported")).write.format("noop").mode("overwrite").save()
    return seen.get


def export(df: DataFrame, csv_path: str | None = None, table: str | None = None, sink: Callable[[DataFrame], None] | None = None, append: bool = False, overwrite: bool = False) -> None:
    """One sink a run: a function of one's own, else CSV, else a table."""
    if sink:
        sink(df)
    elif csv_path:
        write_csv(df, csv_path, append, overwrite)
    elif table:
        write_table(df, table, append, overwrite)
    else:
        raise ValueError("a sink, a CSV path or a table name is needed")

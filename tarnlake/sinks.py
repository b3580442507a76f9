"""Results as JSON lines or tab-separated text, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row; nulls and empty arrays are left out."""
    def kept(f) -> Column:
        c = F.col(f"`{f.name}`")
        return (F.when(F.size(c) > 0, c) if isinstance(f.dataType, ArrayType) else c).alias(f.name)

    return rows.select(F.to_json(F.struct(*[kept(f) for f in rows.schema]), {"ignoreNullFields": "true"}).alias("value"))


def tsv_lines(rows: DataFrame) -> DataFrame:
    """A row's values with tabs between; tabs, line ends and backslashes inside are escaped, null is empty."""
    def cell(name: str) -> Column:
        c = F.replace(F.col(f"`{name}`").cast("string"), F.lit("\\"), F.lit("\\\\"))
        for raw, out in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(out))
        return F.coalesce(c, F.lit(""))

    return rows.select(F.concat_ws("\t", *[cell(c) for c in rows.columns]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)

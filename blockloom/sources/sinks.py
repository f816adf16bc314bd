"""Results as files: JSON lines, JSON arrays, flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.plans.execute import Execution
from blockloom.sources.files import Files


def write_lines(execution: Execution, path: str, compression: str | None = "gzip") -> None:
    """One block per line, in block order over the files; bounded by the budget, so few."""
    writer = execution.blocks().select("json").write
    (writer.option("compression", compression) if compression else writer).text(path)


def write_array(execution: Execution, folder: str, name: str) -> bool:
    """One JSON array as a new file; False where the file exists."""
    return Files(execution.tables.get(execution.plan.catalog.header.name).sparkSession, folder).create(name, execution.json_array())


def flat_rows(df: DataFrame, explicit_nulls: bool = True) -> DataFrame:
    """Every row as one JSON object (column ``json``)."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not explicit_nulls).lower()}).alias("json"))

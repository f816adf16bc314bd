"""A directory with every table, all empty."""

from pathlib import Path


def write(spark, source: str, target: str) -> str:
    for file in sorted(Path(source).glob("*.parquet")):
        spark.read.parquet(str(file)).limit(0).write.mode("overwrite").parquet(f"{target}/{file.name}")
    return target

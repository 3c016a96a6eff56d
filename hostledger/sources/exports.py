"""Report and history files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def export_rows(rows: DataFrame, path: str, kind: str = "json", max_rows_per_file: int = 0) -> None:
    """Write rows as JSON lines or as CSV with a header."""
    writer = rows.write if kind == "json" else flat(rows).write
    writer = writer.mode("overwrite")
    if max_rows_per_file > 0:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"kind must be json or csv, not {kind!r}")


def write_parts(parts: DataFrame, path: str, parts_per_folder: int = 1000) -> None:
    """Write the frame of ``report_parts``, sorted by part, in a folder for every ``parts_per_folder`` parts."""
    folder = F.floor((F.col("part") - 1) / parts_per_folder)
    (
        parts.withColumn("folder", folder)
        .hint("rebalance", "folder")
        .sortWithinPartitions("folder", "part", "rn")
        .write.mode("overwrite")
        .partitionBy("folder")
        .json(path)
    )


def append_scan_events(events: DataFrame, path: str) -> None:
    """Add events to the run log."""
    events.write.mode("append").parquet(path)

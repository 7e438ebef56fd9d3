"""Record files: JSON lines in order, a bounded number in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_files(lines: DataFrame, folder: str, order: str, size: int) -> str:
    """Writes (order, value) as text, one file for each ``size`` numbers of ``order``, and returns the folder. Names of parts have leading zeros: by name is by number."""
    part = F.lpad(F.floor(F.col(order) / size).cast("string"), 12, "0").alias("part")
    lines.select(part, order, "value").repartition("part").sortWithinPartitions("part", order).select("part", "value").write.partitionBy("part").text(folder)
    return folder

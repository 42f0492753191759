"""Time travel over element histories."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_cutoff(text: str) -> int:
    """Seconds since 1970, as a number or as ``YYYY-MM-DDThh:mm:ssZ``."""
    if text.lstrip("-").isdigit():
        return int(text)
    return int(datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())


def time_filter(history: DataFrame, cutoff: int, order: str = "seq") -> DataFrame:
    """Of each (kind, id), the last row in file order at or before the cutoff, unless that row is a deletion.

    A missing time counts as 0 and a missing ``visible`` as true.
    """
    rest = [c for c in history.columns if c not in ("kind", "id")]
    upto = history.where(F.coalesce(F.col("ts_s"), F.lit(0)) <= cutoff)
    last = upto.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), order).alias("_e")).select("kind", "id", "_e.*")
    return last.where(F.coalesce("visible", F.lit(True)))


def snapshot_filter(elements: DataFrame, cutoff: int) -> DataFrame:
    """Of a file with one version each: elements at or before the cutoff that are visible."""
    return elements.where((F.coalesce(F.col("ts_s"), F.lit(0)) <= cutoff) & F.coalesce("visible", F.lit(True)))

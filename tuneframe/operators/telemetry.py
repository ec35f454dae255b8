"""Host telemetry snapshots -> device rows, latest state, rollups.

Snapshots are ``(ts, host, cpu_pct, ram_total, ram_available, gpus[])``.
Unit conversion is a projection (missing sensors stay null), device rows an
``explode``, the latest snapshot per device a ``max_by`` aggregate and the
rollup a tumbling ``window`` aggregate; all work on batch and streaming
frames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024


def device_rows(snapshots: DataFrame) -> DataFrame:
    """G1 + G2 (explode): one row per device with converted units.

    Sensors that a snapshot doesn't carry (disk, power limit, fan) are null.
    """
    of_host = [c for c in ("disk_used", "disk_total") if c in snapshots.columns]
    e = snapshots.select("ts", "host", "cpu_pct", "ram_total", "ram_available", *of_host, F.explode("gpus").alias("g"))
    sensors = e.schema["g"].dataType.names

    def sensor(name: str):
        return F.col(f"g.{name}").cast("double") if name in sensors else F.lit(None).cast("double")

    def disk(name: str):
        return (F.col(name) / GIB if name in of_host else F.lit(None).cast("double")).alias(f"{name}_gb")

    return e.select(
        "ts",
        "host",
        F.col("g.index").alias("device"),
        F.col("g.name").alias("name"),
        F.col("g.utilization_pct").alias("utilization_pct"),
        (F.col("g.memory_used_bytes") / MIB).alias("memory_used_mib"),
        (F.col("g.memory_total_bytes") / MIB).alias("memory_total_mib"),
        (F.col("g.power_mw") / 1000.0).alias("power_w"),
        (sensor("power_limit_mw") / 1000.0).alias("power_limit_w"),
        sensor("fan_speed_pct").alias("fan_speed_pct"),
        F.col("g.temperature_c").alias("temperature_c"),
        "cpu_pct",
        ((F.col("ram_total") - F.col("ram_available")) / GIB).alias("ram_used_gb"),
        (F.col("ram_total") / GIB).alias("ram_total_gb"),
        disk("disk_used"),
        disk("disk_total"),
    )


def latest_devices(devices: DataFrame) -> DataFrame:
    """Newest reading per (host, device).

    One ``max_by`` per sensor. A device's texts (its name) join the key
    first, so that all readings pass a hash aggregate of numbers, and the
    newest of a device's names, mostly one, is picked from what is left. A
    stream knows one aggregate only and takes all columns in it.
    """
    texts = [f.name for f in devices.schema if f.name not in ("host", "device", "ts") and isinstance(f.dataType, (StringType, BinaryType))]
    cols = [c for c in devices.columns if c not in ("host", "device", "ts")]

    def newest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in values])

    if texts and not devices.isStreaming:
        devices = newest(devices, ["host", "device", *texts], [c for c in cols if c not in texts])
    return newest(devices, ["host", "device"], cols)


def rollup(devices: DataFrame, every: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Per host/device/window averages and maxima."""
    d = devices.withWatermark("ts", watermark) if watermark else devices
    g = d.groupBy("host", "device", F.window("ts", every).alias("w"))
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("utilization_pct").alias("avg_utilization_pct"),
        F.max("utilization_pct").alias("max_utilization_pct"),
        F.avg("memory_used_mib").alias("avg_memory_used_mib"),
        F.max("memory_used_mib").alias("max_memory_used_mib"),
        F.avg("power_w").alias("avg_power_w"),
        F.max("temperature_c").alias("max_temperature_c"),
    ).select(
        "host",
        "device",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "n",
        "avg_utilization_pct",
        "max_utilization_pct",
        "avg_memory_used_mib",
        "max_memory_used_mib",
        "avg_power_w",
        "max_temperature_c",
    )

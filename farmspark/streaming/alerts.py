"""ST-3 threshold alerts (dormant in the reference; built as a batch /
stream transform).

A reading outside [min, max] of water level, temperature or TDS yields one
line each; the lines of a reading form one message.  A NULL reading or bound
raises no alert.  The thresholds are one configuration row (``LIMIT 1`` in
the reference); they enter the plan as literals, so there is no join at all.
The reference mails every worker in one message (``to: emails.join(', ')``);
here the recipient is a distribution-list parameter, so no group of all
workers is collected.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBJECT = "\U0001F6A8 Pond Condition Alert"
WARN = "⚠️"


@dataclass(frozen=True)
class Thresholds:
    min_water_level: float = 5.0
    max_water_level: float = 40.0
    min_temperature: float = 22.0
    max_temperature: float = 32.0
    min_tds: float = 10.0
    max_tds: float = 90.0


def thresholds_from_row(row) -> Thresholds:
    """Thresholds from the first row of a ``thresholds`` table (one row)."""
    return Thresholds(**{k: row[k] for k in asdict(Thresholds())})


def js_number(x: Column) -> Column:
    """Number text as a JS template prints it (20.0 → '20', 6.55 → '6.55')."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def threshold_alerts(readings: DataFrame, th: Thresholds = Thresholds(),
                     recipient: str = "workers@farm.example") -> DataFrame:
    """Outbox rows, one per reading with at least one value out of range."""

    def line(v: str, lo: float | None, hi: float | None, label: str) -> Column:
        x = F.col(v)
        lo_c, hi_c = F.lit(lo).cast("double"), F.lit(hi).cast("double")
        return F.when((x < lo_c) | (x > hi_c),
                      F.concat(F.lit(f"{WARN} {label} out of range: "), js_number(x)))

    msg = F.concat_ws("\n",
                      line("Water_Level", th.min_water_level, th.max_water_level, "Water level"),
                      line("WaterTemp", th.min_temperature, th.max_temperature, "Temperature"),
                      line("TDS", th.min_tds, th.max_tds, "TDS"))
    return (readings.select(F.col("Pond_ID"), msg.alias("_msg"))
            .where(F.col("_msg") != "")
            .select(F.lit("pond_alert").alias("kind"), F.col("Pond_ID").cast("long").alias("ref_id"),
                    F.lit(recipient).alias("recipient"), F.lit(SUBJECT).alias("subject"),
                    F.col("_msg").alias("body")))

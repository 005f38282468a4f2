"""A kept activity ledger: the append sink of the reports.

``append_period`` adds the ledger of one store and period to a stored table,
partitioned by store and period, with dynamic partition overwrite: running a
period again replaces its rows and leaves all others, and the old rows stay
until a run has succeeded.  Every run also writes one marker row into its
partition, so a period that has become empty replaces its old rows too; the
marker is not part of what ``kept_ledger`` reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ntz
from ..params import MATCH_ALL, LedgerParams
from ..sources import Catalog
from .ledger import LEDGER_COLUMNS, LEDGER_SCHEMA, activity_ledger

#: The partition a ledger row belongs to: store, first and last moment of the period as numbers (yyyymmddhhmmss).
PERIOD = T.StructType([T.StructField("LedgerStore", T.IntegerType()), T.StructField("PeriodStart", T.LongType()),
                       T.StructField("PeriodEnd", T.LongType())])
KEYS = [f.name for f in PERIOD.fields]


def moment(value) -> Column:
    return F.date_format(ntz(value), "yyyyMMddHHmmss").cast("bigint")


def write_period(rows: DataFrame, store: int, start, end, root: str) -> None:
    """Replace the rows of one store and period in the table at ``root``."""
    keys = [F.lit(store).cast("int").alias("LedgerStore"), moment(start).alias("PeriodStart"), moment(end).alias("PeriodEnd")]
    out = rows.select(*LEDGER_COLUMNS, F.lit(False).alias("Marker"), *keys)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]
    marker = rows.sparkSession.range(1).select(*none, F.lit(True).alias("Marker"), *keys)
    (out.unionByName(marker).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*KEYS).parquet(root))


def append_period(c: Catalog, p: LedgerParams, root: str, staged: bool | None = None) -> None:
    """Compute the ledger of the store and period and keep it in the table at ``root``."""
    if p.item_like != MATCH_ALL or p.order_code_like != MATCH_ALL:
        raise ValueError("a kept period holds all its items: search patterns belong to the reader")
    write_period(activity_ledger(c, p, staged=staged, apart=True), p.store, p.start, p.end, root)


def kept_ledger(spark: SparkSession, root: str) -> DataFrame:
    """All kept rows with their store and period; filters on these read only their partitions."""
    schema = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("Marker", T.BooleanType()), *PERIOD.fields])
    return spark.read.schema(schema).parquet(root).where(~F.col("Marker")).select(*KEYS, *LEDGER_COLUMNS)

"""Where the reports get their base tables from.

A ``Catalog`` maps domain table names (``Item``, ``InvoiceItem`` ...) to
DataFrames.  Two sources are provided:

* ``Catalog.derived(spark, sf_dir)`` — derive every domain table lazily from
  the driver's test tables (see ``domain.py``).  Nothing is computed until a
  report runs, and each table is built once per catalog so that repeated
  references share one plan node (Spark then reuses the exchange).
* ``Catalog.parquet(spark, root)`` — read domain tables that were written
  once with ``materialize`` (one Parquet folder per table).  Tables with the
  layout of ``layout.py`` are pruned to the partitions a report needs.

Operators only ever call ``catalog[name]``; they do not know which source
backs it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domain, layout

class Catalog:
    def __init__(self, spark: SparkSession, load: Callable[["Catalog", str], DataFrame]):
        self.spark = spark
        self._load = load
        self._frames: dict[str, DataFrame] = {}
        self._plain: dict[str, DataFrame] = {}
        self.root: str | None = None  # folder of the stored tables, if there is one

    def placed(self, name: str) -> DataFrame:
        """A table with the partition columns of the stored layout, where it has them."""
        if name not in self._frames:
            if name not in domain.BUILDERS:
                raise KeyError(f"unknown domain table {name!r}")
            self._frames[name] = self._load(self, name)
        return self._frames[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._plain:
            self._plain[name] = self.placed(name).drop(layout.STORE, layout.MONTH) if self.is_placed(name) else self.placed(name)
        return self._plain[name]

    def is_placed(self, name: str) -> bool:
        return layout.STORE in self.placed(name).columns

    def of_period(self, name: str, store: int | None, start=None, end=None) -> DataFrame:
        """Rows whose header may be of ``store`` and dated from ``start`` to
        ``end`` (``None``: any): the partitions of the stored layout that can
        hold such rows, else the whole table.  Headers still have to be
        filtered or joined.  Partition columns stay."""
        rows = self.placed(name)
        if self.is_placed(name):
            if store is not None:
                rows = rows.where(F.col(layout.STORE) == store)
            rows = rows.where(layout.months_between(start, end))
        return rows

    def of_headers(self, name: str, headers: DataFrame) -> DataFrame:
        """Rows that may belong to ``headers``, which were read with their
        partition columns: those of the headers' partitions, else the whole
        table."""
        rows = self.placed(name)
        if self.is_placed(name) and layout.STORE in headers.columns:
            return layout.within(rows, headers).drop(layout.STORE, layout.MONTH)
        return self[name]

    def partition_columns(self, *names: str) -> list[str]:
        """The partition columns, if all these tables have them."""
        return [layout.STORE, layout.MONTH] if all(map(self.is_placed, names)) else []

    def refresh(self) -> None:
        """Forget the tables read so far: stored ones have changed."""
        self._frames.clear()
        self._plain.clear()

    def names(self) -> tuple[str, ...]:
        return domain.DOMAIN_TABLES

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every domain table as a temporary view (``Item``,
        ``InvoiceItem``, ``Vendor``, ``ItemGroup`` ...) so reports can also be
        written in Spark SQL against the same lazy tables.  Returns the view
        names.  Nothing is computed."""
        views = []
        for name in self.names():
            view = f"{prefix}{name}"
            self[name].createOrReplaceTempView(view)
            views.append(view)
        return views

    @classmethod
    def derived(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        raw = domain.RawTables(spark, sf_dir)

        def load(cat: "Catalog", name: str) -> DataFrame:
            return domain.BUILDERS[name](raw, cat.__getitem__, spark)

        return cls(spark, load)

    @classmethod
    def frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Catalog":
        """Catalog over given DataFrames (tables already registered elsewhere,
        or small hand-made tables in tests)."""
        return cls(spark, lambda cat, name: frames[name])

    @classmethod
    def parquet(cls, spark: SparkSession, root: str) -> "Catalog":
        def load(cat: "Catalog", name: str) -> DataFrame:
            return layout.stored(spark, root, name)

        catalog = cls(spark, load)
        catalog.root = root
        return catalog

    @classmethod
    def over(cls, base: "Catalog", root: str, names: Sequence[str]) -> "Catalog":
        """The stored tables ``names`` (and their headers) at ``root``, all others from ``base``."""
        stored = set(layout.with_parents(names))

        def load(cat: "Catalog", name: str) -> DataFrame:
            return layout.stored(base.spark, root, name) if name in stored else base.placed(name)

        catalog = cls(base.spark, load)
        catalog.root = root
        return catalog


def materialize(catalog: Catalog, root: str | None = None, mode: str = "overwrite", names: Sequence[str] | None = None,
                by_year: bool = False) -> str:
    """Write every domain table (or those of ``names`` and the headers they
    hang on) once as Parquet and return the folder.

    ``root`` defaults to a new folder under the session's
    ``spark.checkpoint.dir`` (the cluster's shared folder; tests get a local
    one).  Headers and lines are partitioned by store and month and clustered
    (``layout.py``).  Read back with ``Catalog.parquet(spark, root)``; the
    written tables also cut the lineage of the derivation."""
    if root is None:
        from ..session import shared_folder
        root = os.path.join(shared_folder(catalog.spark), f"larder-domain-{uuid.uuid4().hex[:12]}")
    layout.write(catalog, catalog.names() if names is None else layout.with_parents(names), root, mode, by_year)
    return root

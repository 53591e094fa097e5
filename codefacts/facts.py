"""The set of fact tables an operator reads.

Every table is keyed by the symbol identity string (``usr``) and, for link
facts, by the unique target name. Keying on the identity instead of on
surrogate row numbers saves the id lookups on both ends of every edge and lets
tables be produced independently of each other; dense ids are attached only
when a snapshot is published.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "targets",
    "target_sources",
    "blobs",
    "sources",
    "external_sources",
    "generated_sources",
    "symbols",
    "symbol_names",
    "symbol_definitions",
    "types",
    "type_fields",
    "enum_constants",
    "call_edges",
    "indirect_call_sites",
    "inline_decisions",
    "inline_records",
    "inline_instances",
    "icf_groups",
    "icf_group_members",
    "link_resolutions",
    "link_losers",
    "object_defs",
    "symbol_tokens",
    "type_tokens",
    "blob_lines",
    "blob_trigrams",
    "blob_blocks",
    "meta",
)


class Facts:
    """Lazily built fact tables, reached as attributes (``facts.symbols``)."""

    def __init__(
        self,
        spark: SparkSession,
        builders: Mapping[str, Callable[[], DataFrame]],
        copies: Mapping[tuple[str, str], Callable[[], DataFrame]] | None = None,
    ):
        unknown = (set(builders) | {table for table, _ in copies or ()}) - set(TABLES)
        if unknown:
            raise ValueError(f"not fact tables: {sorted(unknown)}")
        self.spark = spark
        self._builders = dict(builders)
        self._copies = dict(copies or {})
        self._built: dict[str | tuple[str, str], DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, tables: Mapping[str, DataFrame]) -> "Facts":
        return cls(spark, {name: (lambda df=df: df) for name, df in tables.items()})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def by(self, name: str, column: str) -> DataFrame:
        """The table for a lookup by ``column``: its copy sorted by that column where one is stored."""
        key = (name, column)
        if key not in self._copies:
            return getattr(self, name)
        if key not in self._built:
            self._built[key] = self._copies[key]()
        return self._built[key]

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    @property
    def names(self) -> list[str]:
        return [name for name in TABLES if name in self._builders]

    @property
    def symbol_reachability(self) -> DataFrame:
        """Derived: a symbol is reachable in a target iff the link kept it there."""
        return self.link_resolutions.join(
            self.symbols.select("usr"), "usr", "inner"
        ).select(
            "target", "usr", F.lit(1).alias("reachable"), F.lit(1).alias("section_kept")
        )

    def register_views(self, names: Iterable[str] | None = None, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temporary views."""
        for name in names if names is not None else self.names:
            getattr(self, name).createOrReplaceTempView(prefix + name)
        if names is None and {"symbols", "link_resolutions"} <= set(self._builders):
            self.symbol_reachability.createOrReplaceTempView(prefix + "symbol_reachability")

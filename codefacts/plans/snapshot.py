"""Published fact tables: write once, switch a pointer, read immutable versions."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts import schemas
from codefacts.facts import TABLES, Facts
from codefacts.functions import text
from codefacts.operators import link_ingest, text_index
from codefacts.operators.ids import assign_ids
from codefacts.session import cut_lineage

POINTER = "CURRENT"
#: A reader's lease on a version is a file of this prefix, followed by the version and a name of its own.
LEASE = ".lease-"
#: Versions and leases younger than this many seconds are never removed: a publication or an opening may be under way.
GRACE_SECONDS = 3600.0
# Derived when read, never stored: one row per target and losing object would
# repeat every candidate list once per target.
VIEWS = ("link_losers",)
# Written by the publication itself.
DERIVED = ("meta", "blob_lines", "blob_trigrams", "blob_blocks")
# How each table is laid out. Row groups and pages of a sorted table carry narrow
# ranges, so a lookup by its first key reads little of it. The keys after the
# first part the rows of one hot key between files.
SORT_KEYS = {
    "symbols": ["usr"],
    "symbol_names": ["linkage_name", "usr"],
    "symbol_definitions": ["usr", "file", "line"],
    "symbol_tokens": ["token", "usr"],
    "type_tokens": ["token", "usr"],
    "types": ["usr"],
    "type_fields": ["type_usr", "ordinal"],
    "enum_constants": ["type_usr", "value"],
    "call_edges": ["caller_usr", "callee_usr"],
    "indirect_call_sites": ["caller_usr", "site_id"],
    "inline_decisions": ["caller_usr", "callee_usr"],
    "inline_records": ["caller_usr", "callee_usr"],
    "inline_instances": ["caller_usr", "callee_usr"],
    "icf_group_members": ["winner_usr", "loser_usr"],
    "link_resolutions": ["usr", "target"],
    "object_defs": ["name", "object"],
    "target_sources": ["target", "file"],
    "sources": ["path"],
    "external_sources": ["abs_path"],
    "generated_sources": ["builddir_rel"],
    "blobs": ["hash"],
}
# Second copies of tables that are also looked up by another column.
COPIES = {
    "symbols": [["name", "usr"]],
    "symbol_names": [["usr", "linkage_name"]],
    "types": [["name", "usr"]],
    "call_edges": [["callee_usr", "caller_usr"]],
    "indirect_call_sites": [["callee_type", "site_id"], ["site_id"]],
    "inline_decisions": [["callee_usr", "caller_usr"]],
    "inline_records": [["callee_usr", "caller_usr"]],
    "inline_instances": [["callee_usr", "caller_usr"]],
    "link_resolutions": [["target", "usr"]],
    "target_sources": [["file", "target"]],
}
# Contents are long and are asked for one by one, so their pages are small.
PAGE_ROWS = {"blobs": 32}
#: Rows sampled for each range of a sorted table, all of whose keys go to the driver. A publication sorts some forty
#: tables and copies; ranges come out within a few tens of percent of each other.
SAMPLED_ROWS = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "20"}
# Every query names its plane, so the planes are separate directories.
DIRECTORIES = {"call_edges": "source"}


def copy_name(table: str, column: str) -> str:
    return f"{table}.by_{column}"


class SnapshotError(Exception):
    """A snapshot cannot be opened or published."""


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm, hadoop_path


def diagnose(spark: SparkSession, path: str) -> str | None:
    """What keeps ``path`` from being a snapshot; None when nothing does."""
    fs, jvm, p = _filesystem(spark, path)
    if not fs.exists(p):
        return f"{path} does not exist"
    if not fs.getFileStatus(p).isDirectory():
        return f"{path} is a file, not a snapshot directory"
    if not fs.listStatus(p):
        return f"{path} is empty: nothing was published there"
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path, POINTER)):
        return f"{path} has no {POINTER} file: a publication did not finish"
    return None


def current_version(spark: SparkSession, path: str) -> str:
    problem = diagnose(spark, path)
    if problem:
        raise SnapshotError(problem)
    return spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()[0].strip()


def _write_pointer(spark: SparkSession, path: str, version: str) -> None:
    fs, jvm, _ = _filesystem(spark, path)
    scratch = jvm.org.apache.hadoop.fs.Path(path, f".{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(scratch, True)
    stream.write(bytearray(version.encode("utf-8")))
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(scratch), fs.makeQualified(final), overwrite)


def _with_ids(facts: Facts) -> dict[str, DataFrame]:
    """Tables with dense surrogate ids next to the natural keys."""
    tables = {name: getattr(facts, name) for name in facts.names if name not in VIEWS}
    symbols = assign_ids(facts.symbols, ["usr"])
    targets = assign_ids(facts.targets, ["name"])
    types = assign_ids(facts.types, ["usr"])
    symbol_ids = symbols.select("id", "usr")
    target_ids = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    type_ids = types.select(F.col("id").alias("type_id"), F.col("usr").alias("type_usr"))

    def symbol(df: DataFrame, usr: str, out: str) -> DataFrame:
        ids = symbol_ids.select(F.col("id").alias(out), F.col("usr").alias(usr))
        return df.join(ids, usr, "left")

    tables.update(symbols=symbols, targets=targets, types=types)
    for name, ends in {
        "symbol_definitions": {"usr": "symbol_id"},
        "call_edges": {"caller_usr": "caller_id", "callee_usr": "callee_id"},
        "indirect_call_sites": {"caller_usr": "caller_id"},
        "inline_decisions": {"caller_usr": "caller_id", "callee_usr": "callee_id"},
        "inline_records": {"caller_usr": "caller_id", "callee_usr": "callee_id"},
        "inline_instances": {
            "caller_usr": "caller_id", "callee_usr": "callee_id", "parent_callee_usr": "parent_callee_id",
        },
        "icf_groups": {"winner_usr": "winner_symbol_id"},
        "icf_group_members": {"loser_usr": "symbol_id"},
    }.items():
        for usr, out in ends.items():
            tables[name] = symbol(tables[name], usr, out)
    groups = assign_ids(tables["icf_groups"], ["winner_usr", "object_file"], "id")
    group_ids = groups.select(F.col("id").alias("group_id"), "winner_usr", "object_file")
    tables["icf_groups"] = groups
    tables["icf_group_members"] = tables["icf_group_members"].join(
        group_ids, ["winner_usr", "object_file"], "left"
    )
    for name in ("target_sources", "call_edges", "link_resolutions"):
        tables[name] = tables[name].join(target_ids, "target", "left")
    for name in ("type_fields", "enum_constants"):
        tables[name] = tables[name].join(type_ids, "type_usr", "left")
    return tables


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings that hold inside and are put back behind."""
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _write_sorted(
    df: DataFrame, path: str, keys: list[str], directory: str | None = None, row_group_bytes: int | None = None, page_rows: int | None = None
) -> None:
    if keys:
        df = df.repartitionByRange(*keys)
        df = df.sortWithinPartitions(*([directory] if directory else []), *keys)
    writer = df.write.option("compression", "zstd").mode("errorifexists")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if page_rows:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    if directory:
        writer = writer.partitionBy(directory)
    writer.parquet(path)


def _write_text_index(blobs: DataFrame, base: str, row_group_bytes: int | None) -> None:
    """Line offsets, trigram postings and block places of the stored blobs, whose order the blocks follow."""
    spark, mixed = blobs.sparkSession, f"{base}/.mixed"
    _write_sorted(text_index.blob_lines(blobs), f"{base}/blob_lines", [], None, row_group_bytes)
    text_index.index_blobs(blobs).write.option("compression", "zstd").parquet(mixed)
    found = spark.read.schema(text_index.MIXED).parquet(mixed)
    postings = found.filter("trigram IS NOT NULL").select("trigram", "block", "members")
    _write_sorted(postings, f"{base}/blob_trigrams", ["trigram", "block"], None, row_group_bytes)
    places = found.filter("hash IS NOT NULL").select("block", "slot", "hash")
    _write_sorted(places, f"{base}/blob_blocks", ["block", "slot"], None, row_group_bytes)
    fs, _, path = _filesystem(spark, mixed)
    fs.delete(path, True)


def publish(
    facts: Facts,
    path: str,
    replace: bool = False,
    properties: dict[str, str] | None = None,
    row_group_bytes: int | None = None,
) -> str:
    """Write every table and its copies beside earlier versions, then switch the pointer in one rename.

    Readers see the old version or the new one. A failure before the switch
    leaves what was published before. ``row_group_bytes`` sets how finely a
    lookup can skip; by default Parquet's own size.
    """
    spark = facts.spark
    fs, jvm, root = _filesystem(spark, path)
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path, POINTER)) and not replace:
        raise SnapshotError(f"{path} already holds a snapshot; pass replace=True to supersede it")
    fs.mkdirs(root)
    version = f"v-{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    base = f"{path.rstrip('/')}/{version}"
    with _settings(spark, SAMPLED_ROWS):
        for name, df in _with_ids(facts).items():
            if name in DERIVED:
                continue
            directory = DIRECTORIES.get(name)
            _write_sorted(df, f"{base}/{name}", SORT_KEYS.get(name, []), directory, row_group_bytes, PAGE_ROWS.get(name))
            if name == "blobs":
                _write_text_index(spark.read.schema(df.schema).parquet(f"{base}/{name}"), base, row_group_bytes)
            if name in COPIES:
                # what was written is sorted again: no fact is resolved twice
                stored = spark.read.schema(df.schema).parquet(f"{base}/{name}")
                for keys in COPIES[name]:
                    _write_sorted(stored, f"{base}/{copy_name(name, keys[0])}", keys, directory, row_group_bytes)
    stamp = datetime.now(timezone.utc).isoformat()
    rows = {"schema_version": schemas.SCHEMA_VERSION, "indexed_at": stamp, **(properties or {})}
    spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1).write.mode(
        "errorifexists"
    ).parquet(f"{base}/meta")
    _write_pointer(spark, path, version)
    return version


def token_tables(symbols: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search token rows of symbols (name, signature) and types (name, underlying)."""
    return (
        symbols.select(F.explode(text.tokens(F.col("name"), F.col("signature"))).alias("token"), "usr"),
        types.select(F.explode(text.tokens(F.col("name"), F.col("underlying"))).alias("token"), "usr"),
    )


@dataclass(frozen=True)
class Snapshot:
    """One immutable published version."""

    path: str
    version: str
    facts: Facts
    properties: dict[str, str]
    lease: str = ""

    def close(self) -> None:
        """Give the version back; questions asked before may still run until ``vacuum`` removes it."""
        if self.lease:
            fs, _, lease = _filesystem(self.facts.spark, self.lease)
            fs.delete(lease, False)

    def counts(self) -> dict[str, int]:
        return {
            name: getattr(self.facts, name).count()
            for name in ("symbols", "call_edges", "targets", "sources", "types")
            if name in self.facts
        }


def _take_lease(spark: SparkSession, path: str) -> tuple[str, str]:
    """The current version and a lease on it, taken before the version is looked at again."""
    while True:
        version = current_version(spark, path)
        lease = f"{path.rstrip('/')}/{LEASE}{version}.{uuid.uuid4().hex}"
        fs, _, file = _filesystem(spark, lease)
        fs.create(file, True).close()
        if current_version(spark, path) == version:
            return version, lease
        fs.delete(file, False)


def vacuum(spark: SparkSession, path: str, grace: float = GRACE_SECONDS, lease_seconds: float | None = None) -> list[str]:
    """Remove versions that are neither current nor leased, also those whose publication failed; returns their names.

    What is younger than ``grace`` seconds stays. A lease whose reader was lost
    counts until it is ``lease_seconds`` old, if that is given.
    """
    current = current_version(spark, path)
    fs, jvm, root = _filesystem(spark, path)
    now = datetime.now(timezone.utc).timestamp() * 1000
    held, removed = {current}, []
    entries = list(fs.listStatus(root))
    for entry in entries:
        name = entry.getPath().getName()
        if name.startswith(LEASE):
            if lease_seconds is not None and now - entry.getModificationTime() > 1000 * lease_seconds:
                fs.delete(entry.getPath(), False)
            else:
                held.add(name.removeprefix(LEASE).rpartition(".")[0])
    for entry in entries:
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in held and now - entry.getModificationTime() > 1000 * grace:
            fs.delete(entry.getPath(), True)
            removed.append(name)
    return sorted(removed)


def open_snapshot(spark: SparkSession, path: str, leased: bool = False) -> Snapshot:
    """Open the current version in a session of its own; refuse another schema version.

    A leased version is kept by ``vacuum`` until the snapshot is closed.
    """
    version, lease = _take_lease(spark, path) if leased else (current_version(spark, path), "")
    base = f"{path.rstrip('/')}/{version}"
    session = spark.newSession()
    meta = session.read.parquet(f"{base}/meta")
    properties = {r["key"]: r["value"] for r in meta.collect()}
    found = properties.get("schema_version")
    if found != schemas.SCHEMA_VERSION:
        raise SnapshotError(
            f"{path} has schema version {found}, this library reads {schemas.SCHEMA_VERSION}: collect again"
        )
    fs, jvm, _ = _filesystem(spark, base)
    stored = [
        n for n in TABLES if n not in VIEWS and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}"))
    ]
    builders = {n: (lambda n=n: session.read.parquet(f"{base}/{n}")) for n in stored}
    # Snapshots written without copies answer from the tables themselves.
    copies = {
        (n, keys[0]): (lambda p=f"{base}/{copy_name(n, keys[0])}": session.read.parquet(p))
        for n in stored
        for keys in COPIES.get(n, [])
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{copy_name(n, keys[0])}"))
    }
    facts = Facts(session, builders, copies)
    if "object_defs" in facts:
        losers = lambda: link_ingest.losers_view(facts.link_resolutions, facts.object_defs)
        facts = Facts(session, {**builders, "link_losers": losers}, copies)
    return Snapshot(path, version, facts, properties, lease)


class Catalog:
    """The snapshot in use, swappable while queries run on the one they started with."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path
        self._lock = threading.Lock()
        self._snapshot = open_snapshot(spark, path, leased=True)
        self._retired: Snapshot | None = None

    @property
    def snapshot(self) -> Snapshot:
        return self._snapshot

    def reload(self) -> dict:
        """Open the current version and swap it in; on any failure the old one stays."""
        with self._lock:
            old = self._snapshot
            fresh = open_snapshot(self._spark, self._path, leased=True)
            self._snapshot = fresh
            # questions under way keep the version before; the one before that is given back
            if self._retired:
                self._retired.close()
            self._retired = old
        return {
            "path": self._path,
            "previous_version": old.version,
            "version": fresh.version,
            "changed": old.version != fresh.version,
            "counts": fresh.counts(),
        }

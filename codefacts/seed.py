"""Index-shaped facts derived from the star-schema test tables.

``part`` and ``supplier`` become symbols, ``nation`` becomes link targets,
``lineitem`` becomes the relations between them (its line number tells which
kind of record a row is), ``events`` become indirect call sites and the text
tables become sources. Every line number stands for some kind of record; filters
beyond that are part of what a record means (a body, a linked target).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.facts import Facts
from codefacts.functions import identity, paths, text
from codefacts.operators import link_ingest

N_TARGETS = 25
TYPES_HEADER = "include/types.h"


def brand_tag(brand: Column) -> Column:
    return F.lower(F.replace(brand, F.lit("#"), F.lit("_")))


def source_path(doc_id: Column, source: Column, lang: Column) -> Column:
    ext = (
        F.when(doc_id % 3 == 0, F.lit(".c")).when(doc_id % 3 == 1, F.lit(".h")).otherwise(F.lit(".txt"))
    )
    return F.concat(source, F.lit("/"), lang, F.lit("/doc_"), doc_id.cast("string"), ext)


class Seed:
    """Builds the fact tables of one test-data directory, lazily and once each."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @cache
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- raw mappings ------------------------------------------------------

    @cache
    def n_parts(self) -> Column:
        return self.table("part").agg(F.count(F.lit(1)).alias("n")).scalar()

    @cache
    def part_symbols(self) -> DataFrame:
        p = self.table("part")
        linkage = (
            F.when(F.col("p_size") % 4 == 0, "internal")
            .when(F.col("p_size") % 4 == 3, "weak")
            .otherwise("external")
        )
        name = F.concat(
            F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")
        )
        signature = (
            F.when(F.col("p_type") == "SMALL", "int (int, int)")
            .when(F.col("p_type") == "ECONOMY", "void (void)")
            .otherwise(F.concat(F.lit("int ("), F.lower("p_type"), F.lit(" *)")))
        )
        path = F.concat(F.lit("src/"), brand_tag(F.col("p_brand")), F.lit(".c"))
        return p.select(
            F.col("p_partkey").alias("pk"),
            F.col("p_size").alias("size"),
            F.col("p_name").alias("body"),
            F.col("p_brand").alias("brand"),
            name.alias("name"),
            F.lit("function").alias("kind"),
            linkage.alias("linkage"),
            signature.alias("signature"),
            (F.col("p_partkey") % 7 == 0).alias("address_taken"),
            F.when(linkage == "internal", path).otherwise(F.lit("")).alias("path"),
        ).withColumn("usr", identity.symbol_usr(F.col("kind"), F.col("path"), F.col("name")))

    @cache
    def target_keys(self) -> DataFrame:
        n = self.table("nation")
        kind = (
            F.when(F.col("n_regionkey") % 3 == 0, "executable")
            .when(F.col("n_regionkey") % 3 == 1, "shared_library")
            .otherwise("static_library")
        )
        return n.select(
            F.col("n_nationkey").cast("long").alias("nk"),
            F.col("n_name").alias("target"),
            kind.alias("kind"),
        )

    def _usr_of(self, df: DataFrame, key: str, out: str, keep: tuple[str, ...] = ()) -> DataFrame:
        names = self.part_symbols().select(
            F.col("pk").alias(key), F.col("usr").alias(out), *[F.col(k) for k in keep]
        )
        return df.join(names, key, "inner").drop(key)

    # -- fact tables -------------------------------------------------------

    @cache
    def targets(self) -> DataFrame:
        return self.target_keys().select(
            F.col("target").alias("name"),
            "kind",
            F.concat(F.lit("cc -o "), F.col("target")).alias("link_command"),
        )

    @cache
    def symbols(self) -> DataFrame:
        functions = self.part_symbols().select(
            "usr", "name", "kind", "linkage", "signature", "address_taken"
        )
        supplier_name = F.col("s_name")
        variables = self.table("supplier").select(
            identity.symbol_usr(F.lit("variable"), F.lit(""), supplier_name).alias("usr"),
            supplier_name.alias("name"),
            F.lit("variable").alias("kind"),
            F.lit("external").alias("linkage"),
            F.lit("").alias("signature"),
            F.lit(False).alias("address_taken"),
        )
        return functions.unionByName(variables)

    @cache
    def symbol_names(self) -> DataFrame:
        plain = self.symbols().select("usr", F.col("name").alias("linkage_name"))
        clones = (
            self.part_symbols()
            .filter(F.col("size") > 40)
            .select("usr", F.concat("name", F.lit(".constprop.0")).alias("linkage_name"))
        )
        return plain.unionByName(clones)

    @cache
    def doc_paths(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id"), source_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path")
        )

    @cache
    def symbol_definitions(self) -> DataFrame:
        rows = (
            self.table("lineitem")
            .filter(F.col("l_linenumber").isin(6, 7))
            .select(
                F.col("l_partkey").alias("pk"),
                F.col("l_suppkey").alias("doc_id"),
                F.floor("l_quantity").cast("int").alias("line"),
                (F.col("l_returnflag") == "R").alias("is_weak"),
                F.when(
                    F.col("l_returnflag") == "N",
                    F.concat(
                        F.lit("/usr/include/bench_"),
                        (F.col("l_suppkey") % 40).cast("string"),
                        F.lit(".h"),
                    ),
                )
                .otherwise(F.lit(""))
                .alias("decl_file"),
                F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))
                .otherwise(F.lit(0))
                .alias("decl_line"),
            )
        )
        bodies = self.part_symbols().filter(F.col("size") > 10).select("pk", "usr", "name")
        return (
            rows.join(bodies, "pk")
            .join(self.doc_paths(), "doc_id")
            .select(
                "usr",
                F.col("path").alias("file"),
                "line",
                "decl_file",
                "decl_line",
                "is_weak",
                F.col("name").alias("linkage_name"),
            )
            .distinct()
        )

    @cache
    def edge_pairs(self) -> DataFrame:
        rows = (
            self.table("lineitem")
            .filter(F.col("l_linenumber") == 1)
            .select(
                F.col("l_partkey").alias("caller_pk"),
                ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % self.n_parts()).alias("callee_pk"),
                F.col("l_linestatus").alias("status"),
                (F.col("l_orderkey") % N_TARGETS).alias("nk"),
            )
        )
        return self._usr_of(self._usr_of(rows, "caller_pk", "caller_usr"), "callee_pk", "callee_usr")

    @cache
    def cgraph_edges(self) -> DataFrame:
        return (
            self.edge_pairs()
            .select(
                "caller_usr",
                "callee_usr",
                F.lit("compiler_cgraph").alias("source"),
                F.lit(None).cast("string").alias("target"),
            )
            .distinct()
        )

    @cache
    def linked_edges(self) -> DataFrame:
        linked = self.target_keys().filter(F.col("kind") != "static_library").select("nk", "target")
        return (
            self.edge_pairs()
            .filter(F.col("status") == "O")
            .join(linked, "nk")
            .select("caller_usr", "callee_usr", F.lit("objdump").alias("source"), "target")
            .distinct()
        )

    @cache
    def call_edges(self) -> DataFrame:
        return self.cgraph_edges().unionByName(self.linked_edges())

    @cache
    def object_candidates(self) -> DataFrame:
        """Objects that define a symbol linked into a target, with the nm kind seen there."""
        unit = F.concat(F.lit("u_"), (F.col("l_orderkey") % 17).cast("string"), F.lit(".c.o"))
        kind = (
            F.when(F.col("l_returnflag") == "A", "T").when(F.col("l_returnflag") == "N", "W").otherwise("C")
        )
        rows = (
            self.table("lineitem")
            .filter(F.col("l_linenumber").isin(2, 3))
            .select(
                F.col("l_partkey").alias("pk"),
                (F.col("l_orderkey") % N_TARGETS).alias("nk"),
                F.when(F.col("l_orderkey") % 17 < 5, F.concat(F.lit("lib/libshared.a.p/"), unit))
                .otherwise(F.concat(F.lit("app/app.p/"), unit))
                .alias("object"),
                kind.alias("nm_kind"),
            )
        )
        public = (
            self.part_symbols().filter(F.col("linkage") != "internal").select("pk", "usr", "name")
        )
        linked = self.target_keys().filter(F.col("kind") != "static_library").select("nk", "target")
        return (
            rows.join(public, "pk").join(linked, "nk").select("target", "usr", "name", "object", "nm_kind")
        ).distinct()

    @cache
    def link_resolutions(self) -> DataFrame:
        return link_ingest.pick_winners(self.object_candidates(), ["target", "usr"]).select(
            "target",
            "usr",
            F.col("object").alias("winning_object"),
            link_ingest.linkage_kind(F.col("nm_kind")).alias("linkage_kind"),
            paths.archive_of(F.col("object")).alias("archive"),
        )

    @cache
    def link_losers(self) -> DataFrame:
        return link_ingest.collect_losers(
            self.object_candidates(), self.link_resolutions(), ["target", "usr"]
        )

    @cache
    def inline_rows(self) -> DataFrame:
        rows = (
            self.table("lineitem")
            .filter(F.col("l_linenumber").isin(4, 5))
            .select(
                F.col("l_partkey").alias("caller_pk"),
                ((F.col("l_partkey") * 31 + F.col("l_suppkey") % 4) % self.n_parts()).alias("callee_pk"),
                ((F.col("l_partkey") * 17 + 3) % self.n_parts()).alias("parent_pk"),
                F.when(F.col("l_linestatus") == "O", "einline").otherwise("inline").alias("pass"),
                F.col("l_returnflag").alias("flag"),
                F.floor("l_quantity").cast("int").alias("line"),
                F.col("l_linenumber").cast("int").alias("column"),
                F.col("l_suppkey").alias("doc_id"),
                F.concat(F.lit("obj/u_"), (F.col("l_orderkey") % 5).cast("string"), F.lit(".c.o")).alias(
                    "object"
                ),
                (F.col("l_orderkey") % 3 + 1).cast("int").alias("depth"),
            )
        )
        named = self._usr_of(self._usr_of(rows, "caller_pk", "caller_usr"), "callee_pk", "callee_usr")
        return named.join(self.doc_paths().withColumnRenamed("path", "file"), "doc_id")

    @cache
    def inline_records(self) -> DataFrame:
        reason = (
            F.when(F.col("flag") == "R", "call is unlikely and code size would grow")
            .when(F.col("flag") == "N", "function body not available")
            .otherwise("")
        )
        return self.inline_rows().select(
            "caller_usr",
            "callee_usr",
            "pass",
            (F.col("flag") == "A").alias("inlined"),
            reason.alias("reason"),
            "file",
            "line",
            "column",
            "object",
        )

    @cache
    def inline_decisions(self) -> DataFrame:
        return (
            self.inline_records()
            .filter(F.col("pass") == "inline")
            .groupBy("caller_usr", "callee_usr")
            .agg(F.bool_or("inlined").alias("inlined"))
        )

    @cache
    def inline_instances(self) -> DataFrame:
        bodies = self.inline_rows().filter(
            (F.col("flag") == "A") & (F.col("pass") == "einline") & (F.col("line") < 25)
        )
        named = self._usr_of(bodies, "parent_pk", "parent_usr")
        return named.select(
            "callee_usr",
            "caller_usr",
            F.when(F.col("depth") > 1, F.col("parent_usr")).alias("parent_callee_usr"),
            "depth",
            "file",
            "line",
            "column",
            "object",
        )

    @cache
    def indirect_call_sites(self) -> DataFrame:
        # The function type each kind of event stands for.
        callee_type = F.create_map(
            *[
                F.lit(x)
                for pair in {
                    "click": "int (int, int)",
                    "view": "void (void)",
                    "purchase": "int (promo *)",
                    "signup": "int (large *)",
                    "error": "",
                }.items()
                for x in pair
            ]
        )
        rows = self.table("events").select(
            F.col("event_id").alias("site_id"),
            (F.col("user_id") % self.n_parts()).alias("caller_pk"),
            F.concat(F.lit("src/user_"), F.col("user_id").cast("string"), F.lit(".c")).alias("file"),
            F.floor("value").cast("int").alias("line"),
            F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("column"),
            callee_type[F.col("event_type")].alias("callee_type"),
            F.when(F.col("event_type") == "error", "")
            .otherwise(F.concat(F.lit("ops."), F.col("event_type")))
            .alias("field_hint"),
        )
        return self._usr_of(rows, "caller_pk", "caller_usr")

    @cache
    def icf_groups(self) -> DataFrame:
        public = self.part_symbols().filter(F.col("linkage") != "internal")
        return (
            public.groupBy("body", "brand")
            .agg(
                F.min("usr").alias("winner_usr"),
                F.min("pk").alias("first_pk"),
                F.count(F.lit(1)).alias("n"),
            )
            .filter(F.col("n") > 1)
            .select(
                "body",
                "brand",
                "winner_usr",
                F.concat(F.lit("obj/u_"), (F.col("first_pk") % 17).cast("string"), F.lit(".c.o")).alias(
                    "object_file"
                ),
            )
        )

    @cache
    def icf_group_members(self) -> DataFrame:
        public = self.part_symbols().filter(F.col("linkage") != "internal")
        return (
            public.join(self.icf_groups(), ["body", "brand"])
            .filter(F.col("usr") != F.col("winner_usr"))
            .select("winner_usr", "object_file", F.col("usr").alias("loser_usr"))
        )

    @cache
    def sources(self) -> DataFrame:
        return self.table("documents").select(
            source_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"),
            F.sha2(F.col("text").cast("binary"), 256).alias("blob_hash"),
            (F.col("doc_id") % 11 == 0).alias("is_generated"),
        )

    @cache
    def external_sources(self) -> DataFrame:
        return self.table("benchmark").select(
            F.concat(F.lit("/usr/include/bench_"), F.col("item_id").cast("string"), F.lit(".h")).alias(
                "abs_path"
            ),
            F.sha2(F.col("text").cast("binary"), 256).alias("blob_hash"),
        )

    @cache
    def generated_sources(self) -> DataFrame:
        return self.table("pages").select(
            F.concat(F.lit("gen/page_"), F.col("page_id").cast("string"), F.lit(".h")).alias(
                "builddir_rel"
            ),
            F.sha2(F.col("html").cast("binary"), 256).alias("blob_hash"),
        )

    @cache
    def blobs(self) -> DataFrame:
        contents = (
            self.table("documents")
            .select(F.col("text").alias("content"))
            .unionByName(self.table("benchmark").select(F.col("text").alias("content")))
            .unionByName(self.table("pages").select(F.col("html").alias("content")))
        )
        from codefacts.operators.source_ingest import dedup_blobs

        return dedup_blobs(contents.select(F.col("content").cast("binary").alias("content")))

    @cache
    def target_sources(self) -> DataFrame:
        docs = self.table("documents").select(
            (F.col("doc_id") % N_TARGETS).alias("nk"),
            source_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("file"),
        )
        return (
            docs.filter(F.col("file").endswith(".c"))
            .join(self.target_keys(), "nk")
            .select("target", "file")
        )

    @cache
    def live_files(self) -> DataFrame:
        """The tree as it looks later: some files gone, some edited."""
        edited = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("\n// edited\n"))).otherwise(
            F.col("text")
        )
        return (
            self.table("documents")
            .filter(F.col("doc_id") % 17 != 0)
            .select(
                source_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("path"),
                edited.cast("binary").alias("content"),
            )
        )

    @cache
    def type_fields(self) -> DataFrame:
        fields = self.table("part").select("p_brand", "p_name").distinct()
        # A record's field list is bounded by its declaration, so numbering
        # the fields of one record is a small window.
        order = Window.partitionBy("p_brand").orderBy("p_name")
        ordinal = F.row_number().over(order) - 1
        return fields.select(
            F.concat(F.lit(f"c:{TYPES_HEADER}@S@"), brand_tag(F.col("p_brand"))).alias("type_usr"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
            F.when(F.col("p_name").endswith("gear"), "int (*)(int, int)").otherwise("int").alias("type"),
            ordinal.cast("int").alias("ordinal"),
            (ordinal * 8).cast("int").alias("byte_offset"),
        )

    @cache
    def enum_constants(self) -> DataFrame:
        kinds = self.table("events").select("event_type").distinct()
        # The constants of one enum are bounded by its declaration.
        value = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type"))
        enum_usr = F.lit(f"c:{TYPES_HEADER}@E@event_type")
        return kinds.select(
            identity.enum_member_usr(enum_usr, F.upper("event_type")).alias("usr"),
            enum_usr.alias("type_usr"),
            F.upper("event_type").alias("name"),
            value.cast("long").alias("value"),
        )

    @cache
    def types(self) -> DataFrame:
        part = self.table("part")
        header = F.lit(TYPES_HEADER)
        typedefs = part.select(F.lower("p_type").alias("name")).distinct().select(
            F.concat(F.lit(f"c:{TYPES_HEADER}@T@"), F.col("name")).alias("usr"),
            "name",
            F.lit("typedef").alias("kind"),
            header.alias("decl_file"),
            F.length("name").cast("int").alias("decl_line"),
            F.lit(None).cast("int").alias("byte_size"),
            F.when(F.col("name") == "small", "enum event_type").otherwise("int").alias("underlying"),
        )
        structs = (
            part.groupBy(brand_tag(F.col("p_brand")).alias("name"))
            .agg(F.countDistinct("p_name").alias("n"))
            .select(
                F.concat(F.lit(f"c:{TYPES_HEADER}@S@"), F.col("name")).alias("usr"),
                "name",
                F.lit("struct").alias("kind"),
                header.alias("decl_file"),
                F.length("name").cast("int").alias("decl_line"),
                (F.col("n") * 8).cast("int").alias("byte_size"),
                F.lit("").alias("underlying"),
            )
        )
        enums = (
            self.table("events")
            .agg(F.countDistinct("event_type").alias("n"))
            .filter(F.col("n") > 0)
            .select(
                F.lit(f"c:{TYPES_HEADER}@E@event_type").alias("usr"),
                F.lit("event_type").alias("name"),
                F.lit("enum").alias("kind"),
                header.alias("decl_file"),
                F.lit(1).alias("decl_line"),
                F.lit(4).alias("byte_size"),
                F.lit("").alias("underlying"),
            )
        )
        return typedefs.unionByName(structs).unionByName(enums)

    @cache
    def symbol_tokens(self) -> DataFrame:
        return self.symbols().select(
            F.explode(text.tokens(F.col("name"), F.col("signature"))).alias("token"), "usr"
        )

    @cache
    def type_tokens(self) -> DataFrame:
        return self.types().select(
            F.explode(text.tokens(F.col("name"), F.col("underlying"))).alias("token"), "usr"
        )

    @cache
    def meta(self) -> DataFrame:
        from codefacts.schemas import SCHEMA_VERSION

        return self.spark.createDataFrame(
            [("schema_version", SCHEMA_VERSION)], "key string, value string"
        )

    def facts(self) -> Facts:
        names = [
            "targets", "target_sources", "blobs", "sources", "external_sources", "generated_sources",
            "symbols", "symbol_names", "symbol_definitions", "types", "type_fields", "enum_constants",
            "call_edges", "indirect_call_sites", "inline_decisions", "inline_records",
            "inline_instances", "icf_groups", "icf_group_members", "link_resolutions", "link_losers",
            "symbol_tokens", "type_tokens", "meta",
        ]
        return Facts(self.spark, {name: getattr(self, name) for name in names})


def seeded(spark: SparkSession, sf_dir: str) -> Facts:
    return Seed(spark, sf_dir).facts()

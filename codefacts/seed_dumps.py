"""Toolchain output derived from the test tables.

Line items stand for what a compiler saw in one of the units ``u_0`` to
``u_16``; the rows are also rendered as dump text so that the readers have
something to parse whose meaning is known. Rendering emits one line per row:
no group is ever gathered to build a file.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.seed import N_TARGETS, Seed
from codefacts.session import store

N_UNITS = 17
# Room for the lines of one symbol block, and symbol blocks per text block.
LINES_PER_SYMBOL = 1 << 28
SYMBOLS_PER_BLOCK = 256
BUILD_DIR = "/work/proj/build"
PROJECT_ROOT = "/work/proj"


def unit_object(unit: Column) -> Column:
    return F.concat(F.lit("obj/u_"), unit.cast("string"), F.lit(".c.o"))


def hex_address(pk: Column) -> Column:
    return F.lpad(F.lower(F.hex(pk * 16 + 4096)), 16, "0")


class Dumps:
    def __init__(self, seed: Seed):
        self.seed = seed

    # -- compiler plane, as rows ------------------------------------------

    @cache
    def unit_parts(self) -> DataFrame:
        """Which symbols each unit mentions; the pairs are stored, since most rows below are read off them several times."""
        seen = (
            self.seed.table("lineitem")
            .select((F.col("l_orderkey") % N_UNITS).alias("unit"), F.col("l_partkey").alias("pk"))
            .distinct()
        )
        return store(seen).join(self.seed.part_symbols(), "pk")

    @cache
    def cgraph_nodes(self) -> DataFrame:
        empty = F.array().cast("array<string>")
        visibility = (
            F.when(F.col("linkage") == "external", F.array(F.lit("externally_visible"), F.lit("public")))
            .when(F.col("linkage") == "weak", F.array(F.lit("public"), F.lit("weak")))
            .otherwise(empty)
        )
        own = self.unit_parts().select(
            unit_object(F.col("unit")).alias("object"),
            F.col("pk").cast("string").alias("local_id"),
            "name",
            F.col("name").alias("linkage_name"),
            F.lit("function").alias("kind"),
            (F.col("size") > 10).alias("analyzed"),
            ((F.col("pk") + F.col("unit")) % 5 == 0).alias("body_removed"),
            visibility.alias("visibility"),
            "address_taken",
            F.lit("").alias("clone_of"),
        )
        clone_name = F.concat("name", F.lit(".constprop.0"))
        clones = (
            self.unit_parts()
            .filter(F.col("size") > 40)
            .select(
                unit_object(F.col("unit")).alias("object"),
                (F.col("pk") + self.seed.n_parts()).cast("string").alias("local_id"),
                clone_name.alias("name"),
                clone_name.alias("linkage_name"),
                F.lit("function").alias("kind"),
                F.lit(True).alias("analyzed"),
                F.lit(False).alias("body_removed"),
                empty.alias("visibility"),
                (F.col("unit") == 3).alias("address_taken"),
                F.col("pk").cast("string").alias("clone_of"),
            )
        )
        return own.unionByName(clones)

    @cache
    def call_rows(self) -> DataFrame:
        return (
            self.seed.table("lineitem")
            .filter(F.col("l_linenumber") == 1)
            .select(
                (F.col("l_orderkey") % N_UNITS).alias("unit"),
                F.col("l_partkey").alias("caller_pk"),
                ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % self.seed.n_parts()).alias("callee_pk"),
                (F.col("l_linestatus") == "F").alias("inlined"),
            )
            .distinct()
        )

    @cache
    def cgraph_calls(self) -> DataFrame:
        return self.call_rows().select(
            unit_object(F.col("unit")).alias("object"),
            F.col("caller_pk").cast("string").alias("caller_id"),
            F.col("callee_pk").cast("string").alias("callee_id"),
            "inlined",
        )

    @cache
    def titles(self) -> DataFrame:
        """The source path each unit's dump names, the last two outside the project."""
        units = self.seed.table("lineitem").select((F.col("l_orderkey") % N_UNITS).alias("unit")).distinct()
        path = F.when(F.col("unit") < 15, F.lit("../src/unit_")).otherwise(F.lit("/ext/unit_"))
        return units.select(
            unit_object(F.col("unit")).alias("object"),
            "unit",
            F.concat(path, F.col("unit").cast("string"), F.lit(".c")).alias("title"),
        )

    @cache
    def ci_nodes(self) -> DataFrame:
        return (
            self.unit_parts()
            .filter(F.col("size") > 25)
            .select(
                unit_object(F.col("unit")).alias("object"),
                "unit",
                "name",
                F.concat(F.lit("src/unit_"), F.col("unit").cast("string"), F.lit(".c")).alias("decl_file"),
                (F.col("pk") % 100 + 1).cast("int").alias("decl_line"),
                F.col("pk"),
            )
        )

    @cache
    def folds(self) -> DataFrame:
        """Functions of a unit with the same body: the least number survives."""
        parts = self.unit_parts().select("unit", "pk", "name", "body", "brand")
        first = parts.groupBy("unit", "body", "brand").agg(
            F.min(F.struct("pk", "name")).alias("w"), F.count(F.lit(1)).alias("n")
        )
        return (
            parts.join(first.filter(F.col("n") > 1), ["unit", "body", "brand"])
            .filter(F.col("pk") != F.col("w.pk"))
            .select(
                unit_object(F.col("unit")).alias("object"),
                F.col("w.name").alias("winner"),
                F.col("name").alias("loser"),
                F.col("w.pk").alias("winner_pk"),
                F.col("pk").alias("loser_pk"),
            )
        )

    @cache
    def record_rows(self) -> DataFrame:
        return (
            self.seed.table("lineitem")
            .filter(F.col("l_linenumber").isin(4, 5))
            .select(
                (F.col("l_orderkey") % N_UNITS).alias("unit"),
                F.col("l_partkey").alias("caller_pk"),
                ((F.col("l_partkey") * 31 + F.col("l_suppkey") % 4) % self.seed.n_parts()).alias("callee_pk"),
                F.when(F.col("l_linestatus") == "O", "einline").otherwise("inline").alias("pass"),
                (F.col("l_returnflag") == "A").alias("inlined"),
                F.when(F.col("l_returnflag") == "R", "call is unlikely and code size would grow")
                .when(F.col("l_returnflag") == "N", "function body not available")
                .otherwise("")
                .alias("reason"),
                F.concat(F.lit("src/supp_"), F.col("l_suppkey").cast("string"), F.lit(".c")).alias("file"),
                F.floor("l_quantity").cast("int").alias("line"),
                F.col("l_linenumber").cast("int").alias("column"),
            )
            .distinct()
        )

    @cache
    def records(self) -> DataFrame:
        return self.record_rows().select(
            unit_object(F.col("unit")).alias("object"),
            F.col("caller_pk").cast("string").alias("caller_id"),
            F.col("callee_pk").cast("string").alias("callee_id"),
            "pass", "inlined", "reason", "file", "line", "column",
        )

    # -- link plane, as rows ------------------------------------------------

    @cache
    def link_rows(self) -> DataFrame:
        """Symbols seen in linked targets, file-local ones included."""
        linked = self.seed.target_keys().filter(F.col("kind") != "static_library").select("nk", "target")
        unit = F.col("l_orderkey") % N_UNITS
        folder = F.when(unit < 5, F.lit("lib/libshared.a.p/u_")).otherwise(F.lit("app/app.p/u_"))
        rows = (
            self.seed.table("lineitem")
            .filter(F.col("l_linenumber").isin(2, 3))
            .select(
                F.col("l_partkey").alias("pk"),
                (F.col("l_orderkey") % N_TARGETS).alias("nk"),
                F.concat(folder, unit.cast("string"), F.lit(".c.o")).alias("object"),
                F.col("l_returnflag").alias("flag"),
            )
        )
        symbols = self.seed.part_symbols().select("pk", "name", "linkage")
        kind = (
            F.when(F.col("linkage") == "internal", "t")
            .when(F.col("flag") == "A", "T")
            .when(F.col("flag") == "N", "W")
            .otherwise("C")
        )
        return (
            rows.join(symbols, "pk")
            .join(linked, "nk")
            .select("target", "nk", "pk", "name", "object", kind.alias("nm_kind"))
            .distinct()
        )

    @cache
    def listing(self) -> DataFrame:
        rows = self.link_rows().groupBy("target", "pk", "name").agg(F.max("nm_kind").alias("nm_kind"))
        return rows.select(
            "target", "name", "nm_kind", hex_address(F.col("pk")).alias("address"), F.col("pk").alias("pos"), "pk"
        )

    @cache
    def object_defs(self) -> DataFrame:
        return self.link_rows().select("name", "object", "nm_kind").distinct()

    @cache
    def map_origins(self) -> DataFrame:
        """Every target has a linker map; single symbols are missing from it, as folded and merged ones are."""
        return (
            self.link_rows()
            .filter((F.col("nk") + F.col("pk")) % 7 != 0)
            .groupBy("target", "name", "pk")
            .agg(F.max("object").alias("object"))
        )

    @cache
    def link_object_sources(self) -> DataFrame:
        unit = F.regexp_extract("object", r"u_(\d+)\.c\.o$", 1)
        return (
            self.object_defs()
            .select("object")
            .distinct()
            .select("object", F.concat(F.lit("src/brand_"), unit, F.lit(".c")).alias("source"))
        )

    @cache
    def branch_rows(self) -> DataFrame:
        linked = self.seed.target_keys().filter(F.col("kind") != "static_library").select("nk", "target")
        rows = (
            self.seed.table("lineitem")
            .filter((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O"))
            .select(
                F.col("l_partkey").alias("caller_pk"),
                ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % self.seed.n_parts()).alias("callee_pk"),
                (F.col("l_orderkey") % N_TARGETS).alias("nk"),
            )
        )
        names = self.seed.part_symbols().select("pk", "name")
        callers = names.select(F.col("pk").alias("caller_pk"), F.col("name").alias("caller"))
        callees = names.select(F.col("pk").alias("callee_pk"), F.col("name").alias("callee_name"))
        through_stub = F.col("callee_pk") % 3 == 0
        return (
            rows.join(linked, "nk")
            .join(callers, "caller_pk")
            .join(callees, "callee_pk")
            .select(
                "target",
                "caller_pk",
                "callee_pk",
                "caller",
                hex_address(F.col("caller_pk")).alias("caller_address"),
                F.when(through_stub, F.concat("callee_name", F.lit("@plt")))
                .otherwise(F.col("callee_name"))
                .alias("callee"),
                F.when(through_stub, F.lit("530"))
                .otherwise(F.lower(F.hex(F.col("callee_pk") * 16 + 4096)))
                .alias("callee_address"),
            )
            .distinct()
        )

    # -- dump text --------------------------------------------------------------

    @staticmethod
    def _lines(rows: DataFrame, file: Column, symbol: Column, place: Column, line: Column) -> DataFrame:
        """Lines placed by symbol number, then by place inside the symbol's block."""
        return rows.select(
            file.alias("file"),
            F.floor(symbol / SYMBOLS_PER_BLOCK).cast("long").alias("block"),
            (symbol * LINES_PER_SYMBOL + place).cast("long").alias("pos"),
            line.alias("line"),
        ).filter(F.col("line").isNotNull())

    @cache
    def cgraph_lines(self) -> DataFrame:
        nodes = self.cgraph_nodes()
        number = F.col("local_id").cast("long")
        header = F.format_string("%s/%s (%s)", "name", "local_id", "linkage_name")
        table = [
            F.lit(""),
            header,
            F.when(F.col("analyzed"), "  Type: function definition analyzed").otherwise("  Type: function"),
            F.when(F.col("body_removed"), "  Body removed by symtab_remove_unreachable_nodes"),
            F.concat(F.lit("  Visibility: "), F.array_join("visibility", " ")),
            F.when(F.col("address_taken"), "  Referring: ops/900 (read) table/901 (addr)"),
            F.when(
                F.col("clone_of") != "",
                F.concat(F.lit("  Clone of "), F.substring_index("name", ".", 1), F.lit("/"), F.col("clone_of")),
            ),
            F.lit("  Function flags: count:1073741824 (estimated locally) body"),
            F.lit("  Called by: main/7 (1.00 per call)"),
        ]
        # A later table that lost most of its details.
        late = [F.lit("Final Symbol table:"), header, F.lit("  Type: function")]
        placed = nodes.select("object", "local_id", F.posexplode(F.array(*table, *late)).alias("i", "text"))
        again = F.col("i") >= len(table)
        listed = self._lines(
            placed, F.col("object"), number + F.when(again, F.lit(1 << 32)).otherwise(F.lit(0)),
            F.when(again, F.col("i") - len(table)).otherwise(F.col("i")), F.col("text"),
        )
        called = self.call_rows().join(
            self.seed.part_symbols().select(F.col("pk").alias("callee_pk"), F.col("name").alias("callee")),
            "callee_pk",
        )
        mention = F.format_string("  Calls: %s/%d ", "callee", "callee_pk")
        tail = F.when(F.col("inlined"), "(inlined) (1073741824 (estimated locally),1.00 per call)").otherwise(
            "(1073741824 (estimated locally),1.00 per call)"
        )
        # Only units that print the caller's block have the call.
        callers = self.unit_parts().select("unit", F.col("pk").alias("caller_pk"))
        calls = self._lines(
            called.join(callers, ["unit", "caller_pk"], "left_semi"),
            unit_object(F.col("unit")),
            F.col("caller_pk"),
            F.lit(16) + F.col("callee_pk") * 2 + F.col("inlined").cast("int"),
            F.concat(mention, tail),
        )
        return listed.unionByName(calls)

    @cache
    def ci_lines(self) -> DataFrame:
        graph = self._lines(
            self.titles(),
            F.col("object"),
            F.lit(0),
            F.lit(0),
            F.concat(F.lit('graph: { title: "'), F.col("title"), F.lit('"')),
        )
        label = F.format_string(
            'node: { title: "%s" label: "%s\\n%s:%d:5\\n%d bytes (static)\\n0 dynamic objects" }',
            "name", "name", "decl_file", "decl_line", "pk",
        )
        nodes = self._lines(self.ci_nodes(), F.col("object"), F.col("pk") + 1, F.lit(0), label)
        return graph.unionByName(nodes)

    @cache
    def nm_lines(self) -> DataFrame:
        text = F.concat_ws(
            " ", "name", "nm_kind", "address", F.lower(F.hex(F.col("pk") % 500 + 1))
        )
        return self._lines(self.listing(), F.col("target"), F.col("pk"), F.lit(0), text)

    @cache
    def objdump_lines(self) -> DataFrame:
        rows = self.branch_rows()
        label = rows.select("target", "caller_pk", "caller", "caller_address").distinct()
        labels = self._lines(
            label.select("*", F.posexplode(F.array(
                F.lit(""),
                F.concat("caller_address", F.lit(" <"), "caller", F.lit(">:")),
                F.lit("    1040:\tpush   %rbp"),
                F.lit("    1044:\tcall   *0x2d5e(%rip)        # 3dc0 <g_ops>"),
            )).alias("i", "text")),
            F.col("target"), F.col("caller_pk"), F.col("i"), F.col("text"),
        )
        branch = F.concat(
            F.lit("    104b:\tcall   "), "callee_address", F.lit(" <"), "callee", F.lit(">")
        )
        branches = self._lines(rows, F.col("target"), F.col("caller_pk"), F.col("callee_pk") + 8, branch)
        return labels.unionByName(branches)

    @cache
    def map_lines(self) -> DataFrame:
        opening = (
            self.map_origins()
            .select("target")
            .distinct()
            .select(
                "target",
                F.posexplode(F.array(
                    F.lit("Archive member included to satisfy reference by file (symbol)"),
                    F.lit(""),
                    F.lit("lib/libshared.a.p/u_1.c.o"),
                    F.lit("                              app/app.p/u_9.c.o (hook)"),
                    F.lit("Discarded input sections"),
                )).alias("i", "text"),
            )
        )
        head = self._lines(opening, F.col("target"), F.lit(0), F.col("i"), F.col("text"))
        section = F.concat(F.lit(" .text."), "name")
        where = F.concat(F.lit("0x"), hex_address(F.col("pk")), F.lit("        0x2a "), "object")
        symbol = F.concat(F.lit("                0x"), hex_address(F.col("pk")), F.lit("                "), "name")
        split = F.col("pk") % 2 == 0
        body = self.map_origins().select(
            "target",
            "pk",
            F.posexplode(F.array(
                F.when(split, section).otherwise(F.concat(section, F.lit("  "), where)),
                F.when(split, F.concat(F.lit("                "), where)),
                symbol,
                F.lit(" *fill*         0x0000000000001192        0xe "),
                # A later mention outside any contribution changes nothing.
                symbol,
            )).alias("i", "text"),
        )
        listing = self._lines(body, F.col("target"), F.col("pk") + 1, F.col("i"), F.col("text"))
        return head.unionByName(listing)

    @cache
    def icf_lines(self) -> DataFrame:
        folds = self.folds()
        announced = folds.select("object", "winner", "winner_pk").distinct()
        intro = self._lines(
            announced, F.col("object"), F.col("winner_pk"), F.lit(0),
            F.format_string("Introduced new external node (%s.localalias/%d).", "winner", "winner_pk"),
        )
        body = folds.select(
            "object",
            "loser_pk",
            F.posexplode(F.array(
                F.format_string("Analyzing function: %s/%d", "loser", "loser_pk"),
                F.lit("  scanning: _1 = x_2(D) + 1;"),
                F.concat(F.lit("  retval.2_4 = "), "winner", F.lit(".localalias (x_2(D)); [tail call]")),
            )).alias("i", "text"),
        )
        return intro.unionByName(
            self._lines(body, F.col("object"), F.col("loser_pk"), F.col("i") + 4, F.col("text"))
        )

    @cache
    def inline_lines(self) -> DataFrame:
        heads = self.unit_parts().select(
            "unit",
            "pk",
            F.posexplode(F.array(
                F.format_string("IPA function summary for %s/%d inlinable", "name", "pk"),
                F.lit("  global time:     12.0"),
                F.lit("  calls:"),
            )).alias("i", "text"),
        )
        called = self.call_rows().join(
            self.seed.part_symbols().select(F.col("pk").alias("callee_pk"), F.col("name").alias("callee")),
            "callee_pk",
        ).join(self.unit_parts().select("unit", F.col("pk").alias("caller_pk")), ["unit", "caller_pk"], "left_semi")
        verdict = F.when(F.col("inlined"), "inlined").otherwise("function not considered for inlining")
        entries = self._lines(
            called, unit_object(F.col("unit")), F.col("caller_pk"),
            F.lit(8) + F.col("callee_pk") * 2 + F.col("inlined").cast("int"),
            F.concat(F.lit("    "), F.format_string("%s/%d ", "callee", "callee_pk"), verdict),
        )
        return self._lines(
            heads, unit_object(F.col("unit")), F.col("pk"), F.col("i"), F.col("text")
        ).unionByName(entries)

    @cache
    def record_documents(self) -> DataFrame:
        """One small document per decision."""
        names = self.seed.part_symbols().select("pk", "name")
        rows = (
            self.record_rows()
            .join(names.select(F.col("pk").alias("caller_pk"), F.col("name").alias("caller")), "caller_pk")
            .join(names.select(F.col("pk").alias("callee_pk"), F.col("name").alias("callee")), "callee_pk")
        )
        caller = F.format_string('{"symtab_node":"%s/%d"}', "caller", "caller_pk")
        callee = F.format_string('{"symtab_node":"%s/%d"}', "callee", "callee_pk")
        message = F.when(
            F.col("inlined"),
            F.concat(F.lit('["Inlined ",'), callee, F.lit('," into ",'), caller, F.lit(',""]')),
        ).otherwise(
            F.concat(
                F.lit('["not inlinable: ",'), caller, F.lit('," -> ",'), callee,
                F.lit(',", '), "reason", F.lit('.\\n"]'),
            )
        )
        record = F.concat(
            F.lit('{"kind":"'),
            F.when(F.col("inlined"), "success").otherwise("failure"),
            F.lit('","pass":"0x'),
            F.when(F.col("pass") == "einline", "1").otherwise("2"),
            F.lit('","message":'),
            message,
            F.lit(',"location":{"file":"'),
            "file",
            F.lit('","line":'),
            F.col("line").cast("string"),
            F.lit(',"column":'),
            F.col("column").cast("string"),
            F.lit("}}"),
        )
        note = F.lit('{"kind":"note","pass":"0x2","message":["considering"]}')
        tree = (
            '[{"id":"0x9","name":"root","optgroups":[],"children":['
            '{"id":"0x1","name":"einline","optgroups":["inline"],"children":[]},'
            '{"id":"0x8","name":"ipa","children":['
            '{"id":"0x2","name":"inline","optgroups":["ipa","inline"]}]}]}]'
        )
        document = F.concat(
            F.lit('[{"format":"1"},' + tree + ",["), record, F.lit(","), note, F.lit("]]")
        )
        return rows.select(unit_object(F.col("unit")).alias("file"), document.alias("document"))

    # -- debug information ------------------------------------------------------

    @staticmethod
    def _entry(offset: Column, depth: int, tag: str, *attributes: tuple[str, Column]) -> Column:
        """Lines of one entry; an attribute whose value is NULL is left out."""
        head = F.concat(F.lit("0x"), F.lower(F.hex(offset)), F.lit(": " + "  " * depth + "DW_TAG_" + tag))
        lines = [
            F.concat(F.lit(" " * (14 + 2 * depth) + f"DW_AT_{name}\t("), value, F.lit(")"))
            for name, value in attributes
        ]
        return F.array(head, *lines)

    def _entry_lines(self, rows: DataFrame, unit: Column, *entries: tuple[Column, Column, Column]) -> DataFrame:
        """Lines of several entries of each row, as symbol, place and lines; an entry that is NULL is left out."""
        items = [
            F.when(entry.isNotNull(), F.struct(symbol.cast("long").alias("s"), place.cast("long").alias("p"), entry.alias("lines")))
            for symbol, place, entry in entries
        ]
        each = rows.select(unit.alias("u"), F.explode(F.array(*items)).alias("e"))
        spread = each.select("u", F.col("e.s").alias("s"), F.col("e.p").alias("p"), F.posexplode("e.lines").alias("i", "text"))
        return self._lines(
            spread, unit_object(F.col("u")), F.col("s"), F.col("p") + F.col("i"), F.col("text")
        )

    @cache
    def dwarf_lines(self) -> DataFrame:
        """Debug entries of each unit: its types, the functions it mentions, bodies inlined into them."""
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        ref = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
        unit, pk = F.col("unit"), F.col("pk")
        int_type = F.lit(48)
        source = F.concat(F.lit("../src/unit_"), unit.cast("string"), F.lit(".c"))
        units = self.titles().select("unit")
        top = self._entry(F.lit(11), 0, "compile_unit", ("name", quoted(source)), ("comp_dir", F.lit(f'"{BUILD_DIR}"')))
        base = self._entry(int_type, 1, "base_type", ("byte_size", F.lit("0x04")), ("encoding", F.lit("DW_ATE_signed")), ("name", F.lit('"int"')))
        heads = self._entry_lines(units, unit, (F.lit(0), F.lit(0), top), (F.lit(0), F.lit(16), base))
        # A part's type is the pointee of its function's only parameter.
        kinds = self.seed.table("part").select(F.col("p_partkey").alias("pk"), F.lower("p_type").alias("type_name"))
        parts = self.unit_parts().join(kinds, "pk")
        pointer_to = F.lit(8192) + F.ascii("type_name") * 16
        named = parts.filter(~F.col("type_name").isin("small", "economy")).select("unit", "type_name").distinct()
        typedef = self._entry(
            F.lit(4096) + F.ascii("type_name") * 16, 1, "typedef", ("name", quoted(F.col("type_name"))),
            ("decl_file", F.lit(f'"{PROJECT_ROOT}/include/types.h"')), ("decl_line", F.length("type_name").cast("string")),
            ("type", ref(int_type)),
        )
        pointer = self._entry(pointer_to, 1, "pointer_type", ("byte_size", F.lit("0x08")), ("type", ref(F.lit(4096) + F.ascii("type_name") * 16)))
        types = self._entry_lines(
            named, unit,
            (F.lit(0), F.lit(1024) + F.ascii("type_name") * 32, typedef),
            (F.lit(0), F.lit(8192) + F.ascii("type_name") * 32, pointer),
        )
        at = (pk + 1) * LINES_PER_SYMBOL
        small = F.col("type_name") == "small"

        def parameter(i: int, given: Column, type_ref: Column) -> tuple[Column, Column, Column]:
            entry = self._entry(at + 16 + i * 16, 2, "formal_parameter", ("type", ref(type_ref)))
            return pk + 1, F.lit(64 + i * 16), F.when(given, entry)

        functions = self._entry_lines(
            parts, unit,
            (pk + 1, F.lit(0), self._entry(
                at, 1, "subprogram", ("name", quoted(F.col("name"))),
                ("decl_file", F.concat(F.lit(f'"{PROJECT_ROOT}/include/h_'), unit.cast("string"), F.lit('.h"'))),
                ("decl_line", (pk % 50 + 1).cast("string")), ("prototyped", F.lit("true")),
                ("type", F.when(F.col("type_name") != "economy", ref(int_type))),
                ("low_pc", F.when(F.col("size") > 25, F.lit("0x0000000000001040"))),
                ("inline", F.when(F.col("size").between(11, 25), F.lit("DW_INL_inlined"))),
                ("declaration", F.when(F.col("size") <= 10, F.lit("true"))),
            )),
            parameter(0, F.col("type_name") != "economy", F.when(small, int_type).otherwise(pointer_to)),
            parameter(1, small, int_type),
        )
        present = self.unit_parts().select("unit", "pk", "name")
        copies = (
            self.call_rows()
            .filter("inlined")
            .join(present.select("unit", F.col("pk").alias("caller_pk")), ["unit", "caller_pk"], "left_semi")
            .join(present.select("unit", F.col("pk").alias("callee_pk"), F.col("name").alias("callee")), ["unit", "callee_pk"])
        )
        host = (F.col("caller_pk") + 1) * LINES_PER_SYMBOL
        bodies = self._entry_lines(
            copies, unit,
            (F.col("caller_pk") + 1, F.lit(1024) + F.col("callee_pk") * 8, self._entry(
                host + 1024 + F.col("callee_pk"), 2, "inlined_subroutine",
                ("abstract_origin", F.concat(ref((F.col("callee_pk") + 1) * LINES_PER_SYMBOL), F.lit(" "), quoted(F.col("callee")))),
                ("call_file", F.lit(f'"{PROJECT_ROOT}/src/a.c"')), ("call_line", (F.col("callee_pk") % 90 + 1).cast("string")),
            )),
        )
        return heads.unionByName(types).unionByName(functions).unionByName(bodies)

    @cache
    def dwarf_details(self) -> DataFrame:
        """Further entries of each unit: a record per brand, an enum, and functions that call their function-pointer parameter.

        Records and their members, the enum and its constants and the functions
        follow one another in strides of the number of parts.
        """
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        ref = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
        header = F.lit(f'"{PROJECT_ROOT}/include/types.h"')
        unit, pk, stride = F.col("unit"), F.col("pk"), self.seed.n_parts() + 2
        number = F.regexp_extract("brand", r"(\d+)$", 1).cast("long")
        rows = self.unit_parts().select("unit", "pk", "name", number.alias("number"))
        units = self.titles().select("unit")
        int_type, signature, pointer = F.lit(48), F.lit(64), F.lit(128)
        offset = lambda symbol, place=0: symbol * LINES_PER_SYMBOL + place
        heads = [
            (0, self._entry(F.lit(11), 0, "compile_unit", ("name", quoted(F.concat(F.lit("../src/unit_"), unit.cast("string"), F.lit(".c")))), ("comp_dir", F.lit(f'"{BUILD_DIR}"')))),
            (48, self._entry(int_type, 1, "base_type", ("byte_size", F.lit("0x04")), ("encoding", F.lit("DW_ATE_signed")), ("name", F.lit('"int"')))),
            (64, self._entry(signature, 1, "subroutine_type", ("prototyped", F.lit("true")), ("type", ref(int_type)))),
            (96, self._entry(F.lit(96), 2, "formal_parameter", ("type", ref(int_type)))),
            (128, self._entry(pointer, 1, "pointer_type", ("byte_size", F.lit("0x08")), ("type", ref(signature)))),
        ]
        modes = F.lit(64) * stride
        mode = self._entry(
            offset(modes), 1, "enumeration_type", ("name", quoted(F.concat(F.lit("mode_"), (unit % 5).cast("string")))),
            ("byte_size", F.lit("0x04")), ("decl_file", header), ("decl_line", (unit % 5 + 1).cast("string")),
        )
        of_units = self._entry_lines(
            units, unit, *[(F.lit(0), F.lit(place), entry) for place, entry in heads], (modes, F.lit(0), mode)
        )
        records = rows.groupBy("unit", "number").agg(F.count("*").alias("n"))
        record = F.col("number") * stride
        kinds = []
        for tag, kind in (("union_type", F.col("number") % 4 == 0), ("structure_type", F.col("number") % 4 != 0)):
            entry = self._entry(
                offset(record), 1, tag, ("name", quoted(F.concat(F.lit("brand_"), F.col("number").cast("string")))),
                ("byte_size", ref(F.col("n") * 4)), ("decl_file", header), ("decl_line", F.col("number").cast("string")),
            )
            kinds.append((record, F.lit(0), F.when(kind, entry)))
        of_records = self._entry_lines(records, unit, *kinds)
        member = record + pk + 1
        constant = modes + pk + 1
        host = F.lit(65) * stride + pk + 1
        register = F.when(pk % 5 == 0, F.lit("DW_OP_reg0 RAX")).when(pk % 2 == 0, F.lit("DW_OP_reg4 RSI")).otherwise(F.lit("DW_OP_entry_value(DW_OP_reg5 RDI)"))
        # Every second function takes an integer before the pointer; every fifth call is not through a parameter.
        of_parts = self._entry_lines(
            rows, unit,
            (member, F.lit(0), self._entry(
                offset(member), 2, "member", ("name", quoted(F.concat(F.lit("m_"), pk.cast("string")))),
                ("type", ref(F.when(pk % 3 == 0, pointer).otherwise(int_type))), ("data_member_location", ref(pk % 50 * 4)),
            )),
            (constant, F.lit(0), self._entry(
                offset(constant), 2, "enumerator", ("name", quoted(F.concat(F.lit("V_"), pk.cast("string")))), ("const_value", (pk * 3 - 100).cast("string")),
            )),
            (host, F.lit(0), self._entry(
                offset(host), 1, "subprogram", ("name", quoted(F.col("name"))), ("prototyped", F.lit("true")), ("type", ref(int_type)), ("low_pc", F.lit("0x0000000000001040")),
            )),
            (host, F.lit(64), F.when(pk % 2 == 0, self._entry(offset(host, 64), 2, "formal_parameter", ("name", F.lit('"n"')), ("type", ref(int_type))))),
            (host, F.lit(128), self._entry(offset(host, 128), 2, "formal_parameter", ("name", F.lit('"hook"')), ("type", ref(pointer)))),
            (host, F.lit(1024), self._entry(
                offset(host, 1024), 2, "call_site", ("call_target", register), ("call_return_pc", ref(pk + 4096)),
                ("call_file", F.lit(f'"{PROJECT_ROOT}/src/a.c"')), ("call_line", (pk % 90 + 1).cast("string")),
            )),
        )
        return of_units.unionByName(of_records).unionByName(of_parts)

    # -- build metadata -----------------------------------------------------------

    @cache
    def dependency_logs(self) -> DataFrame:
        """One small binary log per part and supplier of an order, its record rewritten once."""
        rows = self.seed.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()

        def path_record(path: Column, check: str) -> Column:
            raw = F.rpad(F.hex(F.encode(path, "utf-8")), 32, "0")
            return F.concat(F.lit("14000000"), raw, F.lit(check))

        output = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".o"))
        first = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".c"))
        second = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".h"))
        start = F.lit("23206E696E6A61646570730A" + "04000000")
        stamp = "0100000000000000"
        one = F.lit("10000080" + "00000000" + stamp + "01000000")
        both = F.lit("14000080" + "00000000" + stamp + "02000000" + "01000000")
        digits = F.concat(
            start, path_record(output, "FFFFFFFF"), path_record(first, "FEFFFFFF"), path_record(second, "FDFFFFFF"),
            one, F.when(F.col("l_suppkey") % 2 == 0, both).otherwise(F.lit("")), F.lit("1000"),
        )
        file = F.concat_ws("/", F.lit("log"), "l_orderkey", "l_partkey", "l_suppkey")
        return rows.select(file.alias("file"), F.unhex(digits).alias("content"))

    @cache
    def target_documents(self) -> DataFrame:
        """Build-description entries as JSON text, one per source file."""
        docs = self.seed.doc_paths().select((F.col("doc_id") % N_TARGETS).alias("nk"), "path", "doc_id")
        language = F.when(F.col("path").endswith(".txt"), "other").otherwise("c")
        made = F.col("path").endswith(".h")
        path = F.concat(F.lit('"'), "path", F.lit('"'))
        return docs.join(self.seed.target_keys(), "nk").select(
            F.concat(
                F.lit('{"name":"'), "target", F.lit('","type":"'), F.replace("kind", F.lit("_"), F.lit(" ")),
                F.lit('","filename":["/b/'), "target", F.lit('"],"target_sources":[{"language":"'), language,
                F.lit('","sources":['), F.when(~made, path).otherwise(""), F.lit('],"generated_sources":['),
                F.when(made, path).otherwise(""), F.lit(']},{"linker":["cc"],"parameters":["-o","'), "target", F.lit('"]}]}'),
            ).alias("document")
        )

    @cache
    def build_files(self) -> DataFrame:
        """A build tree's listing: an object per part and the dumps its size earns it."""
        parts = self.seed.part_symbols()
        stem = F.concat(F.lit(f"{BUILD_DIR}/obj/"), F.col("brand"), F.lit("/p_"), F.col("pk").cast("string"), F.lit(".c"))
        private = F.concat(F.lit(f"{BUILD_DIR}/meson-private/p_"), F.col("pk").cast("string"), F.lit(".c.o"))
        names = F.array_compact(F.array(
            F.concat(stem, F.lit(".o")),
            F.when(F.col("size") > 10, F.concat(stem, F.lit(".ci"))),
            F.when(F.col("size") > 20, F.concat(stem, F.lit(".c.000i.cgraph"))),
            F.when(F.col("size") > 30, F.concat(stem, F.lit(".c.opt-record.json.gz"))),
            F.when(F.col("size") < 5, private),
        ))
        return parts.select(F.explode(names).alias("path"), F.lit(0).cast("timestamp").alias("mtime"), F.lit(1).alias("length"))

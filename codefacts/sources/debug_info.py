"""Debug information from its text dump, as rows per entry.

The dump prints one entry per paragraph: its offset, its nesting by indentation
and its attributes, with file names already spelled out. Entries, their parents,
rendered type names, inlined bodies and call targets are all joins over those
rows; chains of references (types, enclosing scopes) resolve level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.session import cut_lineage, store
from codefacts.sources.lines import carry_forward

# The dump's grammar and the attributes used.
ENTRY = r"^0x([0-9a-f]+):( +)DW_TAG_(\w+)"
ATTRIBUTE = r"^\s+DW_AT_(\w+)\s+\((.*)\)\s*$"
QUOTED = re.compile(r'"((?:[^"\\]|\\[^\n\r\x85\u2028\u2029])*)"')
NUMBER = re.compile(r"0x([0-9a-fA-F]+)|(-?[0-9]+)")
TEXT_ATTRIBUTES = ("name", "linkage_name", "decl_file", "call_file", "comp_dir")
NUMBER_ATTRIBUTES = (
    "decl_line", "decl_column", "byte_size", "data_member_location", "const_value", "call_line",
    "call_column", "call_return_pc",
)
REFERENCE_ATTRIBUTES = ("type", "abstract_origin", "call_origin")
PRESENCE_ATTRIBUTES = ("low_pc", "inline")
FLAG_ATTRIBUTES = ("declaration", "external", "prototyped")
RAW_ATTRIBUTES = ("encoding", "call_target")
ATTRIBUTES = (
    *TEXT_ATTRIBUTES, *NUMBER_ATTRIBUTES, *REFERENCE_ATTRIBUTES, *PRESENCE_ATTRIBUTES, *FLAG_ATTRIBUTES, *RAW_ATTRIBUTES,
)
# The column each attribute becomes, with its type.
COLUMNS = (
    {a: (a, "string") for a in (*TEXT_ATTRIBUTES, *RAW_ATTRIBUTES)}
    | {a: (a, "long") for a in NUMBER_ATTRIBUTES}
    | {a: (f"{a}_ref", "long") for a in REFERENCE_ATTRIBUTES}
    | {a: (f"has_{a}", "boolean") for a in PRESENCE_ATTRIBUTES}
    | {a: (a, "boolean") for a in FLAG_ATTRIBUTES}
)

# What types, members and constants are made of.
TYPE_ATTRIBUTES = (
    "name", "decl_file", "decl_line", "decl_column", "byte_size", "data_member_location", "const_value", "type", "prototyped",
)

# What callers, call sites and the targets of calls through parameters are made of.
CALL_ATTRIBUTES = (
    "name", "type", "prototyped", "byte_size", "encoding", "abstract_origin", "call_origin", "call_target", "call_return_pc",
    "call_file", "call_line", "call_column",
)

# Register numbers of the integer argument registers in calling
# order, and the base-type encodings passed in one of them.
ARGUMENT_REGISTERS = (5, 4, 1, 2, 8, 9)
INTEGER_ENCODINGS = (
    "DW_ATE_address", "DW_ATE_boolean", "DW_ATE_signed", "DW_ATE_signed_char", "DW_ATE_unsigned",
    "DW_ATE_unsigned_char",
)
QUALIFIERS = ("const_type", "volatile_type", "typedef", "restrict_type")
AGGREGATES = ("structure_type", "union_type", "array_type", "class_type")
RECORD_TAGS = {"structure_type": "struct", "union_type": "union"}
TAGGED = {**RECORD_TAGS, "enumeration_type": "enum"}

# Places of earlier blocks that Spark may send to every task; beyond it entries and places meet in a shuffle.
MOST_SENT = 50_000


def _number(raw: Column) -> Column:
    hexadecimal = F.regexp_extract(raw, r"^0x([0-9a-fA-F]+)", 1)
    decimal = F.regexp_extract(raw, r"^(-?\d+)", 1)
    return F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("long")).otherwise(
        decimal.try_cast("long")
    )


def _typed(name: str, raw: list[str | None]) -> pa.Array:
    """Values of one attribute as text, number, presence or flag; NULL where it is not given."""
    if name in TEXT_ATTRIBUTES:
        found = [None if r is None else QUOTED.search(r) for r in raw]
        return pa.array([None if r is None else m[1] if m else "" for r, m in zip(raw, found)], "string")
    if name in NUMBER_ATTRIBUTES or name in REFERENCE_ATTRIBUTES:
        found = [None if r is None else NUMBER.match(r) for r in raw]
        values = [None if m is None else int(m[1], 16) if m[1] else int(m[2]) for m in found]
        return pa.array([v if v is not None and -(1 << 63) <= v < 1 << 63 else None for v in values], "int64")
    if name in PRESENCE_ATTRIBUTES:
        return pa.array([None if r is None else True for r in raw], "bool")
    if name in FLAG_ATTRIBUTES:
        return pa.array([None if r is None else r == "true" for r in raw], "bool")
    return pa.array(raw, "string")


def _assembled(batches: Iterator[pa.RecordBatch], attributes: tuple[str, ...] = ATTRIBUTES) -> Iterator[pa.RecordBatch]:
    """Entries out of their lines, which come in order; an entry without a tag is the rest of one begun in an earlier block.

    ``parent`` is filled in where the last entry one level up is in the same block.
    """
    held: pa.Table | None = None
    # The block last seen and, per depth, the offset of its last entry.
    at: tuple | None = None
    above: dict[int, int] = {}

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        return column.fill_null(-1).to_numpy().astype(np.int64)

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return numbers(column.combine_chunks().dictionary_encode().indices)

    def begun(rows: pa.Table) -> np.ndarray:
        """Whether an entry begins at each row; a heading that is printed twice begins one."""
        place = np.stack([codes(rows["file"]), numbers(rows["block"])])
        heading = np.stack([numbers(rows[c]) for c in ("pos", "offset", "depth")] + [codes(rows["tag"])])
        tagged = rows["tag"].is_valid().to_numpy()
        begins = tagged.copy()
        moved = (place[:, 1:] != place[:, :-1]).any(axis=0)
        repeated = tagged[1:] & tagged[:-1] & (heading[:, 1:] == heading[:, :-1]).all(axis=0)
        begins[1:] = moved | (tagged[1:] & ~repeated)
        begins[:1] = True
        return begins

    def built(rows: pa.Table) -> pa.RecordBatch:
        nonlocal at, above
        begins = begun(rows)
        first = np.flatnonzero(begins)
        entry = np.cumsum(begins) - 1
        heads = rows.select(["file", "offset", "depth", "tag", "block", "pos"]).take(first).combine_chunks()
        out = {name: heads[name] for name in heads.column_names}
        kind = numbers(pc.index_in(rows["attribute"], value_set=pa.array(attributes)))
        raw = rows["raw"].combine_chunks()
        for number, name in enumerate(attributes):
            found = np.flatnonzero(kind == number)
            owner = entry[found]
            if (owner[1:] == owner[:-1]).any():
                # Given more than once: the greatest.
                best: dict[int, int] = {}
                for o, i in zip(owner.tolist(), found.tolist()):
                    if o not in best or raw[i].as_py() > raw[best[o]].as_py():
                        best[o] = i
                owner, found = np.array(list(best)), np.array(list(best.values()))
            # Typed where they are, then spread over the entries.
            typed = _typed(name, raw.take(pa.array(found)).to_pylist())
            index = np.full(len(first), -1)
            index[owner] = np.arange(len(found))
            out[COLUMNS[name][0]] = typed.take(pa.array(index, mask=index < 0))
        offset, depth = numbers(heads["offset"]), numbers(heads["depth"])
        marks = heads["offset"].is_valid().to_numpy()
        place = np.stack([codes(heads["file"]), numbers(heads["block"])])
        opens = np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]
        block_first = np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0))
        key = lambda i: (heads["file"][i].as_py(), heads["block"][i].as_py())
        known = above if key(0) == at else {}
        parent, has = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        last_of: dict[int, int] = {}
        for d in np.unique(depth[depth >= 0]).tolist():
            last = np.maximum.accumulate(np.where((depth == d) & marks, np.arange(len(first)), -1))
            looking = depth == d + 1
            here = looking & (last >= block_first)
            parent[here], has[here] = offset[last[here]], True
            if last[-1] >= block_first[-1]:
                last_of[d] = int(offset[last[-1]])
        for d, mark in known.items():
            early = (depth == d + 1) & (block_first == 0) & ~has
            parent[early], has[early] = mark, True
        above = {**(known if block_first[-1] == 0 else {}), **last_of}
        at = key(len(first) - 1)
        out["parent"] = pa.array(parent, mask=~has)
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.values()], names=list(out))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = int(np.flatnonzero(begun(rows))[-1])
        # The last entry may go on in the next batch.
        if last:
            yield built(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield built(held)


def entries(lines: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """One row per entry: file, offset, depth, tag, place, the attributes asked for and a parent in the same block.

    The lines are sorted once and read off in order; only what an entry prints
    beyond the end of its block is looked up for it. Every entry has its row,
    whichever attributes are read.
    """
    row = F.col("line")
    heads = row.startswith("0x") & row.rlike(ENTRY)
    wanted = ATTRIBUTE.replace(r"(\w+)", f"({'|'.join(attributes)})")
    read = lines.filter(heads | row.rlike(wanted)).select(
        "file",
        F.col("block").cast("long").alias("block"),
        F.col("pos").cast("long").alias("pos"),
        F.when(heads, _number(F.concat(F.lit("0x"), F.regexp_extract(row, ENTRY, 1)))).alias("offset"),
        F.when(heads, F.floor((F.length(F.regexp_extract(row, ENTRY, 2)) - 1) / 2).cast("int")).alias("depth"),
        F.when(heads, F.regexp_extract(row, ENTRY, 3)).alias("tag"),
        F.when(~heads, F.regexp_extract(row, ATTRIBUTE, 1)).alias("attribute"),
        F.when(~heads, F.regexp_extract(row, ATTRIBUTE, 2)).alias("raw"),
    )
    placed = read.repartition("file", "block").sortWithinPartitions("file", "block", "pos")
    schema = "file string, offset long, depth int, tag string, block long, pos long, "
    schema += ", ".join("{} {}".format(*COLUMNS[a]) for a in attributes) + ", parent long"
    wide = _with_rests(store(placed.mapInArrow(partial(_assembled, attributes=attributes), schema)), attributes)
    absent = {"string": F.lit(""), "boolean": F.lit(False)}
    return wide.select(
        "file", "offset", "depth", "tag", "block", "pos", "parent",
        *[F.coalesce(name, absent[kind]).alias(name) if kind in absent else name for name, kind in map(COLUMNS.get, attributes)],
    )


def _before(marks: DataFrame, by: tuple[str, ...], mark: str) -> DataFrame:
    """The latest ``mark`` of earlier blocks; ``marks`` has a row per ``by`` and block."""
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn(mark, F.last(mark, ignorenulls=True).over(earlier)).filter(F.col(mark).isNotNull())


def _with_rests(built: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Entries with what they print beyond the block they begin in; few do."""
    whole, rests = built.filter("tag IS NOT NULL"), built.filter("tag IS NULL")
    if rests.isEmpty():
        return whole
    names = [COLUMNS[a][0] for a in attributes]
    head = F.struct("offset", "depth", "tag", "block", "pos")
    last = built.groupBy("file", "block").agg(F.max_by(head, F.when(F.col("tag").isNotNull(), F.col("pos"))).alias("head"))
    owned = rests.select("file", "block", *names).join(_before(last, ("file",), "head"), ["file", "block"])
    keys = ["file", "offset", "depth", "tag", "block", "pos"]
    more = owned.select("file", "head.*", *[F.col(n).alias(f"more_{n}") for n in names]).groupBy(*keys).agg(
        *[F.max(f"more_{n}").alias(f"more_{n}") for n in names]
    )
    return whole.join(more, keys, "left").select(
        *keys, "parent", *[F.greatest(n, f"more_{n}").alias(n) for n in names]
    )


def with_parents(entry_rows: DataFrame) -> DataFrame:
    """Complete ``parent``: the offset of the entry each one is nested in.

    In dump order that is the last entry one level up. Where that is not in an
    entry's own block, the last ones of each block and level are asked. Those
    that are asked for are stored; entries are joined with them where they are
    read, by the columns that are read. Their file is far smaller than they are
    in memory, so it is by their number that they are sent to every task or not.
    """
    lost = F.col("parent").isNull() & (F.col("depth") > 0)
    asking = entry_rows.filter(lost).select(
        "file", (F.col("depth") - 1).alias("level"), "block", F.lit(None).cast("long").alias("mark"), F.lit(True).alias("asked")
    )
    ends = entry_rows.groupBy("file", F.col("depth").alias("level"), "block").agg(F.max_by("offset", F.when(F.col("offset").isNotNull(), F.col("pos"))).alias("mark"))
    marks = ends.withColumn("asked", F.lit(False)).unionByName(asking.distinct())
    marks = marks.groupBy("file", "level", "block").agg(F.max("mark").alias("mark"), F.max("asked").alias("asked"))
    carried = store(
        _before(marks, ("file", "level"), "mark").filter("asked").select("file", (F.col("level") + 1).alias("depth"), "block", F.col("mark").alias("parent"))
    )
    many = carried.count() > MOST_SENT
    found = entry_rows.filter(lost).drop("parent").join(carried.hint("merge") if many else carried, ["file", "depth", "block"], "left")
    return entry_rows.filter(~lost).unionByName(found)


def _named(dies: DataFrame) -> DataFrame:
    return dies.select("file", F.col("offset").alias("ref"), F.col("name").alias("ref_name"))


def scope_names(dies: DataFrame) -> DataFrame:
    """``(file, offset, scope_name)`` of subprograms and inlined bodies.

    A body without its own name takes that of the entry it is an instance of.
    """
    scopes = dies.filter(F.col("tag").isin("subprogram", "inlined_subroutine"))
    origin = scopes.join(
        _named(dies).withColumnRenamed("ref", "abstract_origin_ref"), ["file", "abstract_origin_ref"], "left"
    )
    own = F.when(F.col("tag") == "subprogram", F.nullif("name", F.lit("")))
    return origin.select(
        "file", "offset", "tag", F.coalesce(own, F.col("ref_name"), F.lit("")).alias("scope_name")
    )


def enclosing(dies: DataFrame, tag: str) -> DataFrame:
    """For entries of one tag: the physical function, innermost inlined body and nesting.

    Climbs one level per round, only for entries that have not met a function.
    Parents form a tree, so every entry arrives or leaves at the top.
    """
    # Names are looked up for what is met only; what is met is looked up among all entries.
    parents = dies.select("file", F.col("offset").alias("at"), "tag", "parent")
    names = store(scope_names(dies).select("file", F.col("offset").alias("at"), "scope_name"))
    climbing = dies.filter(F.col("tag") == tag).select(
        "file",
        "offset",
        F.col("parent").alias("at"),
        F.lit(None).cast("string").alias("inner"),
        F.lit(0).alias("inlined_levels"),
    )
    done: DataFrame | None = None
    while True:
        step = climbing.join(parents, ["file", "at"]).join(names, ["file", "at"], "left")
        is_body = F.col("tag") == "inlined_subroutine"
        step = store(
            step.select(
                "file",
                "offset",
                F.when(is_body & F.col("inner").isNull(), F.col("scope_name")).otherwise(F.col("inner")).alias("inner"),
                (F.col("inlined_levels") + is_body.cast("int")).alias("inlined_levels"),
                (F.col("tag") == "subprogram").alias("arrived"),
                F.when(F.col("tag") == "subprogram", F.col("scope_name")).alias("function"),
                F.when(F.col("tag") == "subprogram", F.col("at")).alias("function_offset"),
                F.col("parent").alias("at"),
            )
        )
        arrived = step.filter("arrived").drop("arrived", "at")
        done = arrived if done is None else done.unionByName(arrived)
        climbing = step.filter("NOT arrived").select("file", "offset", "at", "inner", "inlined_levels")
        if climbing.isEmpty():
            break
    return done


def _parameters(dies: DataFrame) -> DataFrame:
    """Parameters per owner with their position; the list is bounded by a declaration."""
    return dies.filter(F.col("tag").isin("formal_parameter", "unspecified_parameters")).select(
        "file", F.col("parent").alias("owner"), "tag", "name", "type_ref", F.struct("block", "pos").alias("place")
    )


def _parameter_list(texts: Column, variadic: Column, prototyped: Column) -> Column:
    """The three empty forms differ: no arguments, unknown arguments, anything."""
    joined = F.array_join(texts, ", ")
    empty = F.size(texts) == 0
    return (
        F.when(empty & ~prototyped, "()")
        .when(empty & variadic, "(...)")
        .when(empty, "(void)")
        .when(variadic, F.concat(F.lit("("), joined, F.lit(", ...)")))
        .otherwise(F.concat(F.lit("("), joined, F.lit(")")))
    )


def _callable_texts(owners: DataFrame, parameters: DataFrame, rendered: DataFrame) -> DataFrame:
    """``(file, offset, text, complete)`` for functions and function types.

    ``complete`` is false while a parameter or result type is not rendered yet.
    """
    known = rendered.select("file", F.col("offset").alias("type_ref"), "text")
    typed = parameters.join(known, ["file", "type_ref"], "left")
    is_parameter = F.col("tag") == "formal_parameter"
    text = F.when(F.col("type_ref").isNull(), "?").otherwise(
        F.when(F.col("text") == "", "?").otherwise(F.col("text"))
    )
    listed = typed.groupBy("file", F.col("owner").alias("offset")).agg(
        F.array_sort(
            F.collect_list(F.when(is_parameter, F.struct("place", F.coalesce(text, F.lit("?")).alias("text"))))
        ).alias("parameters"),
        F.bool_or(~is_parameter).alias("variadic"),
        F.bool_and(~is_parameter | F.col("type_ref").isNull() | F.col("text").isNotNull()).alias("ready"),
    )
    result = rendered.select("file", F.col("offset").alias("type_ref"), F.col("text").alias("result"))
    rows = owners.join(listed, ["file", "offset"], "left").join(result, ["file", "type_ref"], "left")
    texts = F.coalesce(F.transform("parameters", lambda p: p["text"]), F.array().cast("array<string>"))
    body = _parameter_list(texts, F.coalesce("variadic", F.lit(False)), F.col("prototyped"))
    returned = F.when(F.col("type_ref").isNull(), "void").otherwise(F.coalesce("result", F.lit("")))
    return rows.select(
        "file",
        "offset",
        F.concat(returned, F.lit(" "), body).alias("text"),
        (F.coalesce("ready", F.lit(True)) & (F.col("type_ref").isNull() | F.col("result").isNotNull())).alias("complete"),
    )


def _pointer_text(inner: Column) -> Column:
    paren = F.instr(inner, "(")
    spliced = F.concat(F.substring(inner, F.lit(1), paren - 1), F.lit("(*)"), F.substring(inner, paren, F.lit(1 << 20)))
    return (
        F.when(inner == "", "void *")
        .when(inner.endswith(")") & (paren > 1), spliced)
        .when(inner.endswith("*"), F.concat(inner, F.lit("*")))
        .otherwise(F.concat(inner, F.lit(" *")))
    )


def render_types(dies: DataFrame) -> DataFrame:
    """``(file, offset, text)`` of every type entry, in C notation.

    Named types render on their own; pointers, qualifiers, arrays and function
    types render once what they refer to has, one level per round.
    """
    types = cut_lineage(
        dies.filter(F.col("tag").endswith("_type") | (F.col("tag") == "typedef")).select(
            "file", "offset", "tag", "name", "type_ref", "prototyped"
        )
    )
    # Of the parameters only those of function types are rendered here.
    owners = types.filter(F.col("tag") == "subroutine_type").select("file", F.col("offset").alias("owner"))
    parameters = store(_parameters(dies).join(owners, ["file", "owner"], "left_semi"))
    tag, name = F.col("tag"), F.col("name")
    tag_word = F.create_map(*[F.lit(x) for pair in TAGGED.items() for x in pair])
    modifiers = ("pointer_type", "const_type", "volatile_type", "array_type")
    leaf = (
        F.when(tag.isin(*TAGGED), F.trim(F.concat_ws(" ", tag_word[tag], name)))
        .when((tag == "pointer_type") & F.col("type_ref").isNull(), "void *")
        .when((tag == "const_type") & F.col("type_ref").isNull(), "const")
        .when((tag == "volatile_type") & F.col("type_ref").isNull(), "volatile")
        .when((tag == "array_type") & F.col("type_ref").isNull(), "[]")
        .when(~tag.isin(*modifiers, "subroutine_type"), name)
    )
    started = types.withColumn("text", leaf)
    rendered = cut_lineage(started.filter(F.col("text").isNotNull()).select("file", "offset", "text"))
    waiting = cut_lineage(started.filter(F.col("text").isNull()).drop("text"))
    while not waiting.isEmpty():
        inner = rendered.select("file", F.col("offset").alias("type_ref"), F.col("text").alias("inner"))
        plain = waiting.filter(tag != "subroutine_type").join(inner, ["file", "type_ref"])
        text = (
            F.when(tag == "pointer_type", _pointer_text(F.col("inner")))
            .when(tag == "const_type", F.concat(F.lit("const "), F.col("inner")))
            .when(tag == "volatile_type", F.concat(F.lit("volatile "), F.col("inner")))
            .otherwise(F.concat("inner", F.lit("[]")))
        )
        calls = _callable_texts(
            waiting.filter(tag == "subroutine_type").select("file", "offset", "type_ref", "prototyped"),
            parameters,
            rendered,
        ).filter("complete")
        fresh = cut_lineage(
            plain.select("file", "offset", text.alias("text")).unionByName(calls.drop("complete"))
        )
        if fresh.isEmpty():
            break
        rendered = rendered.unionByName(fresh)
        waiting = cut_lineage(waiting.join(fresh.select("file", "offset"), ["file", "offset"], "left_anti"))
    # What only refers to itself has no text.
    return rendered.unionByName(waiting.select("file", "offset", F.lit("").alias("text")))


def subprograms(dies: DataFrame, rendered: DataFrame) -> DataFrame:
    functions = dies.filter(F.col("tag") == "subprogram")
    texts = _callable_texts(
        functions.select("file", "offset", "type_ref", "prototyped"), _parameters(dies), rendered
    ).select("file", "offset", F.col("text").alias("signature"))
    abstract = F.col("has_inline") & ~F.col("declaration")
    return functions.join(texts, ["file", "offset"]).select(
        "file",
        F.col("offset").alias("ordinal"),
        "name",
        "linkage_name",
        "decl_file",
        F.coalesce("decl_line", F.lit(0)).cast("int").alias("decl_line"),
        "signature",
        (F.col("has_low_pc") | abstract).alias("definition"),
        "declaration",
        "external",
        abstract.alias("abstract_inline"),
    )


def inline_instances(dies: DataFrame) -> DataFrame:
    """Bodies copied into a function: callee, host, parent body and nesting depth."""
    around = enclosing(dies, "inlined_subroutine")
    callee = scope_names(dies).filter(F.col("tag") == "inlined_subroutine")
    return (
        dies.filter(F.col("tag") == "inlined_subroutine")
        .select("file", "offset", "call_file", "call_line", "call_column")
        .join(callee.select("file", "offset", F.col("scope_name").alias("callee")), ["file", "offset"])
        .join(around, ["file", "offset"])
        .filter((F.col("callee") != "") & (F.col("function") != ""))
        .select(
            "file",
            F.col("offset").alias("ordinal"),
            "callee",
            F.col("function").alias("caller"),
            F.coalesce("inner", F.lit("")).alias("parent_callee"),
            (F.col("inlined_levels") + 1).alias("depth"),
            F.col("call_file").alias("site_file"),
            F.coalesce("call_line", F.lit(0)).cast("int").alias("line"),
            F.coalesce("call_column", F.lit(0)).cast("int").alias("column"),
        )
    )


def line_at(addresses: DataFrame, line_rows: DataFrame) -> DataFrame:
    """As-of lookup: the line-table row in force at each address.

    ``addresses``: file, address, plus any columns; ``line_rows``: file,
    address, line, column, source. Both sides are cut into address blocks, so
    one object's table is not one task's work.
    """
    def placed(df: DataFrame, late: int, mark: Column) -> DataFrame:
        return df.withColumns(
            {
                "block": F.floor(F.col("address") / 4096).cast("long"),
                "pos": F.col("address") * 2 + late,
                "mark": mark,
            }
        )

    table = placed(line_rows, 0, F.struct("source", "line", "column")).select("file", "block", "pos", "mark")
    asked = placed(addresses, 1, F.lit(None).cast(table.schema["mark"].dataType))
    rows = asked.withColumn("asked", F.lit(True)).unionByName(table, allowMissingColumns=True)
    found = carry_forward(rows, {"at": F.col("mark")}).filter("asked")
    return found.drop("block", "pos", "mark", "asked")


def call_sites(dies: DataFrame, line_rows: DataFrame | None = None) -> DataFrame:
    """Call sites with their source-level caller and position.

    A site without a position of its own takes the line in force one byte
    before the address it returns to.
    """
    around = enclosing(dies, "call_site")
    sites = dies.filter(F.col("tag") == "call_site").join(around, ["file", "offset"], "left")
    rows = sites.select(
        "file",
        F.col("offset").alias("ordinal"),
        F.coalesce(F.nullif("inner", F.lit("")), F.col("function"), F.lit("")).alias("caller"),
        F.coalesce("function", F.lit("")).alias("function"),
        "function_offset",
        F.col("call_file").alias("site_file"),
        F.coalesce("call_line", F.lit(0)).cast("int").alias("line"),
        F.coalesce("call_column", F.lit(0)).cast("int").alias("column"),
        F.coalesce("call_return_pc", F.lit(0)).alias("return_pc"),
        "call_target",
        F.col("call_origin_ref").isNull().alias("indirect"),
    )
    if line_rows is not None:
        at = line_at(rows.withColumn("address", F.col("return_pc") - 1), line_rows)
        missing = ((F.col("site_file") == "") | (F.col("line") == 0)) & (F.col("return_pc") > 0) & F.col("at").isNotNull()
        rows = at.select(
            *[c for c in rows.columns if c not in ("site_file", "line", "column")],
            F.when(missing, F.col("at.source")).otherwise(F.col("site_file")).alias("site_file"),
            F.when(missing, F.col("at.line")).otherwise(F.col("line")).alias("line"),
            F.when(missing, F.col("at.column")).otherwise(F.col("column")).alias("column"),
        )
    return rows.filter((F.col("site_file") != "") | (F.col("line") != 0))


def stripped_types(dies: DataFrame) -> DataFrame:
    """``(file, offset, base)``: each type with qualifiers and typedefs taken off."""
    types = cut_lineage(
        dies.filter(F.col("tag").endswith("_type") | (F.col("tag") == "typedef")).select(
            "file", "offset", "tag", "type_ref"
        )
    )
    through = F.col("tag").isin(*QUALIFIERS) & F.col("type_ref").isNotNull()
    ends = types.filter(~through).select("file", "offset")
    jumps = cut_lineage(types.filter(through).select("file", "offset", F.col("type_ref").alias("at")))
    # Every round doubles the distance, so what has not arrived after as many rounds as the count has
    # binary digits goes round in a circle and has no base.
    for _ in range(jumps.count().bit_length() + 1):
        onward = jumps.select("file", F.col("offset").alias("at"), F.col("at").alias("next"))
        jumps = cut_lineage(
            jumps.join(onward, ["file", "at"], "left").select("file", "offset", F.coalesce("next", "at").alias("at"))
        )
    arrived = jumps.join(ends.withColumnRenamed("offset", "at"), ["file", "at"], "left_semi")
    return ends.withColumn("base", F.col("offset")).unionByName(arrived.withColumnRenamed("at", "base"))


def function_pointers(dies: DataFrame, rendered: DataFrame, stripped: DataFrame) -> DataFrame:
    """``(file, offset, callee_type)`` for types that are pointers to functions."""
    base = dies.select("file", F.col("offset").alias("base"), "tag", "type_ref")
    pointers = stripped.join(base, ["file", "base"]).filter(
        (F.col("tag") == "pointer_type") & F.col("type_ref").isNotNull()
    )
    pointee = stripped.select("file", F.col("offset").alias("type_ref"), F.col("base").alias("function_type"))
    functions = dies.filter(F.col("tag") == "subroutine_type").select("file", F.col("offset").alias("function_type"))
    texts = rendered.select("file", F.col("offset").alias("function_type"), F.col("text").alias("callee_type"))
    return (
        pointers.join(pointee, ["file", "type_ref"])
        .join(functions, ["file", "function_type"])
        .join(texts, ["file", "function_type"])
        .filter(F.contains("callee_type", F.lit("(")))
        .select("file", "offset", "callee_type")
    )


def register_of(expression: Column) -> Column:
    """Register a call target lives in, if the expression is just that register."""
    wrapped = r"^(?:DW_OP_entry_value\(|DW_OP_GNU_entry_value\()?{}(?: \w+)?\)?$"
    short = F.regexp_extract(expression, wrapped.format(r"DW_OP_reg(\d+)"), 1)
    extended = F.regexp_extract(expression, wrapped.format(r"DW_OP_regx (0x[0-9a-fA-F]+|\d+)"), 1)
    return F.coalesce(_number(short), _number(extended)).cast("int")


def argument_targets(sites: DataFrame, dies: DataFrame, stripped: DataFrame, pointers: DataFrame) -> DataFrame:
    """Calls through a function-pointer parameter: ``(file, ordinal, callee_type, field_hint)``.

    The register names a parameter only while every parameter before it also
    takes one integer register; a function returning an aggregate shifts them
    all and is left out.
    """
    base = stripped.join(
        dies.select("file", F.col("offset").alias("base"), F.col("tag").alias("base_tag"), "encoding", "byte_size"),
        ["file", "base"],
    ).select("file", F.col("offset").alias("type_ref"), "base_tag", "encoding", "byte_size")
    parameters = _parameters(dies).filter(F.col("tag") == "formal_parameter").join(base, ["file", "type_ref"], "left")
    takes_register = F.col("base_tag").isin("pointer_type", "enumeration_type") | (
        (F.col("base_tag") == "base_type")
        & F.col("encoding").isin(*INTEGER_ENCODINGS)
        & (F.col("byte_size") <= 8)
    )
    item = F.struct(
        "place", F.coalesce(takes_register, F.lit(False)).alias("fits"), "name", "type_ref"
    )
    # A parameter list is bounded by its declaration.
    per_function = parameters.groupBy("file", F.col("owner").alias("function_offset")).agg(
        F.array_sort(F.collect_list(item)).alias("parameters")
    )
    returns = dies.filter(F.col("tag") == "subprogram").select("file", F.col("offset").alias("function_offset"), "type_ref")
    aggregate = returns.join(base, ["file", "type_ref"]).filter(F.col("base_tag").isin(*AGGREGATES))
    position = F.array_position(F.array(*[F.lit(r) for r in ARGUMENT_REGISTERS]), register_of(F.col("call_target")))
    asked = (
        sites.filter(F.col("indirect") & (F.col("call_target") != ""))
        .withColumn("position", position)
        .filter(F.col("position") > 0)
        .join(aggregate.select("file", "function_offset"), ["file", "function_offset"], "left_anti")
        .join(per_function, ["file", "function_offset"])
    )
    leading = F.slice("parameters", F.lit(1), F.col("position").cast("int"))
    replayed = asked.filter(
        (F.size(leading) == F.col("position")) & F.forall(leading, lambda p: p["fits"])
    ).select("file", "ordinal", F.try_element_at(leading, F.lit(-1)).alias("p"))
    return replayed.select("file", "ordinal", F.col("p.type_ref").alias("offset"), F.col("p.name").alias("field_hint")).join(
        pointers, ["file", "offset"]
    ).select("file", "ordinal", "callee_type", "field_hint")


def relocation_targets(
    sites: DataFrame, dies: DataFrame, stripped: DataFrame, pointers: DataFrame,
    function_symbols: DataFrame, relocations: DataFrame,
) -> DataFrame:
    """Calls through memory: the relocation on the instruction names variable and member.

    ``function_symbols``: file, name, section, value, size. ``relocations``:
    file, section, address, symbol, addend. The displacement is the last four
    bytes of the instruction and counts from its end.
    """
    homes = function_symbols.groupBy("file", F.col("name").alias("function")).agg(
        F.min(F.struct("section", "value", "size")).alias("home")
    )
    located = sites.filter(F.col("indirect") & (F.col("return_pc") >= 4)).join(homes, ["file", "function"]).filter(
        F.col("return_pc").between(F.col("home.value"), F.col("home.value") + F.col("home.size"))
    )
    reloc = located.select(
        "file", "ordinal", F.col("home.section").alias("section"), (F.col("return_pc") - 4).alias("address")
    ).join(relocations, ["file", "section", "address"])
    variables = (
        dies.filter((F.col("tag") == "variable") & (F.col("depth") <= 1) & (F.col("name") != "") & F.col("type_ref").isNotNull())
        .groupBy("file", F.col("name").alias("symbol"))
        .agg(F.max_by("type_ref", "offset").alias("type_ref"))
    )
    aimed = reloc.join(variables, ["file", "symbol"]).join(
        stripped.select("file", F.col("offset").alias("type_ref"), "base"), ["file", "type_ref"]
    ).withColumn("at", F.col("addend") + 4)
    direct = (
        aimed.filter(F.col("at") == 0)
        .withColumnRenamed("base", "offset")
        .join(pointers, ["file", "offset"])
        .select("file", "ordinal", "callee_type", F.col("symbol").alias("field_hint"))
    )
    records = dies.filter(F.col("tag").isin(*RECORD_TAGS)).select("file", F.col("offset").alias("base"), F.col("name").alias("record"))
    members = (
        dies.filter((F.col("tag") == "member") & (F.col("name") != ""))
        .groupBy("file", F.col("parent").alias("base"), F.coalesce("data_member_location", F.lit(0)).alias("at"))
        .agg(F.min(F.struct("block", "pos", "name", "type_ref")).alias("m"))
    )
    through = (
        aimed.join(records, ["file", "base"])
        .join(members, ["file", "base", "at"])
        .withColumn("offset", F.col("m.type_ref"))
        .join(pointers, ["file", "offset"])
        .select(
            "file", "ordinal", "callee_type",
            F.concat(F.coalesce(F.nullif("record", F.lit("")), F.col("symbol")), F.lit("."), F.col("m.name")).alias("field_hint"),
        )
    )
    return direct.unionByName(through)


def with_targets(sites: DataFrame, by_argument: DataFrame, by_relocation: DataFrame) -> DataFrame:
    """Indirect sites with callee type and hint, empty where nothing typed was found."""
    first = by_argument.select("file", "ordinal", F.col("callee_type").alias("a_type"), F.col("field_hint").alias("a_hint"))
    second = (
        by_relocation.groupBy("file", "ordinal")
        .agg(F.min(F.struct("callee_type", "field_hint")).alias("r"))
    )
    return (
        sites.join(first, ["file", "ordinal"], "left")
        .join(second, ["file", "ordinal"], "left")
        .withColumn("callee_type", F.coalesce("a_type", "r.callee_type", F.lit("")))
        .withColumn("field_hint", F.when(F.col("a_type").isNotNull(), F.col("a_hint")).otherwise(F.coalesce("r.field_hint", F.lit(""))))
        .drop("a_type", "a_hint", "r")
    )


def type_records(dies: DataFrame, rendered: DataFrame) -> DataFrame:
    """Structs, unions, typedefs and enums; records nested in a record are part of it."""
    outer = dies.filter(F.col("tag").isin(*RECORD_TAGS)).select("file", F.col("offset").alias("parent")).withColumn("inside", F.lit(True))
    texts = rendered.select("file", F.col("offset").alias("type_ref"), F.col("text").alias("underlying"))
    kind = F.create_map(*[F.lit(x) for pair in {**TAGGED, "typedef": "typedef"}.items() for x in pair])[F.col("tag")]
    rows = dies.filter(F.col("tag").isin(*TAGGED, "typedef")).join(outer, ["file", "parent"], "left").filter(F.col("inside").isNull())
    return rows.join(texts, ["file", "type_ref"], "left").select(
        "file",
        F.col("offset").alias("type_offset"),
        F.col("offset").alias("ordinal"),
        "name",
        kind.alias("kind"),
        "decl_file",
        F.coalesce("decl_line", F.lit(0)).cast("int").alias("decl_line"),
        F.when(F.col("tag") == "typedef", 0).otherwise(F.coalesce("decl_column", F.lit(0))).cast("int").alias("decl_column"),
        F.when(F.col("tag") == "typedef", 0).otherwise(F.coalesce("byte_size", F.lit(0))).cast("int").alias("byte_size"),
        F.when(F.col("tag") == "typedef", F.coalesce("underlying", F.lit(""))).otherwise("").alias("underlying"),
    )


def record_fields(dies: DataFrame, rendered: DataFrame) -> DataFrame:
    """``(file, type_offset, name, type, place, byte_offset)``, place ordering a record's members."""
    texts = rendered.select("file", F.col("offset").alias("type_ref"), F.col("text").alias("type"))
    # Stored, so that their size is known before the members would be shuffled to meet them.
    owners = store(dies.filter(F.col("tag").isin(*RECORD_TAGS)).select("file", F.col("offset").alias("parent")))
    return (
        dies.filter(F.col("tag") == "member")
        .join(owners, ["file", "parent"], "left_semi")
        .join(texts, ["file", "type_ref"], "left")
        .select(
            "file",
            F.col("parent").alias("type_offset"),
            "name",
            F.coalesce("type", F.lit("")).alias("type"),
            F.col("offset").alias("place"),
            F.coalesce("data_member_location", F.lit(0)).cast("int").alias("byte_offset"),
        )
    )


def enum_constants(dies: DataFrame) -> DataFrame:
    return dies.filter((F.col("tag") == "enumerator") & (F.col("name") != "")).select(
        "file",
        F.col("parent").alias("type_offset"),
        F.col("offset").alias("ordinal"),
        "name",
        F.coalesce("const_value", F.lit(0)).alias("value"),
    )


def units(dies: DataFrame) -> DataFrame:
    """``(file, path)`` of each dump's source, joined to its compilation directory."""
    path = F.when(F.col("name").startswith("/") | (F.col("comp_dir") == ""), F.col("name")).otherwise(
        F.concat_ws("/", "comp_dir", "name")
    )
    return (
        dies.filter(F.col("tag") == "compile_unit")
        .groupBy("file")
        .agg(F.max_by(path, "offset").alias("path"))
    )

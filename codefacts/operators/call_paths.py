"""Bounded enumeration of simple call paths.

Whole paths order by their sequence of names (then identities), which is the
order a depth-first walk visiting callees by name would give, so a page of the
first n is well defined.

A page is found from both ends: calls are followed forward from the start for
half of the hops and backward from the destination for the others, by lookups of
the frontier in the edges sorted by that end. A node of a path lies in one of
the two neighbourhoods, so the edges met hold every path. Those that are on no
walk of the allowed length are dropped by their layers, the distances from both
ends, and the first paths are read off the layered edges in order.

Where the neighbourhoods are too large for that, and for the list of all paths,
partial paths grow one join per hop over the edges that still lead on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import text
from codefacts.operators import common
from codefacts.session import cut_lineage

#: Edges of both neighbourhoods that are read off at once.
MOST_EDGES = 200_000

# Hop bound used when none is given, and the greatest that can be.
DEFAULT_DEPTH = 6
GREATEST_DEPTH = 16


def depth_bound(max_depth: int | None) -> int:
    if max_depth is None:
        return DEFAULT_DEPTH
    if not 1 <= max_depth <= GREATEST_DEPTH:
        raise ValueError(f"a path has between 1 and {GREATEST_DEPTH} calls, not {max_depth}")
    return max_depth


def _edges(facts: Facts, target: str | None, end: str = "caller_usr") -> DataFrame:
    """Calls of the source view, from the copy sorted by ``end``; ``target`` keeps calls between symbols linked into it."""
    edges = facts.by("call_edges", end).filter(F.col("source") == common.CGRAPH).select("caller_usr", "callee_usr")
    if target is not None:
        edges = common.in_target(edges, facts, target, "caller_usr")
        edges = common.in_target(edges, facts, target, "callee_usr")
    return edges


def _neighbourhood(facts: Facts, usr: str, end: str, hops: int, target: str | None, most: int) -> set[tuple[str, str]] | None:
    """Calls met on the way of up to ``hops`` calls from ``usr``, its side of a call being ``end``; None if they are too many."""
    met: set[tuple[str, str]] = set()
    seen, frontier = {usr}, {usr}
    edges = _edges(facts, target, end)
    for _ in range(hops):
        if not frontier:
            break
        names = sorted(frontier)
        if len(names) <= text.MOST_NAMED:
            step = edges.filter(text.any_of(end, names))
        else:
            asked = facts.spark.createDataFrame([(n,) for n in names], f"{end} string")
            step = edges.join(F.broadcast(asked), end, "left_semi")
        step = step.distinct()
        # Counted first: a limited collect takes up to the limit from every task.
        if step.count() > most - len(met):
            return None
        met |= {(r["caller_usr"], r["callee_usr"]) for r in step.collect()}
        far = 1 if end == "caller_usr" else 0
        frontier = {e[far] for e in met} - seen
        seen |= frontier
    return met


def _layers(edges: dict[str, set[str]], start: str) -> dict[str, int]:
    """Fewest steps from ``start`` along ``edges``."""
    found, frontier, hop = {start: 0}, [start], 0
    while frontier:
        hop += 1
        frontier = list({n for f in frontier for n in edges.get(f, ()) if n not in found})
        found.update(dict.fromkeys(frontier, hop))
    return found


def _read_off(facts: Facts, met: set[tuple[str, str]], from_usr: str, to_usr: str, depth: int, limit: int) -> list[tuple[list[str], list[str], int]]:
    """The first ``limit`` simple paths of the calls ``met``, in order."""
    out, back = {}, {}
    for a, b in met:
        # a path neither returns to its start nor leaves its end
        if b != from_usr and a != to_usr:
            out.setdefault(a, set()).add(b)
            back.setdefault(b, set()).add(a)
    ahead, behind = _layers(back, to_usr), _layers(out, from_usr)
    useful = {
        a: [b for b in bs if a in behind and b in ahead and behind[a] + 1 + ahead[b] <= depth] for a, bs in out.items()
    }
    nodes = sorted({from_usr, to_usr} | {n for a, bs in useful.items() if bs for n in (a, *bs)})
    symbols = facts.symbols.select("usr", "name")
    if len(nodes) <= text.MOST_NAMED:
        symbols = symbols.filter(text.any_of("usr", nodes))
    else:
        symbols = symbols.join(F.broadcast(facts.spark.createDataFrame([(n,) for n in nodes], "usr string")), "usr", "left_semi")
    names = {r["usr"]: r["name"] for r in symbols.collect()}
    if from_usr not in names:
        return []
    page: list[tuple[list[str], list[str], int]] = []
    # Partial paths of one sequence of names go on together, the least sequence first.
    left = [([names[from_usr]], [[from_usr]])]
    while left and len(page) < limit:
        told, partial = left.pop()
        page += sorted((told, p, len(p) - 1) for p in partial if p[-1] == to_usr)
        following: dict[str, list[list[str]]] = {}
        for p in partial:
            for b in useful.get(p[-1], ()):
                if b in names and b not in p and len(p) + ahead[b] <= depth:
                    following.setdefault(names[b], []).append([*p, b])
        left += [([*told, n], following[n]) for n in sorted(following, reverse=True)]
    return page[:limit]


def distances_to(facts: Facts, to_usr: str, depth: int, target: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``(usr, hops)``: fewest calls from each symbol to ``to_usr``, up to ``depth``; ``edges`` if they are at hand."""
    frontier = facts.spark.createDataFrame([(to_usr, 0)], "usr string, hops int")
    reached, edges = frontier, _edges(facts, target, "callee_usr") if edges is None else edges
    for hop in range(1, depth + 1):
        step = (
            edges.join(frontier.select(F.col("usr").alias("callee_usr")), "callee_usr", "left_semi")
            .select(F.col("caller_usr").alias("usr"))
            .distinct()
            .join(reached, "usr", "left_anti")
            .select("usr", F.lit(hop).alias("hops"))
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


@dataclass
class _Search:
    """What both enumerations share: the start, and edges that lead on."""

    start: DataFrame
    useful: DataFrame
    to_usr: str
    depth: int

    @classmethod
    def prepare(cls, facts: Facts, from_usr: str, to_usr: str, depth: int, target: str | None) -> "_Search":
        start = facts.symbols.filter(F.col("usr") == from_usr).select(
            F.array("usr").alias("usrs"), F.array("name").alias("names"), F.col("usr").alias("tip")
        )
        # Every hop asks the calls again: they are resolved once.
        edges = cut_lineage(_edges(facts, target, "callee_usr"))
        # The first call is spent before the distance of its callee counts.
        hops_left = distances_to(facts, to_usr, depth - 1, target, edges)
        names = facts.symbols.select(F.col("usr").alias("callee_usr"), F.col("name").alias("callee_name"))
        # Only edges towards the destination, with the hops still needed after them.
        useful = (
            edges.join(hops_left.select(F.col("usr").alias("callee_usr"), "hops"), "callee_usr")
            .distinct()
            .join(names, "callee_usr")
        )
        return cls(start, cut_lineage(useful), to_usr, depth)

    def grow(self, partial: DataFrame, hop: int) -> DataFrame:
        """Every partial path extended by one call, none twice through a symbol."""
        return cut_lineage(
            partial.join(self.useful, partial["tip"] == self.useful["caller_usr"])
            .filter((F.col("hops") <= self.depth - hop) & ~F.array_contains("usrs", F.col("callee_usr")))
            .select(
                F.concat("usrs", F.array("callee_usr")).alias("usrs"),
                F.concat("names", F.array("callee_name")).alias("names"),
                F.col("callee_usr").alias("tip"),
            )
        )


def list_call_paths(
    facts: Facts,
    from_usr: str,
    to_usr: str,
    max_depth: int | None = None,
    target: str | None = None,
) -> DataFrame:
    """Every simple path, as ``(usrs, names, hops)``."""
    depth = depth_bound(max_depth)
    if from_usr == to_usr:
        return _trivial(facts, from_usr)
    search = _Search.prepare(facts, from_usr, to_usr, depth, target)
    partial, found = search.start, None
    for hop in range(1, depth + 1):
        grown = search.grow(partial, hop)
        whole = grown.filter(F.col("tip") == to_usr).select("usrs", "names", F.lit(hop).alias("hops"))
        found = whole if found is None else found.unionByName(whole)
        partial = grown.filter(F.col("tip") != to_usr)
        if hop < depth and partial.isEmpty():
            break
    return found


def _trivial(facts: Facts, usr: str) -> DataFrame:
    return facts.symbols.filter(F.col("usr") == usr).select(
        F.array("usr").alias("usrs"), F.array("name").alias("names"), F.lit(0).alias("hops")
    )


def first_call_paths(
    facts: Facts,
    from_usr: str,
    to_usr: str,
    max_depth: int | None = None,
    target: str | None = None,
    limit: int = common.PAGE["call_paths"],
    width: int = 100_000,
    most_edges: int = MOST_EDGES,
) -> DataFrame:
    """The first ``limit`` simple paths in name order, without listing the others.

    Up to ``most_edges`` calls around both ends are read off at once. Beyond
    that partial paths grow by joins; where a hop gives more than ``width`` of
    them, those first in order go on and the rest is put aside. Work put aside is taken up again, least
    first, until no partial path left can precede the page that was found, so
    the page is exact either way.
    """
    if from_usr == to_usr:
        return _trivial(facts, from_usr)
    depth = depth_bound(max_depth)
    forward = _neighbourhood(facts, from_usr, "caller_usr", (depth + 1) // 2, target, most_edges)
    backward = forward is not None and _neighbourhood(facts, to_usr, "callee_usr", depth // 2, target, most_edges)
    if forward is not None and backward is not None:
        page = _read_off(facts, forward | backward, from_usr, to_usr, depth, limit)
        return _paths(facts, page)
    search = _Search.prepare(facts, from_usr, to_usr, depth, target)
    # Pages are bounded by the limit, so they may meet on the driver.
    page = []
    waiting: list[tuple[list[str], int, DataFrame]] = [([], 1, search.start)]
    while waiting:
        least = min(range(len(waiting)), key=lambda i: waiting[i][0])
        if len(page) >= limit and page[limit - 1][0] < waiting[least][0]:
            break
        _, hop, partial = waiting.pop(least)
        grown = search.grow(partial, hop)
        whole = grown.filter(F.col("tip") == to_usr).orderBy("names", "usrs").limit(limit).collect()
        page = sorted([*page, *((list(r["names"]), list(r["usrs"]), hop) for r in whole)])[:limit]
        if hop == search.depth:
            continue
        rest = grown.filter(F.col("tip") != to_usr)
        seen = rest.agg(F.count(F.lit(1)).alias("n"), F.min("names").alias("least")).first()
        if seen["n"] > width:
            # Paths that share their names stay together, so the cut is between names.
            border = rest.orderBy("names").limit(width).agg(F.max("names")).first()[0]
            edge = F.array(*[F.lit(n) for n in border])
            later = rest.filter(F.col("names") > edge)
            first_later = later.agg(F.min("names")).first()[0]
            if first_later is not None:
                waiting.append((list(first_later), hop + 1, later))
                rest = rest.filter(F.col("names") <= edge)
        if seen["n"]:
            waiting.append((list(seen["least"]), hop + 1, rest))
    return _paths(facts, page)


def _paths(facts: Facts, page: list[tuple[list[str], list[str], int]]) -> DataFrame:
    return facts.spark.createDataFrame(
        [(usrs, names, hops) for names, usrs, hops in page], "usrs array<string>, names array<string>, hops int"
    )


def ordered(paths: DataFrame) -> DataFrame:
    return paths.orderBy("names", "usrs")

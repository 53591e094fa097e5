"""Secret scan by learned format automata.

Fixed patterns find the base spans. Their values, labelled by kind, and plain
tokens of the corpus, labelled as harmless, are each read into a prefix tree
over character classes; statistically compatible states are merged into a
probabilistic automaton. Every other token of every text is then scored by how
much likelier the credential automata make its format than the harmless one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log, sqrt
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, bounded_sample, require, with_fields

# The base patterns, in the order in which ties are listed, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
ASSIGN_WORDS = re.compile(r"(?i:pass|secret|token|api)", re.ASCII)

#: What can be a credential: every run of the characters that credentials are made of.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: The automata are inferred from at most so many values per label, chosen by a hash.
MAX_LABELLED = 4000
#: Significance of the merging test (a smaller value merges more).
ALPHA = 0.05
#: States with fewer arrivals than this are not split off; they fall back to their label's class frequencies.
LEAST_ARRIVALS = 8
#: A candidate of any length is reported when its format is likelier by this many nats per character and by so many in
#: all: hardly any token is a credential, and a few letters ("de") say too little to outweigh that.
MARGIN = 0.6
EVIDENCE = 12.6
#: Formats whose margin a worker remembers.
REMEMBERED = 200_000

# Character classes: hexadecimal digits and letters apart, so that hex, base64 and words differ in format.
_CLASSES = {c: "d" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
_CLASSES |= {c: "H" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: "s" for c in "+/="} | {c: "_" for c in "_-."}
SYMBOLS = "dhlHUs_"
_TO_CLASS = str.maketrans(_CLASSES)
END = "$"


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: per state, log-probabilities of symbols and the next state."""

    moves: list[dict[str, tuple[int, float]]]
    fallback: dict[str, float] = field(default_factory=dict)

    def score(self, value: str) -> float:
        """Log-likelihood of the value's format, its end included."""
        state, total = 0, 0.0
        for symbol in value.translate(_TO_CLASS) + END:
            move = self.moves[state].get(symbol) if state >= 0 else None
            if move is None:
                state, step = -1, self.fallback.get(symbol, self.fallback[END])
            else:
                state, step = move
            total += step
        return total


def _differs(k1: int, n1: int, k2: int, n2: int, bound: float) -> bool:
    """Hoeffding's test: the two shares differ by more than chance."""
    return abs(k1 / n1 - k2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))


def infer(values: Iterable[tuple[str, int]], alpha: float = ALPHA) -> Automaton:
    """Merge the states of the values' prefix tree, in order of depth, where their futures are compatible.

    ``values`` are formats (strings of character classes) with counts. No value gives the uniform automaton.
    """
    arrive, child, moved, end = [0], [{}], [defaultdict(int)], [0]
    overall: dict[str, int] = defaultdict(int)
    for text, count in values:
        at = 0
        arrive[0] += count
        for symbol in text:
            overall[symbol] += count
            if symbol not in child[at]:
                child[at][symbol] = len(child)
                child.append({})
                moved.append(defaultdict(int))
                arrive.append(0)
                end.append(0)
            moved[at][symbol] += count
            at = child[at][symbol]
            arrive[at] += count
        end[at] += count
        overall[END] += count
    total = sum(overall.values()) + len(SYMBOLS) + 1
    fallback = {s: log((overall[s] + 1) / total) for s in (*SYMBOLS, END)}
    bound = sqrt(0.5 * log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if arrive[a] < LEAST_ARRIVALS or arrive[b] < LEAST_ARRIVALS:
                continue
            if _differs(end[a], arrive[a], end[b], arrive[b], bound):
                return False
            for s in child[a].keys() | child[b].keys():
                x, y = child[a].get(s), child[b].get(s)
                if _differs(moved[a].get(s, 0), arrive[a], moved[b].get(s, 0), arrive[b], bound):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def fold(into: int, other: int) -> None:
        """Add a tree-shaped state and all below it to a state."""
        todo = [(into, other)]
        while todo:
            a, b = todo.pop()
            arrive[a] += arrive[b]
            end[a] += end[b]
            for s, y in child[b].items():
                moved[a][s] += moved[b][s]
                if s in child[a]:
                    todo.append((child[a][s], y))
                else:
                    child[a][s] = y

    kept, known, passed = [0], {0}, set()
    while True:
        # the next state that hangs on a kept one; folding may hang new ones on any
        edge = next(((k, s) for k in kept for s in sorted(child[k]) if child[k][s] not in known and child[k][s] not in passed), None)
        if edge is None:
            break
        at, symbol = edge
        state = child[at][symbol]
        if arrive[state] < LEAST_ARRIVALS:
            passed.add(state)
            continue
        same = next((k for k in kept if compatible(k, state)), None)
        if same is None:
            kept.append(state)
            known.add(state)
        else:
            child[at][symbol] = same
            fold(same, state)
    number = {k: i for i, k in enumerate(kept)}
    moves = []
    for k in kept:
        shares = {END: (-1, end[k] + 0.5)} | {s: (number.get(child[k].get(s), -1), moved[k].get(s, 0) + 0.5) for s in SYMBOLS}
        whole = sum(w for _, w in shares.values())
        moves.append({s: (to, log(w / whole)) for s, (to, w) in shares.items()})
    return Automaton(moves, fallback)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if ASSIGN_WORDS.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def free_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that touch no base span: runs without the dots around them and, after each, its parts between dots."""
    out = []
    free = lambda start, end: all(end <= s or start >= e for s, _, e, _ in base)
    for m in RUN.finditer(text):
        value = m[0].strip(".")
        if not value:
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip("."))
        if not base or free(at, at + len(value)):
            out.append((at, at + len(value), value))
        if "." in value:
            for part in value.split("."):
                if part and (not base or free(at, at + len(part))):
                    out.append((at, at + len(part), part))
                at += len(part) + 1
    return out


@dataclass(frozen=True)
class Formats:
    """Automata by label; ``plain`` is the harmless one."""

    secret: dict[str, Automaton]
    plain: Automaton

    def margin(self, value: str) -> tuple[str, float]:
        """The best credential label and by how many nats per character it beats the harmless automaton."""
        plain = self.plain.score(value)
        best = max(((a.score(value), k) for k, a in self.secret.items()), default=(plain, ""))
        return best[1], (best[0] - plain) / (len(value) + 1)


def format_spans(text: str, base: list[tuple[int, int, int, str]], formats: Formats, known: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, margin) of the candidates whose margin suffices, a run before its parts; ``known`` remembers margins by format."""
    out, done = [], 0
    for start, end, value in free_candidates(text, base):
        if end <= done:
            continue
        form = value.translate(_TO_CLASS)
        margin = known.get(form)
        if margin is None:
            if len(known) >= REMEMBERED:
                known.clear()
            margin = known[form] = formats.margin(value)[1]
        if margin >= MARGIN and margin * (len(value) + 1) >= EVIDENCE * (1 - 1e-9):
            out.append((start, end, margin))
            done = end
    return out


_LABELLED = "label string, format string"
#: Harmless words are labelled where a hash of the word falls into one of so many classes.
PLAIN_CLASSES = 64


def labelled_formats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Formats of all base values by kind, and of harmless words of the same texts (label ``plain``).

    Harmless are the candidates of any length, labelled where a hash of the
    word says so. Every text is read whole.
    """

    def run(frames):
        for frame in frames:
            labels, formats = [], []
            for body in frame["body"]:
                body = body or ""
                base = base_spans(body)
                for _, kind, _, value in base:
                    labels.append(KINDS[kind])
                    formats.append(value.translate(_TO_CLASS))
                for _, _, value in free_candidates(body, base):
                    if crc32(value.encode()) % PLAIN_CLASSES == 0:
                        labels.append("plain")
                        formats.append(value.translate(_TO_CLASS))
            # named as objects: a batch without any would else be taken for numbers
            yield pd.DataFrame({"label": labels, "format": formats}, dtype=object)

    return docs.select(F.col(text).alias("body")).mapInPandas(run, _LABELLED)


def fit_formats(docs: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED) -> Formats:
    """Infer one automaton per label from at most ``max_labelled`` different formats each, the choice by hash.

    Formats are counted by a grouped aggregation first, so a credential copied
    into a third of all texts is one row. Without credentials only the harmless
    automaton exists and nothing is added to the base spans.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    counted = scratch.store(labelled_formats(docs, text).groupBy("label", "format").count(), "formats")
    secret, plain = {}, Automaton([{}], {s: log(1 / (len(SYMBOLS) + 1)) for s in (*SYMBOLS, END)})
    for label in (*KINDS, "plain"):
        rows = bounded_sample(counted.filter(F.col("label") == label), "format", max_labelled, 3).collect()
        # a copied credential must not outvote formats: its count weighs by its logarithm
        values = sorted((r["format"], 1 + int(log(r["count"]))) for r in rows)
        if label == "plain" and values:
            plain = infer(values)
        elif values:
            secret[label] = infer(values)
    scratch.drop("formats")
    return Formats(secret, plain)


def scan_secrets(docs: DataFrame, formats: Formats, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (start, stop, kind, margin), in code points, end exclusive.

    Kinds are the base ones and ``format`` for what only the automata found.
    Spans are ordered by start, then kind as listed. Null and empty texts have
    none; repeated rows are each scanned.
    """
    require(docs, text)
    if spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {spans} exists already")
    schema = with_fields(docs, **{spans: "array<struct<start:int,stop:int,kind:string,margin:double>>"})

    known: dict[str, float] = {}

    def found(body: str | None) -> list[dict]:
        body = body or ""
        base = base_spans(body)
        rows = [(s, kind, e, KINDS[kind], None) for s, kind, e, _ in base]
        rows += [(s, len(KINDS), e, "format", margin) for s, e, margin in format_spans(body, base, formats, known)]
        return [{"start": s, "stop": e, "kind": kind, "margin": margin} for s, _, e, kind, margin in sorted(rows, key=lambda r: r[:3])]

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("margin", pa.float64())]))
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            new = pa.array([found(b) for b in bodies], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, spans])

    return docs.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, formats: Formats, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span in the text replaced by ``mask``; other columns and rows stay."""
    require(docs, text)

    known: dict[str, float] = {}

    def clean(body: str | None) -> str | None:
        if not body:
            return body
        base = base_spans(body)
        cuts = [(s, e) for s, _, e, _ in base]
        cuts += [(s, e) for s, e, _ in format_spans(body, base, formats, known)]
        out, at = [], 0
        for s, e in sorted(cuts):
            if s >= at:
                out += [body[at:s], mask]
            at = max(at, e)
        return "".join([*out, body[at:]]) if cuts else body

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = pa.array([clean(b) for b in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    return docs.mapInArrow(run, docs.schema)

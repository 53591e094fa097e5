"""Toxicity by a learned lexicon, misspellings included, and the context of every hit.

The lexicon is learned from labelled documents by grouped counts: whole words,
and beginnings of words for languages that inflect or compound, whose share of
toxic documents is high. It is kept as a trie. A word is looked up by running a
Levenshtein automaton along the trie, so a misspelled term is found without
comparing the word with every term. Windows around the hits say whether a term
is quoted or used; a logistic model over exact, misspelled, quoted and direct
hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, bounded_sample, require, with_fields
from codefacts.llm.logistic import Logistic, fit

#: Lexicon and score are learned from at most so many labelled rows, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: Words and stems of toxic rows that are counted in the other rows too, the most frequent ones.
MAX_CANDIDATES = 100_000
#: The lexicon holds at most so many terms, the most telling ones.
MAX_TERMS = 2_000
#: A term needs so many different toxic texts, and this share of toxic ones among all documents that hold it.
#: Copies of one text count once for the first, so they do not make terms of its words.
LEAST_TOXIC, LEAST_SHARE = 4, 0.7
#: Lengths of the word beginnings that are tried as stems.
STEMS = (4, 5, 6)
#: Terms of at least so many letters are also found with one edit, of at least the second number with two.
ONE_EDIT, TWO_EDITS = 5, 10
#: Characters on each side of a hit that make its context.
WINDOW = 48
#: What is remembered per worker: words looked up, and beginnings of words that lead to no term.
REMEMBERED = 200_000
#: Letters of a beginning.
BEGINNING = 5

WORD = re.compile(r"[^\W_](?:[\w@$'’-]*[\w@$])?")
# Signs of quotation, and words that report or refuse a term rather than use it (four languages).
QUOTES = "\"“”„«»‹›‘’`"
REPORTS = frozenset(
    "said says called quote quoted wrote word term not never dit dite mot terme pas jamais dijo palabra nunca sagte wort nicht nie".split()
)
# Letters that digits and signs stand in for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

FEATURES = ("exact", "misspelled", "stems", "weight", "strongest", "direct", "quoted", "per_word", "size")


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    stem: str | None = None


class Trie:
    """Terms, and stems that match whatever follows them."""

    def __init__(self, words: Iterable[str], stems: Iterable[str]):
        self.root = Node()
        for word in words:
            self._end(word).term = word
        for stem in stems:
            self._end(stem).stem = stem

    def _end(self, word: str) -> Node:
        node = self.root
        for letter in word:
            node = node.children.setdefault(letter, Node())
        return node

    def exact(self, word: str) -> tuple[str | None, str | None]:
        """The term that the word is, and the longest stem that it begins with."""
        node, stem = self.root, None
        for letter in word:
            node = node.children.get(letter)
            if node is None:
                return None, stem
            stem = node.stem or stem
        return node.term, stem

    def leads(self, start: str) -> bool:
        """Whether a word that begins like this can be a term or begin with a stem."""
        node = self.root
        for letter in start:
            node = node.children.get(letter)
            if node is None:
                return False
            if node.stem:
                return True
        return True


class NearTerms:
    """Levenshtein automaton of ``edits`` edits run along a trie of terms, made deterministic as words are read.

    A state is a set of (trie node, edits spent). Reading a letter follows the
    node's branch, or spends an edit on another branch, on staying (a letter
    too many) or, before reading, on a branch passed over (a letter missing).
    Most words reach the empty state after a few letters.
    """

    #: Moves remembered; beyond this number they are worked out anew.
    LIMIT = 400_000

    def __init__(self, terms: Iterable[str], edits: int):
        self.edits, self.root = edits, Trie(terms, ()).root
        self._forget()

    def _forget(self) -> None:
        self.states: list[dict[int, tuple[Node, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self._state({id(self.root): (self.root, 0)})

    def _state(self, reached: dict[int, tuple[Node, int]]) -> int:
        """The number of a set of positions, letters passed over included; -1 for the empty set."""
        todo = list(reached.values())
        while todo:
            node, spent = todo.pop()
            if spent < self.edits:
                for child in node.children.values():
                    if reached.get(id(child), (child, self.edits + 1))[1] > spent + 1:
                        reached[id(child)] = (child, spent + 1)
                        todo.append((child, spent + 1))
        if not reached:
            return -1
        key = frozenset((k, spent) for k, (_, spent) in reached.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(reached)
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, tuple[Node, int]] = {}

        def reach(node: Node, spent: int) -> None:
            if spent <= self.edits and reached.get(id(node), (node, self.edits + 1))[1] > spent:
                reached[id(node)] = (node, spent)

        for node, spent in self.states[state].values():
            reach(node, spent + 1)
            for branch, child in node.children.items():
                reach(child, spent + (branch != letter))
        return self._state(reached)

    def read(self, word: str) -> int:
        """The state after the letters of ``word``; -1 if no term can begin like this."""
        if len(self.moves) > self.LIMIT:
            self._forget()
        state = 0
        for letter in word:
            following = self.moves.get((state, letter))
            if following is None:
                following = self.moves[state, letter] = self._move(state, letter)
            if following < 0:
                return -1
            state = following
        return state

    def find(self, word: str) -> str | None:
        """The nearest term within the edits, the first in alphabetical order among equals."""
        state = self.read(word)
        if state < 0:
            return None
        ends = [(spent, node.term) for node, spent in self.states[state].values() if node.term is not None]
        return min(ends)[1] if ends else None


@dataclass(frozen=True)
class Lexicon:
    """Log-odds of the words and of the stems."""

    words: Mapping[str, float]
    stems: Mapping[str, float]


class Matcher:
    """Looks words up, remembering what it found; one per worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie = lexicon, Trie(lexicon.words, lexicon.stems)
        self.near = [
            NearTerms([w for w in lexicon.words if ONE_EDIT <= len(w) < TWO_EDITS], 1),
            NearTerms([w for w in lexicon.words if len(w) >= TWO_EDITS], 2),
        ]
        self.memory: dict[str, tuple[str, float] | None] = {}
        self.leads: dict[str, bool] = {}
        lengths = [len(w) for w in lexicon.words if len(w) >= ONE_EDIT]
        self.least, self.most = (min(lengths) - 1, max(lengths) + 2) if lengths else (1, 0)

    def hits(self, held: set[str]) -> dict[str, tuple[str, float]]:
        """What ``look`` says of the words, for those of which it says anything.

        Most words are done with their beginning, read once by the trie and the automata.
        """
        found = {}
        leads = self.leads
        for word in held:
            start = word[:BEGINNING]
            lead = leads.get(start)
            if lead is None:
                lead = self._leads(start)
            if lead and (hit := self.look(word)):
                found[word] = hit
        return found

    def _leads(self, start: str) -> bool:
        if len(self.leads) >= REMEMBERED:
            self.leads.clear()
        plain = start if start.isalpha() else start.translate(LOOKALIKES)
        exact = self.trie.leads(start) or self.trie.leads(plain)
        self.leads[start] = lead = exact or any(automaton.read(plain) >= 0 for automaton in self.near)
        return lead

    def look(self, word: str) -> tuple[str, float] | None:
        """(how, weight) of a word: exact, stem, or misspelled."""
        if word in self.memory:
            return self.memory[word]
        found = self._find(word)
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        self.memory[word] = found
        return found

    def _find(self, word: str) -> tuple[str, float] | None:
        term, stem = self.trie.exact(word)
        if term:
            return "exact", self.lexicon.words[term]
        if stem:
            return "stem", self.lexicon.stems[stem]
        plain = word if word.isalpha() else word.translate(LOOKALIKES)
        if plain != word:
            term, stem = self.trie.exact(plain)
            if term:
                return "misspelled", self.lexicon.words[term]
            if stem:
                return "misspelled", self.lexicon.stems[stem]
        if not self.least <= len(word) <= self.most:
            return None
        term = self.near[0].find(plain) or self.near[1].find(plain)
        return ("misspelled", self.lexicon.words[term]) if term else None


def words_of(text: str) -> list[str]:
    return [m[0] for m in WORD.finditer(text.lower())]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit sets it in quotation marks or reports it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if any(q in before[-24:] for q in QUOTES) and any(q in after[:24] for q in QUOTES):
        return True
    return not REPORTS.isdisjoint(before.lower().split()[-3:])


def features_of(text: str | None, matcher: Matcher) -> list[float]:
    """The ``FEATURES`` of a whole text; a null or empty one has zeros but for its size."""
    body = text or ""
    low = body.lower()
    low = low if len(low) == len(body) else body
    counts = {"exact": 0, "misspelled": 0, "stem": 0}
    weight = strongest = 0.0
    direct = cited = 0
    pieces = WORD.findall(low)
    hits = matcher.hits(set(pieces))
    if hits:
        for m in WORD.finditer(low):
            found = hits.get(m[0])
            if not found:
                continue
            counts[found[0]] += 1
            if quoted(body, m.start(), m.end()):
                cited += 1
            else:
                direct += 1
                weight += found[1]
                strongest = max(strongest, found[1])
    n = max(len(pieces), 1)
    log = lambda x: float(np.log1p(x))
    return [log(counts["exact"]), log(counts["misspelled"]), log(counts["stem"]), log(weight), strongest, log(direct), log(cited), 100 * direct / n, log(n)]


def learn_lexicon(marked: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Words and stems that tell toxic documents, from (body, toxic) of labelled rows.

    Documents are counted, not occurrences: first the different toxic texts,
    equal ones once, then, for terms with enough of them, all rows, each time
    combined batch by batch before the shuffle. At most ``max_terms`` come to the driver. Stems are kept
    where they tell more documents than their best single word does.
    """

    def counted(rows: DataFrame, only: frozenset[tuple[str, int]] | None) -> DataFrame:
        def run(frames):
            for frame in frames:
                n, bad = Counter(), Counter()
                for body, label in zip(frame["body"], frame["toxic"], strict=True):
                    held = set(words_of(body or ""))
                    found = {(w, 0) for w in held if len(w) > 2} | {(w[:k], 1) for w in held for k in STEMS if len(w) > k}
                    found = found if only is None else found & only
                    n.update(found)
                    if label:
                        bad.update(found)
                yield pd.DataFrame({"term": [t for t, _ in n], "kind": [k for _, k in n], "n": list(n.values()), "bad": [bad[t] for t in n]}).astype(
                    {"term": "object", "kind": "int32", "n": "int64", "bad": "int64"}
                )

        sums = rows.mapInPandas(run, "term string, kind int, n bigint, bad bigint").groupBy("term", "kind")
        return sums.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    # copies meet in the task that read them, then by the hash of their text
    texts = marked.filter("toxic = 1").withColumn("copy", F.md5(F.coalesce("body", F.lit("")).cast("binary"))).dropDuplicates(["copy"])
    toxic = counted(texts.select("body", "toxic"), None).filter(F.col("bad") >= LEAST_TOXIC)
    asked = toxic.orderBy(F.desc("bad"), "kind", "term").limit(MAX_CANDIDATES).select("term", "kind").toPandas()
    found = counted(marked, frozenset(zip(asked["term"], asked["kind"].tolist(), strict=True)))
    total = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not total["n"] or not total["bad"] or total["bad"] == total["n"]:
        return Lexicon({}, {})
    base = total["bad"] / (total["n"] - total["bad"])
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5) / F.lit(base))
    telling = found.filter((F.col("bad") >= LEAST_TOXIC) & (F.col("bad") >= LEAST_SHARE * F.col("n"))).withColumn("odds", odds)
    top = telling.orderBy(F.desc(F.col("bad") * F.col("odds")), "kind", "term").limit(max_terms).toPandas()
    words = {r.term: r for r in top.itertuples() if r.kind == 0}
    stems = {}
    for r in top[top["kind"] == 1].sort_values(["term"]).itertuples():
        single = max((w.bad for t, w in words.items() if t.startswith(r.term)), default=0)
        shorter = next((r.term[:n] for n in STEMS if n < len(r.term) and r.term[:n] in stems), None)
        if r.bad > 1.5 * single and not (shorter and top_bad(top, shorter) <= 1.1 * r.bad):
            stems[r.term] = float(r.odds)
    # a longer stem inside a kept shorter one adds nothing
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in STEMS if n < len(s))}
    return Lexicon({t: float(r.odds) for t, r in words.items() if not any(t.startswith(s) for s in stems)}, stems)


def top_bad(top: pd.DataFrame, stem: str) -> int:
    return int(top[(top["term"] == stem) & (top["kind"] == 1)]["bad"].max())


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    scorer: Logistic


def _with_features(df: DataFrame, text: str, added: str, lexicon: Lexicon) -> DataFrame:
    schema = with_fields(df, **{added: "array<double>"})

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            new = pa.array([features_of(b, matcher) for b in bodies], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, added])

    return df.mapInArrow(run, schema)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED
) -> ToxicityModel:
    """Learn the lexicon and the score from the rows of ``labels`` whose label is 0 or 1.

    The caller leaves out what must not be learned from. Without labels, or
    with one class only, every text scores the smoothed share of label 1.
    """
    require(docs, text, key)
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter("toxic IN (0, 1) AND key IS NOT NULL")
    chosen = bounded_sample(marked, "key", max_labelled, 11)
    bodies = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    # at most ``max_labelled`` rows of two numbers: the texts stay where they are
    known = scratch.store(bodies.join(F.broadcast(chosen), "key"), "labelled")
    lexicon = learn_lexicon(known.select("body", "toxic"))
    sample = _with_features(known, "body", "features", lexicon).select("features", "toxic").toPandas()
    scratch.drop("labelled")
    x = np.array(sample["features"].tolist()) if len(sample) else np.zeros((0, len(FEATURES)))
    return ToxicityModel(lexicon, fit(x, sample["toxic"].to_numpy(float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text; null and empty texts have one too."""
    require(docs, text)
    schema = with_fields(docs, **{score: "double"})

    def run(batches):
        matcher = Matcher(model.lexicon)
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            x = np.array([features_of(b, matcher) for b in bodies]).reshape(-1, len(FEATURES))
            new = pa.array(1 / (1 + np.exp(-np.clip(model.scorer.logits(x), -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, score])

    if score.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {score} exists already")
    return docs.mapInArrow(run, schema)

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.llm import mixing, quality, secrets, toxicity
from codefacts.llm.common import text_bytes

DOCS = "doc_id bigint, text string, lang string, source string"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = prose(rng, 60)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, ["en", "de"][i % 2], "hot" if i % 3 else f"s{i % 5}"))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, "en", "hot"), (1001, "", None, None), (None, "no key here", "en", "hot"), (5, rows[5][1], "en", "hot")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:180], "doc_id bigint, quality int, toxic int")


def test_features_do_not_depend_on_the_batch():
    texts = ["Abc def.\nGhi!", None, "", "x" * 40, "A B\n" * 9, " lead and trail "]
    whole = quality.features_of(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features_of(pa.array([t], pa.string()))[0])
    data, starts = text_bytes(pa.array(texts)[2:5])
    assert len(data) == starts[-1] and len(starts) == 4


def test_quality_keeps_good_documents(spark, corpus):
    docs, labels = corpus
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == docs.count()
    for r in scored:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["quality_keep"] == (r["doc_id"] % 6 != 0)
        assert 0 <= r["quality_score"] <= 1
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_groups_shrink_to_their_host(spark, corpus):
    docs, labels = corpus
    groups = quality.fit_quality(docs, labels).groups.collect()
    assert sum(r["n_docs"] for r in groups) == docs.count()
    share = np.average([r["posterior"] for r in groups], weights=[r["n_docs"] for r in groups])
    for r in groups:
        if r["n_docs"] == 1:
            assert abs(r["posterior"] - share) < 0.35


def test_quality_without_labels_and_rows(spark, corpus):
    docs, labels = corpus
    none = quality.fit_quality(docs, labels.filter(F.lit(False)))
    assert quality.score_quality(docs, none).count() == docs.count()
    empty = docs.filter(F.lit(False))
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0


def test_clashing_columns_stay(spark, corpus):
    docs, labels = corpus
    odd = docs.withColumns({"q_logit": F.lit("mine"), "Q_HOST": F.lit(1)})
    out = quality.keep_good(odd, quality.fit_quality(odd, labels))
    assert out.columns == odd.columns and {r["q_logit"] for r in out.collect()} == {"mine"}


# -- mixing -------------------------------------------------------------------


def test_raking_meets_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS)
    sides = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.mix(docs, sides, {"source": {"x": 0.5, "y": 0.3, None: 0.2}, "lang": {"a": 0.5, "b": 0.5}}, keep_share=0.5)
    rows = out.collect()
    weight = lambda f: sum(r["n_tokens"] * r["keep_probability"] for r in rows if f(r))
    total = weight(lambda r: True)
    assert total == pytest.approx(0.5 * sum(r["n_tokens"] for r in rows), rel=0.05)
    if max(r["keep_probability"] for r in rows) < 1:
        assert weight(lambda r: r["source"] == "x") / total == pytest.approx(0.5, abs=0.01)
        assert weight(lambda r: r["source"] is None) / total == pytest.approx(0.2, abs=0.01)
        assert weight(lambda r: r["lang"] == "a") / total == pytest.approx(0.5, abs=0.01)
    kept = sum(r["n_tokens"] for r in rows if r["kept"])
    assert kept == pytest.approx(total, rel=0.15)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "longword " * 3, "en", "s")], DOCS)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and all(0 <= r["keep_probability"] <= 1 for r in rows)
    assert mixing.mix(docs.filter(F.lit(False))).count() == 0
    assert mixing.sample_mix(docs).columns == docs.columns
    with pytest.raises(ValueError, match="exist already"):
        mixing.mix(docs.withColumn("KEPT", F.lit(1)))


def test_mixing_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a longword", "en", "s")], DOCS)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# -- secrets ------------------------------------------------------------------

BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
}


def plain_base(text):
    out = []
    for k, (pattern, least) in enumerate(BASE.values()):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    bits = ["AKIA", "ABCD1234", "password", "Token", "api_key", "APIKEY", " = ", ": ", "'", '"', "abcdef0123", "deadbeef", "  ", "é", "x", "-", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in secrets.base_spans(text)] == plain_base(text)


def test_states_merge_into_a_loop():
    rng = random.Random(3)
    values = [("".join(rng.choice("dh") for _ in range(40)), 1) for _ in range(500)]
    machine = secrets.infer(sorted(values))
    assert len(machine.moves) < 45
    assert machine.score("3f" * 20) > machine.score("zz" * 20)
    for row in machine.moves:
        assert sum(np.exp(p) for _, p in row.values()) == pytest.approx(1)


def test_batches_without_any_format(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "s")], DOCS)
    assert secrets.labelled_formats(docs).count() == 0
    assert secrets.fit_formats(docs).secret == {}


def test_formats_add_spans_and_keep_base_ones(spark):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"{prose(rng, 30)} token = {key(40)} and {prose(rng, 5)}", "en", "s") for i in range(60)]
    rows += [(900, f"see {key(39).upper()} here", "en", "s"), (901, None, "en", "s"), (902, "", "en", "s"), (903, "plain words only", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    formats = secrets.fit_formats(docs)
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, formats).collect()}
    for i, text, *_ in rows:
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["stop"]) for s in found[i] if s["kind"] != "format"]
        assert base == plain_base(text or "")
    assert found[901] == found[902] == found[903] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs, formats).collect()}
    assert clean[903] == "plain words only" and clean[901] is None and not plain_base(clean[0])
    assert secrets.scan_secrets(docs.filter(F.lit(False)), secrets.fit_formats(docs.filter(F.lit(False)))).count() == 0


def test_candidates_are_all_runs_and_their_dotted_parts():
    text = "at ..9f8A7b6C. to aaa.bbb.ccc, x"
    assert [v for _, _, v in secrets.free_candidates(text, [])] == ["at", "9f8A7b6C", "to", "aaa.bbb.ccc", "aaa", "bbb", "ccc", "x"]
    assert all(text[s:e] == v for s, e, v in secrets.free_candidates(text, []))


def test_formats_find_keys_before_marks_in_parts_and_of_any_make(spark):
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda n, of=letters + "0123456789": "".join(rng.choice(of) for _ in range(n))
    rows = [(i, f"{prose(rng, 30)} token = {key(rng.choice([16, 24, 40]))} and {prose(rng, 5)}", "en", "s") for i in range(120)]
    planted = {900: key(24), 901: key(24), 902: ".".join([key(20), key(30), key(25)]), 903: key(32, letters), 904: key(17), 905: key(30)}
    marks = {900: ".", 901: ",", 902: ".", 903: " ", 904: " ", 905: "..."}
    rows += [(i, f"the key is {k}{marks[i]} {prose(rng, 5)}", "en", "s") for i, k in planted.items()]
    rows += [(990, "see the plain words only. and no more, of it", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    formats = secrets.fit_formats(docs)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs, formats).collect()}
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, formats).collect()}
    text = {r[0]: r[1] for r in rows}
    for i, k in planted.items():
        assert [text[i][s["start"] : s["stop"]] for s in found[i]] == [k] or i == 902
        assert not any(part in clean[i] for part in k.split(".")) and clean[i].startswith("the key is [secret]")
    assert clean[990] == rows[-1][1] and found[990] == []


# -- toxicity -----------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1, *[0] * len(b)] if False else _row(row, x, b, i)
    return row[-1]


def _row(before, x, b, i):
    row = [i + 1]
    for j, y in enumerate(b):
        row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row


@pytest.mark.parametrize("most", [1, 2])
def test_lazy_automaton_is_edit_distance(most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    terms = sorted({word() for _ in range(40)})
    near = toxicity.NearTerms(terms, most)
    for _ in range(2000):
        w = word()
        best = min((edits(t, w), t) for t in terms)
        assert near.find(w) == (best[1] if best[0] <= most else None)


def test_words_are_settled_by_their_beginnings_as_by_looking_them_up():
    lexicon = toxicity.Lexicon({"ass": 1.0, "crap": 2.0, "blockhead": 3.0, "scoundrelly": 4.0}, {"nitw": 5.0, "dumbos": 6.0, "olaf": 7.0})
    every = toxicity.Matcher(lexicon)
    assert every.look("cr4p") == ("misspelled", 2.0) and every.look("a5s") == ("misspelled", 1.0)
    assert every.look("n1twits") == ("misspelled", 5.0) and every.look("dumb0s") == ("misspelled", 6.0)
    rng = random.Random(11)
    words = {"cr4p", "a5s", "n1twits", "dumb0s", "0laf", "bl0ckhe4t", "ass", "crap", "nitwits", "nit", "dumbosity"}
    for _ in range(4000):
        word = list(rng.choice([*lexicon.words, *lexicon.stems, "harmless"]) + rng.choice(["", "", "s", "ing"]))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice("abcdeiost013457@$")
        words.add("".join(word))
    assert toxicity.Matcher(lexicon).hits(words) == {w: f for w in words if (f := every.look(w))}
    # without any term of five letters the automata are empty
    short = toxicity.Matcher(toxicity.Lexicon({"crap": 2.0}, {}))
    assert short.hits({"cr4p", "crap", "crab"}) == {"cr4p": ("misspelled", 2.0), "crap": ("exact", 2.0)}


def test_lexicon_counts_toxic_texts_not_contexts_or_copies(spark):
    rng = random.Random(12)
    rows = [(f"{prose(rng, 20)} you utter nitwit {prose(rng, 20)}", 1) for _ in range(4)]
    rows += [(f"{prose(rng, 20)} the knave {prose(rng, 20)}", 1) for _ in range(3)]
    rows += [("one copied blockhead text, another blockhead, some blockhead, that blockhead", 1)] * 9
    rows += [(prose(rng, 40), 0) for _ in range(60)] + [(None, 1), (None, 0), ("", 1)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "body string, toxic int"))
    known = lambda w: w in lexicon.words or any(w.startswith(s) for s in lexicon.stems)
    assert known("nitwit") and not known("knave") and not known("blockhead")


def test_toxic_documents_score_higher(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 50).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(50)] = rng.choice(["blockhead", "scoundrel", "nitwit"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    odd = [(900, prose(rng, 20) + " you blokchead, blockheat " + prose(rng, 20), "en", "s"), (901, None, "en", "s"), (902, "", "en", "s")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known.filter("doc_id % 5 <> 0"))
    assert {"blockhead", "scoundrel", "nitwit"} <= set(model.lexicon.words) | {w for w in ("blockhead", "scoundrel", "nitwit") if any(w.startswith(s) for s in model.lexicon.stems)}
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert score[901] < 0.5 and score[902] < 0.5
    nothing = toxicity.fit_toxicity(docs, known.filter(F.lit(False)))
    assert toxicity.score_toxicity(docs.filter(F.lit(False)), nothing).count() == 0


def test_quotation_is_told_from_abuse():
    text = 'He wrote "nitwit" once. You nitwit!'
    first, second = (m.span() for m in re.finditer("nitwit", text))
    assert toxicity.quoted(text, *first) and not toxicity.quoted(text, *second)


def test_thin_queries_and_mixing_stand_clashing_columns(spark, tmp_path):
    from codefacts.llm import queries

    rows = [(i, f"word{i % 7} and other words here {i}", "en", f"s{i % 3}", 3, 1, "x", "y", 0.5, "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, spans string, toxicity string, keep_probability double, mix_topic string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op3_source_mixing", "op5_toxicity", "op9_secret_scan"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 60
    sampled = mixing.sample_mix(docs)
    assert sampled.columns == docs.columns
    assert {tuple(r) for r in sampled.collect()} <= set(rows)

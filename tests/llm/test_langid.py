import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.llm import langid as L
from casetrail.llm.rows import fold


def windows(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = letters.split()
    padded = "   " + " ".join(words) + " "
    return [padded[i:i + 4] for i in range(len(padded) - 3)] if words else []


def packed(gram):
    return sum(ord(c) << 16 * (3 - i) for i, c in enumerate(gram))


@pytest.mark.parametrize("text", [None, "", "12 - 3", "a", "Ab, cd!", "  über\t\nÉtat 5x ", "a--b  c", "日本 語"])
def test_windows(text):
    got = [int(k) for block in L.grams(text) for k in block]
    assert got == [packed(g) for g in windows(text or "")]


def test_blocks_join_up(monkeypatch):
    text = "the quick, brown fox jumps " * 20
    monkeypatch.setattr(L, "_BLOCK", 7)
    assert [int(k) for block in L.grams(text) for k in block] == [packed(g) for g in windows(text)]


def test_model_is_interpolated_kneser_ney():
    text = "the cat sat on the mat and the rat ran at the cat that sat there"
    counts = Counter(windows(text))
    keys = np.array([packed(g) for g in counts], np.uint64)
    alphabet = len({g[3] for g in counts})
    model = L.Model(keys, np.array(list(counts.values())), alphabet)
    tables = {4: dict(counts)}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / (alphabet + 1)
        table = tables[n]
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
        same = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        if not same:
            return probability(gram[1:])
        total = sum(same.values())
        return max(table.get(gram, 0) - d, 0) / total + d * len(same) / total * probability(gram[1:])

    asked = [*counts, "zzzz", " the"[:4], "thez", "xthe", "   q", "catz"]
    got = model.log10(np.array([packed(g) for g in asked], np.uint64))
    assert np.allclose(got, [math.log10(probability(g)) for g in asked])
    after = sum(10 ** model.log10(np.array([packed("the" + c)], np.uint64))[0] for c in {g[3] for g in counts})
    assert 0.9 < after < 1


SYLLABLES = {"en": ["the", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ein", "ü", "pf"], "fr": ["eau", "oi", "é", "que", "elle"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(1200)
    odd = [(5000, None, "en"), (5001, "", "de"), (5002, "12 34 !!", "fr"), (None, "the ing er on the ing", "en"), (5003, "ung ein sch", None),
           (5004, "zxqj kkvw " * 40, None), (5005, "the ing wh " * 4000, "de"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = L.languages(docs.select("doc_id", "text", "lang", "score")).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in truth if by[i].held_out]
    assert 200 < len(held) < 400
    assert sum(by[i].lang_pred == truth[i] for i in held) / len(held) > 0.99
    assert not any(by[i].rejected for i in truth)
    assert [by[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3
    assert by[5005].lang_pred == "en" and by[5003].lang_pred == "de" and by[None].lang_pred == "en"
    assert by[5004].rejected and not by[5003].rejected
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in docs.where(fold("doc_id", 4) == 2).select("doc_id").collect()} == {r.doc_id for r in found if r.held_out}
    kept = L.in_known_languages(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(found) - sum(r.rejected for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in L.languages(docs).collect()] == [("und", 0.0, True)] * 2
    assert L.languages(docs.where("false")).count() == 0
    assert L.in_known_languages(docs.where("false")).count() == 0


MORE = {**SYLLABLES, "nl": ["de", "sch", "een", "ing", "ij"], "es": ["que", "el", "os", "ción", "ar"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(MORE[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_a_language_without_a_model_is_rejected_and_mixed_texts_stay(spark):
    rng = random.Random(5)
    known = ["en", "de", "fr", "es"]
    rows = [(i, words(rng, known[i % 4], rng.randint(15, 60)), known[i % 4]) for i in range(1600)]
    rows += [(5000 + i, words(rng, "nl", rng.randint(15, 60)), None) for i in range(200)]
    rows += [(6000 + i, " ".join(words(rng, x, 25) for x in rng.sample(known, 2)), None) for i in range(200)]
    found = {r.doc_id: r for r in L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(found[i].rejected for i in range(5000, 5200)) >= 190
    assert not any(found[i].rejected for i in range(6000, 6200))
    assert sum(found[i].rejected for i in range(1600)) <= 8


def test_languages_with_few_texts_have_a_limit(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, ("en", "fr")[i % 2], rng.randint(15, 60)), ("en", "fr")[i % 2]) for i in range(800)]
    rows += [(2000 + i, words(rng, "de", rng.randint(15, 60)), "de") for i in range(40)]
    found = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.isfinite(found.limit("de", 200))
    assert not any(found.judge(words(rng, "de", 40))[2] for _ in range(50))
    assert found.judge(" ".join(["pfzq", "schw", "kkwv", "ungx"] * 10))[2]

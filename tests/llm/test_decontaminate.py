import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.llm import decontaminate as D

RNG = random.Random(3)
WORDS = [a + b for a in ("tha", "ro", "ki", "lem", "su", "po") for b in ("n", "t", "rin", "sto", "va")]
COMMON = ["the", "of", "and"]


def sentence(n):
    return " ".join(RNG.choice(COMMON) if RNG.random() < 0.4 else RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(i, f"{sentence(RNG.randint(6, 25))} {sentence(RNG.randint(5, 12))}") for i in range(60)]


def bm25(passage, items):
    """Scores of one passage by the formula, item by item."""
    texts = [[D.term(c) for c in f"{q} {a}".split() if D.term(c)] for _, q, a in items]
    mean = sum(map(len, texts)) / len(texts)
    scores = []
    for words in texts:
        own = {}
        for w in set(words):
            df = sum(w in t for t in texts)
            n = words.count(w)
            own[w] = (math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * n * (D.K1 + 1)
                      / (n + D.K1 * (1 - D.B + D.B * len(words) / mean)))
        scores.append(sum(own[w] for w in own if w in passage) / sum(own.values()))
    return scores


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.5, 0.8])
@pytest.mark.parametrize("block", [1, 4, 16])
def test_every_passage_above_the_threshold_is_retrieved(monkeypatch, threshold, block):
    monkeypatch.setattr(D, "BLOCK", block)
    items = [(i, *D.question_and_answer(t)) for i, t in ITEMS]
    index = D.Index(items, threshold)
    passages = [sentence(RNG.randint(1, 60)).lower().replace(".", "").split() for _ in range(150)]
    passages += [ITEMS[k][1].lower().replace(".", "").split() for k in range(5)] + [[], ["unheard", "words"]]
    number, words = [], []
    for p, passage in enumerate(passages):
        for w in passage:
            if w in index.words.numbers:
                number.append(p)
                words.append(index.words.numbers[w])
    got = dict(zip(zip(*[x.tolist() for x in index.search(np.array(number), np.array(words))[:2]]),
                   index.search(np.array(number), np.array(words))[2]))
    expected = {(p, i): s for p, passage in enumerate(passages) for i, s in enumerate(bm25(set(passage), items))
                if s >= threshold - 1e-9}
    assert set(got) == set(expected)
    assert all(abs(got[k] - s) < 1e-9 for k, s in expected.items())


def around(text, before=90, after=70):
    return f"{sentence(before)} {text} {sentence(after)}"


@pytest.mark.parametrize("words", [100_000, 100])
def test_copies_are_found_and_the_rest_left_alone(spark, monkeypatch, words):
    shouted = "  ###\n".join(ITEMS[3][1].upper().split())
    rows = [(1, around(ITEMS[0][1])), (2, ITEMS[1][1]), (3, around(shouted, 7)), (4, around(ITEMS[4][1] + " " + ITEMS[5][1], 500)),
            (5, sentence(400)), (6, None), (7, ""), (8, " \n"), (9, " ".join(reversed(ITEMS[7][1].split()))),
            (10, around(ITEMS[8][1].split(". ")[0] + ".")), (2, ITEMS[1][1]), (None, ITEMS[2][1]), (11, "x" * 50000),
            (12, " ".join(ITEMS[9][1].split()[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("item_id", F.lit(2))
    benchmark = spark.createDataFrame([*ITEMS, ITEMS[0], (500, None), (501, ""), (502, "...")], "item_id long, text string")
    expected = sorted([(1, 0), (2, 1), (2, 1), (3, 3), (4, 4), (4, 5), (None, 2)], key=str)
    monkeypatch.setattr(D, "WORDS", words)
    for shard in (20_000, 7):
        found = D.contaminated(docs, benchmark, shard=shard).collect()
        assert sorted([(r.doc_id, r.item_id) for r in found], key=str) == expected
        kept = D.clean(docs, benchmark, shard=shard)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 9, 10, 11, 12]


def test_given_answers_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Which river is the longest one of all? It is the river Nile.")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Which river is the longest one of all?", "The river Nile"), (2, "Which river is the longest one of all?", "The Amazon")],
                                  "item_id long, text string, answer string")
    assert [r.item_id for r in D.contaminated(docs, asked, item_answer="answer").collect()] == [1]
    assert D.contaminated(docs, asked.where("false")).count() == 0
    assert D.contaminated(docs.where("false"), asked).count() == 0
    assert D.clean(docs, asked.where("false")).count() == 1


def shingles(text):
    words = [D.term(c) for c in text.split() if D.term(c)]
    n = min(D.WIDTH, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_one_word_edits_in_any_sentence(spark):
    items = [*ITEMS[:12], (500, f"{sentence(30)} Aye."), (501, f"So. {sentence(30)}")]  # a short last or first sentence
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, expected, hidden = [], set(), 0
    for i, text in items:
        words = text.split()
        for k in range(len(words)):
            doc = f"{sentence(20)} {' '.join([*words[:k], f'new{k}' + '.' * words[k].endswith('.'), *words[k + 1:]])} {sentence(20)}"
            rows.append((len(rows), doc))
            there = shingles(doc)
            score = bm25({D.term(c) for c in doc.split()}, [(j, *D.question_and_answer(t)) for j, t in items])
            for j, (item, t) in enumerate(items):
                shares = [len(x & there) / len(x) if x else 1 for x in map(shingles, (*D.question_and_answer(t), t))]
                if score[j] >= D.THRESHOLD and (min(shares[:2]) >= D.OVERLAP or shares[2] >= D.OVERLAP):
                    expected.add((len(rows) - 1, item))
                    hidden += min(shares[:2]) < D.OVERLAP
    assert hidden > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    asked = spark.createDataFrame([(500, *D.question_and_answer(items[-2][1]))], "item_id long, text string, answer string")
    last = [k for k, (_, t) in enumerate(rows) if "new30" in t]  # a given answer must be there itself
    assert not {r.doc_id for r in D.contaminated(docs, asked, item_answer="answer").collect()} & set(last)

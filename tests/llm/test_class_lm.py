import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casetrail.llm import class_lm as C
from casetrail.llm.rows import fold


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0D]+", text) if w] + [""]


def corpus(n, seed=1):
    """Nouns, verbs and articles in a fixed order, so that classes are worth having."""
    rng = random.Random(seed)
    groups = [["the", "a", "Some"], [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(groups[k % 3]) for k in range(3 * rng.randint(1, 12)))
        rows.append((i, text + (f" rare{rng.randint(0, 400)}" if rng.random() < 0.5 else "")))
    return rows


ODD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "unseen words É only"), (9004, "noun1 " * 5000), (None, "the noun1 onlyhere"),
       (9005, "The\x0bNOUN1\x1cverb1 verb1"), (3, "the noun1")]


@pytest.fixture(params=[1e-4, 2e-2], ids=["all words sent", "rare words joined"])
def sent(request, monkeypatch):
    monkeypatch.setattr(C, "SENT", request.param)
    monkeypatch.setattr(C, "CLUSTERED", max(request.param, 3e-3))


def test_counts_and_base_scores(spark, sent):
    rows = corpus(400) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("key", F.lit(1))
    learned = {(r.doc_id, r.text) for r in docs.where(fold("doc_id", 7) != 2).select("doc_id", "text").collect()}
    counts = Counter(w for row in rows if row in learned for w in words_of(row[1]))
    n, v = sum(counts.values()), len(counts)
    found = C.scores(docs, classes=6, rounds=2).collect()
    got, expected = [], []
    for r in found:
        got.append((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)))
        assert r.score < 0
    for i, t in rows:
        own = words_of(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected.append((i, len(own), sum(counts[w] > 0 for w in own), n, i is not None and (i, t) not in learned, round(base, 6)))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_score_is_the_class_model(spark, sent):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("text")
    model, counts = C.train(texts, classes=4, rounds=2)
    n = Counter(w for _, t in rows for w in words_of(t))
    total = sum(n.values())
    numbers = {w.decode(): i for w, i in model.symbols.numbers.items()}
    clustered = {w for w in n if n[w] >= C.CLUSTERED * total or w == ""}

    def class_of(w):
        if w in clustered:
            return int(model.word_class[numbers[w]])
        return model.open_first + C.open_class(w.encode())

    size = Counter()
    kinds = Counter()
    for w, c in n.items():
        size[class_of(w)] += c
        kinds[class_of(w)] += 1

    def emission(w):
        c = class_of(w)
        if c < model.open_first:
            return n[w] / size[c]
        if not size[c]:
            return 1.0
        return (n[w] - C.DISCOUNT) / size[c] if n[w] else C.DISCOUNT * kinds[c] / size[c]

    asked = [(0, rows[0][1]), (1, "the unseen word rare1 noun2"), (2, None), (3, "rare1 rare1 rare2")]
    got = {r.doc_id: r.score for r in C.score(spark.createDataFrame(asked, "doc_id long, text string"), model, counts).collect()}
    for i, t in asked:
        path = [class_of(""), *map(class_of, words_of(t))]
        expected = sum(model.transition[a, b] for a, b in zip(path, path[1:])) + sum(math.log10(emission(w)) for w in words_of(t))
        assert abs(got[i] - expected) < 1e-6
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    for c in set(size):
        inside = sum(emission(w) for w in n if class_of(w) == c) + (C.DISCOUNT * kinds[c] / size[c] if c >= model.open_first else 0)
        assert abs(inside - 1) < 1e-9


def test_gains_are_differences_of_the_objective():
    rng = np.random.default_rng(5)
    k, movable = 7, 5
    for _ in range(10):
        n = rng.integers(0, 50, (k, k)).astype(float)
        left, right, own = rng.integers(0, 20, k).astype(float), rng.integers(0, 20, k).astype(float), float(rng.integers(0, 5))
        values = []
        for b in range(movable):
            m = n.copy()
            m[b] += right
            m[:, b] += left
            m[b, b] += own
            values.append(C.objective(m))
        gain = C.gains(n, left, right, own, movable)
        assert np.allclose(np.diff(gain), np.diff(values))


def test_exchange_finds_the_word_classes(spark):
    rows = corpus(600)
    held = corpus(200, seed=9)
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(10_000 + i, t) for i, t in held], "doc_id long, text string")
    found = C.scores(docs, classes=4).where("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) * 0.9
    model, _ = C.train(docs.select("text"), classes=4)
    one = C.train(docs.select("text"), classes=1)[0]
    of = {w.decode(): int(model.word_class[i]) for w, i in model.symbols.numbers.items()}
    kinds = [{of[f"{kind}{i}"] for i in range(30)} for kind in ("noun", "verb")]
    assert not kinds[0] & kinds[1]
    assert one is not None


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_tokens, r.train_tokens, r.score) for r in C.scores(docs).collect()) == [(1, 0, None), (3, 0, None)]
    assert C.scores(docs.where("false")).count() == 0


def test_gains_of_rare_words_are_differences_of_the_objective():
    rng = np.random.default_rng(6)
    k, first, size = 9, 4, 12
    n = rng.integers(60, 120, (k, k)).astype(float)
    was, own = rng.integers(first, k, size), rng.integers(0, 3, size).astype(float)
    sides = rng.integers(0, 3, (2, size, k)).astype(float)
    entries = [(*np.nonzero(side), side[np.nonzero(side)]) for side in sides]
    gain = C.rare_gains(n, was, own, *entries, first)
    for w in range(size):
        left, right = sides[0][w], sides[1][w]
        without = n.copy()
        without[was[w]] -= right
        without[:, was[w]] -= left
        without[was[w], was[w]] -= own[w]
        values = []
        for b in range(first, k):
            m = without.copy()
            m[b] += right
            m[:, b] += left
            m[b, b] += own[w]
            values.append(C.objective(m))
        assert np.allclose(np.diff(gain[w]), np.diff(values))


def two_kinds():
    """Rare words of two kinds, told apart by the words around them and not by their last bytes."""
    rng = random.Random(3)
    rows = [f"the n{i:03d} runs" if rng.random() < 0.5 else f"they v{i:03d} home" for i in (rng.randint(0, 149) for _ in range(800))]
    return [*rows, "the n001 n001 n001 n002 runs", None, "v003 n004 n004", ""]


def test_rare_words_take_part_in_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(C, "CLUSTERED", 2e-2)
    docs = spark.createDataFrame(list(enumerate(two_kinds())), "doc_id long, text string")
    fit, classes = [], []
    for rare in (False, True):
        model, counts = C.train(docs.select("text"), classes=4, rounds=2, rare=rare)
        rows = counts.where("class is not null").collect()
        assert len(rows) > 200 and model.open_total[model.open_unseen < 0].sum() == sum(r.n for r in rows)
        assert np.allclose((10 ** model.transition).sum(axis=1), 1)
        classes.append({bytes(r.word): r["class"] for r in rows})
        fit.append(sum(r.score for r in C.score(docs, model, counts).collect()))
    assert classes[0].keys() == classes[1].keys() and all(c == C.open_class(w) for w, c in classes[0].items())
    assert classes[0] != classes[1] and fit[1] > fit[0]
    kinds = [{c for w, c in classes[1].items() if w.startswith(kind)} for kind in (b"n", b"v")]
    assert len(kinds[0] & kinds[1]) < min(map(len, kinds))
    # the query's scores are those of that exchange
    monkeypatch.setattr(C, "fold", lambda *_: F.lit(0))
    assert sum(r.score for r in C.scores(docs, classes=4, rounds=2).collect()) == pytest.approx(fit[1])


@pytest.mark.parametrize("sent", [C.SENT, 1e-2])
def test_bigrams_after_the_moves_of_rare_words(spark, monkeypatch, sent):
    monkeypatch.setattr(C, "CLUSTERED", 2e-2)
    monkeypatch.setattr(C, "SENT", sent)
    made, calls = C.rare_exchange, []

    def kept(*given):
        calls.append((given, made(*given)))
        return calls[-1][1]

    monkeypatch.setattr(C, "rare_exchange", kept)
    rows = two_kinds()
    texts = spark.createDataFrame([(t,) for t in rows], "text string")
    model, counts = C.train(texts, classes=3, rounds=1, rare=True)
    (_, words, of, before, classes, places), (moved, after) = calls[0]
    kinds = {r["hash"]: r["class"] for r in moved.collect()}
    core = {w.decode(): int(of[i]) for i, w in enumerate(words)}

    def path_of(t):
        return [core[w] if w in core else classes + 1 + kinds[C.hashed(w.encode())] for w in ["", *words_of(t)]]

    expected, rare = np.zeros_like(before), 0
    for t in rows:
        path = path_of(t)
        rare += sum(c > classes for c in path)
        for a, b in zip(path, path[1:]):
            expected[a, b] += 1
    assert places == rare > 0 and np.array_equal(after, expected) and C.objective(after) > C.objective(before)
    # scores walk through these classes
    n, size, sizes = Counter(w for t in rows for w in words_of(t)), Counter(), Counter()
    for w, c in n.items():
        size[path_of(w)[1]] += c
        sizes[path_of(w)[1]] += 1
    found = {r.doc_id: r.score for r in C.score(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), model, counts).collect()}
    for i, t in enumerate(rows):
        path = path_of(t)
        emitted = sum(math.log10((n[w] - (C.DISCOUNT if c > classes else 0)) / size[c]) for w, c in zip(words_of(t), path[1:]))
        assert found[i] == pytest.approx(sum(model.transition[a, b] for a, b in zip(path, path[1:])) + emitted)


def test_tokens_of_many_texts_at_once(monkeypatch):
    rng = random.Random(8)
    alphabet = [bytes([b]) for b in (*range(8, 15), *range(28, 33), 0x85, 0xA0)] + [b"A", b"b", b"C", "É".encode(), b"\x00"]
    texts = [None, b"", b" ", b"a", b" a  B\n", *[b"".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(500)]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).view(pa.string())], ["text"])
    for piece in (C._PIECE, 20):
        monkeypatch.setattr(C, "_PIECE", piece)
        parts = list(C._tokens(batch))
        assert (len(parts) > 100) == (piece == 20)
        got = [p.words[i] for p in parts for i in p.at.tolist()]
        assert got == [w for t in texts for w in [*(t or b"").lower().split(), C.END]]
        assert [n for p in parts for n in p.sizes.tolist()] == [len((t or b"").split()) + 1 for t in texts]
    assert not list(C._tokens(batch.slice(0, 0)))


def test_places_of_rare_words_travel_in_few_rows(spark):
    texts = spark.createDataFrame([("the a b b c end",), ("c the",), (None,)] * 50, "text string").coalesce(1)
    rows = C.rare_places(texts, [b"the", b"end", b""], np.array([0, 1, 2] + [3] * C.OPEN, np.int32), 4).collect()
    assert len(rows) <= 4 and all(h % 4 == r.shard for r in rows for h in r.hash)
    a, b, c = (C.hashed(w) for w in (b"a", b"b", b"c"))
    found = Counter(p for r in rows for p in zip(np.repeat(r.hash, r.times).tolist(), r.before, r.after))
    assert found == {(a, 0, 3): 50, (b, 3, -1): 50, (b, -1, 3): 50, (c, 3, 1): 50, (c, 2, 0): 50}
    assert Counter(p for r in rows for p in r.peers) == {b: 50, c: 50}

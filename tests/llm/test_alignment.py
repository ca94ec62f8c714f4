import hashlib
import random
from collections import Counter

import pytest

from casetrail.llm import alignment, queries

SCHEMA = "doc_id long, text string, keys string, n_a int"


@pytest.fixture(scope="module")
def tokens():
    return alignment._tokens(alignment.tokenizer_path(alignment.BYTE_LEVEL), alignment.tokenizer_path(alignment.PIECES))


def ends(words):
    at, found = 0, []
    for word in words:
        at += len(word)
        found.append(at)
    return found


def brute(tokens, text):
    """Ids of both sides group by group, from the tokenizers over the whole text."""
    if not text:
        return []
    a = tokens.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.model.encode(text)
    sides = [[side.bytes[i] for i in ids] for side, ids in ((tokens.a, a), (tokens.b, b))]
    if any(b"".join(side) != (" " + text).encode() for side in sides):
        return []
    stops = [ends(side) for side in sides]
    groups, i, j = [], 0, 0
    for stop in sorted({*stops[0]} & {*stops[1]}):
        at = stops[0].index(stop, i) + 1, stops[1].index(stop, j) + 1
        groups.append((a[i:at[0]], b[j:at[1]]))
        i, j = at
    return groups


def expected(tokens, docs):
    found = {i: brute(tokens, text) for i, text in docs}
    counts = Counter((a[-1], b[-1]) for groups in found.values() for a, b in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    result = []
    for i, groups in found.items():
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        own = [counts[a[-1], b[-1]] for a, b in groups]
        result.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(groups),
                       sum(n == best[b[-1]] for n, (_, b) in zip(own, groups)), sum(own),
                       hashlib.sha256(listed.encode()).hexdigest() if groups else ""))
    return sorted(result, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LETTERS = [*"ab  \n\t'é>ß本1２ ., 　\x1c\0", "<|endoftext|>", "<s>", "the ", " foo", "'s ", "\r\n", "👩‍👩‍👧", "▁", "ﬁ"]


def made(n, longest, letters=LETTERS):
    draw = random.Random(n)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def test_against_whole_texts(spark, tokens):
    docs = [*enumerate(made(600, 50) + made(50, 400, [x for x in LETTERS if x != "▁"]))]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    found = result(alignment.alignments(rows))
    assert found == expected(tokens, docs)
    assert sum(r[1] > 0 for r in found) > 200


def test_windows_give_the_same(tokens, monkeypatch):
    texts = [" ".join(made(100, 12, [x for x in LETTERS if x != "▁"])), "one  two\nthree four " * 40, "word " * 500 + "word", "▁ " + "word " * 99]
    whole = alignment.align(tokens, [t.encode() for t in texts], with_groups=True)
    monkeypatch.setattr(alignment, "WINDOW", 60)
    tokens.forget()
    parts = alignment.align(tokens, [t.encode() for t in texts], with_groups=True)
    assert parts == whole and whole[0][0] > 100 and whole[3][0] == 0
    assert whole[2][7].count(";") == whole[2][2] - 1
    assert len([*tokens.windows(texts[2])]) > 10


def test_forgetting_words_changes_nothing(tokens, monkeypatch):
    texts = [t.encode() for t in made(300, 40)]
    whole = alignment.align(tokens, texts)
    monkeypatch.setattr(alignment, "_KNOWN", 5)
    monkeypatch.setattr(alignment, "WINDOW", 30)
    assert alignment.align(tokens, texts) == whole


def test_nulls_empty_texts_repeated_rows_and_long_texts(spark, tokens):
    long = "the quick brown fox, again and again; " * 20_000
    docs = [(1, None), (2, ""), (3, " "), (4, "same text"), (4, "same text"), (None, "same text"), (5, long), (6, "\n\n"), (7, "x" * 5_000)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    found = result(alignment.alignments(rows))
    one_each = [(k, t) for k, (_, t) in enumerate(docs)]
    by_row = {r[0]: r[1:] for r in expected(tokens, one_each)}
    assert found == sorted(((i, *by_row[k]) for k, (i, _) in enumerate(docs)), key=str)


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_utf8_has_no_tokens(tokens):
    assert alignment.align(tokens, [b"\xff\xfe abc", b"abc"])[0][:5] == (0, 0, 0, 0, "")


def test_overlaps_are_all_pairs_that_share_bytes(tokens):
    texts = [t for t in made(200, 60) if t]
    for ids in filter(None, tokens.encoded([" " + t for t in texts])):
        one = alignment.Aligned(tokens, [ids])
        frames = [alignment._frame(one.window[:0].repeat(0) if not len(own) else 0 * own, sizes[own], side)
                  for own, sizes, side in zip(ids, tokens.sizes, "ab")]
        found = alignment.overlaps(*frames)
        a, b = ([(s, e) for s, e in zip(f["start"], f[f"end_{x}"])] for f, x in zip(frames, "ab"))
        assert sorted(zip(found["token_a"], found["token_b"])) == [
            (i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e]


def test_linked_ids_stay_within_the_bound(tokens):
    ends_of_b = {}
    for j, word in enumerate(tokens.b.bytes):
        ends_of_b.setdefault(word, []).append(j)
    of_a = {}
    for i, word in enumerate(tokens.a.bytes):
        of_a.setdefault(word, []).append(i)
    pairs = sum(len(ends_of_b.get(w[k:], ())) for w in tokens.a.bytes for k in range(len(w)))
    pairs += sum(len(of_a.get(w[k:], ())) for w in tokens.b.bytes for k in range(1, len(w)))
    assert pairs <= alignment.most_pairs(tokens)


def test_groups_as_text(spark):
    rows = spark.createDataFrame([(1, "abc def", "x", 1)], SCHEMA)
    row = alignment.alignments(rows, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_query(spark, tokens):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(found) == expected(tokens, docs)

import random
import re

import pytest

import corpus_pipeline
from casetrail.llm import simhash

SYLLABLES = {"en": ["the", "ing", "er", "on", "wh", "at"], "de": ["sch", "ung", "ein", "pf", "ge", "lich"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with each thing a stage should drop, in the files of a folder."""
    rng = random.Random(6)
    items = [(i, f"{sentence(rng, 'en', 20)} {sentence(rng, 'en', 8)}") for i in range(8)]
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join(sentence(rng, lang, rng.randint(8, 20)) for _ in range(rng.randint(2, 6)))
        rows.append([i, text, lang, f"src{i % 3}", len(text)])
    for i in range(30):  # copies, but for blanks
        rows.append([300 + i, rows[i][1].replace(" ", " \n"), rows[i][2], "copy", 0])
    for i in range(30, 60):  # near copies: a word more in long texts
        rows.append([300 + i, " ".join([rows[i][1]] * 6), rows[i][2], "near", 0])
        rows.append([400 + i, " ".join([rows[i][1]] * 6) + " ing", rows[i][2], "near", 0])
    for i in range(8):
        rows.append([500 + i, f"{sentence(rng, 'en', 30)} {items[i][1].upper()} {sentence(rng, 'en', 25)}", "en", "leak", 0])
    rows += [[600, None, "en", "none", 0], [601, "", "de", "none", 0], [602, "12 34 5", "en", "none", 0], [603, "... !!", None, "none", 0]]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((before, docs))
    for _, after in seen[:-1]:
        assert after.columns == columns
    before, after = seen[0]
    assert set(before) - set(kept(after)) == {600, 601, 602, 603}
    before, after = seen[1]
    texts = {}
    for i in sorted(before):
        texts.setdefault(re.sub("[\x20\x09-\x0D]+", " ", before[i]), i)
    assert kept(after) == sorted(texts.values())
    before, after = seen[2]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in before.items()}
    stay = []
    reached = set()
    for i in sorted(prints):
        if i not in reached:
            stay.append(i)
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in reached:
                    reached.add(a)
                    todo += [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert kept(after) == stay and len(stay) < len(before)
    before, after = seen[3]
    assert set(before) - set(kept(after)) == {i for i in before if 500 <= i < 600} != set()
    before, after = seen[4]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == set(before)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_run_is_the_stages_in_a_row(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in found.collect()} < {r.doc_id for r in docs.collect()}
    again = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0

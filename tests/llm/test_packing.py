import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casetrail.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " \n\t ", "One two", "It's 42, don't: <|endoftext|> x<|startoftext|>y", "Ünïcode État ça nbsp em\x1cfs\x85nel",
         "é combining ́alone", "word " * 5000, "日本語 text", "a\x0bb\x0cc", "x" * 3000, "ΣΊΣΥΦΟΣ", "🙂🙂 ok", "tab\tsep\r\nline"]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(P.tokenizer_path())


def test_encoding_by_pieces_of_text_is_the_tokenizers(tokenizer):
    encoder = P.Encoder(P.tokenizer_path())
    for text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.ids(text.encode() if text else None) == struct.pack(f"<{len(ids)}I", *ids), text


def test_encoding_of_noise_is_the_tokenizers(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "The", "s", "'s", "'", "_", ".", ",", "!", "$", "%%%", " ", " ", "\n", "\x1c", "\xa0", "é", "e\u0301", "\u0301", "É", "İ", "ß", "ñ",
                "5", "½", "²", "日", "🙂", "-", "<", "|", ">", "<|endoftext|>", "K", "ǅ", "\u200d", "\u00ad", "”", "…", "ΑΣ", "I\u0307"]
    encoder = P.Encoder(P.tokenizer_path())
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 25)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_what_is_forgotten_is_learned_again(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "_MEMO", 12)
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ter", "ran", "sil") for c in ("", ".", ",", "!")]
    encoder = P.Encoder(P.tokenizer_path())
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randint(1, 20)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_and_gapless(seed):
    rng = random.Random(seed)
    capacity = 64
    counts = Counter(min(capacity, int(rng.expovariate(1 / 12)) + 1) for _ in range(rng.choice([0, 1, 50, 3000])))
    slots = P.plan(counts, capacity)
    placed = [(s + k, o, length) for length, _, n, s, o in slots for k in range(n)]
    assert Counter(length for _, _, length in placed) == counts
    for length in counts:
        ranks = sorted(r + k for ln, r, n, _, _ in slots if ln == length for k in range(n))
        assert ranks == list(range(counts[length]))
    by = {}
    for sequence, offset, length in sorted(placed):
        assert by.get(sequence, 0) == offset
        by[sequence] = offset + length
    assert all(v <= capacity for v in by.values()) and sorted(by) == list(range(len(by)))
    # document by document, the same rule
    free = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [f for f in free if f >= length]
        space = min(fits) if fits else capacity
        if fits:
            free.remove(space)
        free.append(space - length)
    assert len(free) == len(by)


def test_documents_come_back(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "One two"), (None, "no id")] + [(100 + i, "same words here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("ids", F.lit(1)).repartition(7)
    found = P.packed_documents(docs, with_ids=True).collect()
    expected = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = struct.pack(f"<{len(ids[at:at + 2048])}I", *ids[at:at + 2048])
            expected[i, k, at, len(own) // 4, zlib.crc32(own), own] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == expected
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in P.sequences(spark.createDataFrame(found)).collect()}
    assert {k: v[0] for k, v in whole.items()} == ends
    for r in found:
        assert whole[r.sequence_id][1][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_no_documents(spark):
    assert P.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import functools
import hashlib
import math
import random
import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from casetrail.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


@functools.cache
def base(text):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(pii.KINDS) for m in PLAIN[kind].finditer(text or "") if good(kind, m[0])]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FIXED = [
    None, "", " ", "mail a.b+c@x-y.co.uk, or me@host", "a@b.c@d.e f@g.h", "a@b.c.d_e@x.y", "é me@é.com ünï@a.b 🙂 z@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0255.01.2.3",
    "256.1.1.1 1.1.1.256 12.34.56.78.9", "4111 1111 1111 1111", "4111-1111-1111-1111 x4111111111111112", "+61 2 9876 5432 +1 (212) 555-0100. +1 2", "+1234567890123456",
    "card 4111 1111 1111 1111+61 2 9876 5432 me@1.2.3.4", "5 5 5 5", "+" * 50 + "1 23456789012", "1 " * 40000, "a" * 60000 + "@", "1.2.3." * 5000, "x@y." * 3000 + "z",
    "9" * 30000, "a.b@" * 4000, "mail\nme@x.com\tand\r+44 20 7946 0958", "+1 234\n567 8901", "00000000000000", "4111 1111 1111 1111 1111"]


def noise(rng):
    alphabet = ["@", ".", "-", "+", " ", "1", "23", "4111", "111", "a", "b_", "%", "(", ")", "\n", "é", "🙂", "0", "255", "me@x.io", "10.0.0.1"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))


WORDS = regex.compile(pii.WORD)


def value(kind, text):
    return f"{kind}:{text.lower() if kind == 'email' else text if kind == 'ip' else re.sub('[^0-9]', '', text)}"


def class_of(entity):
    kind, rest = entity.split(":", 1)
    return {"email": lambda: f"email:@{rest.split('@')[-1]}", "ip": lambda: f"ip:{'.'.join(rest.split('.')[:3])}."}.get(
        kind, lambda: f"{kind}:{rest[:6]}")()


def added(texts, doubt=1.0, generalise=0.6, remove=0.85):
    """The added spans of each text, by comparing every entity with every term of its text."""
    texts = [t or "" for t in texts]
    ents = [{value(kind, t[s:e]) for kind, s, e in base(t)} for t in texts]
    words = [[(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(t)] for t in texts]
    having, keyed, both = defaultdict(set), defaultdict(set), defaultdict(set)
    for i in range(len(texts)):
        terms = {w for _, _, w in words[i] if len(w) >= 2}
        for w in terms:
            having[w].add(i)
        for k in ents[i] | {class_of(e) for e in ents[i]}:
            keyed[k].add(i)
            for w in terms:
                both[k, w].add(i)

    def share(key, w):
        others = len({texts[i] for i in both[key, w]}) - 1
        return len(both[key, w]) / len(having[w]) * others / (others + doubt)

    out = []
    for i in range(len(texts)):
        taken, found = base(texts[i]), []
        for s, e, w in words[i]:
            best = -math.inf
            for x in ents[i]:
                content = math.log(len(texts) / len(keyed[x]))
                p = max(share(x, w), share(class_of(x), w) * len(keyed[x]) / len(keyed[class_of(x)])) if len(w) >= 2 else 0
                if p and content:
                    best = max(best, 1 + math.log(p) / content)
            if best >= generalise - 1e-9 and all(e <= a or b <= s for _, a, b in taken):
                found.append(("remove" if best >= remove - 1e-9 else "generalise", s, e))
        out.append(found)
    return out


def whole(texts, **how):
    kinds = pii.KINDS + pii.ADDED
    return [listed(sorted([*base(t), *more], key=lambda s: (s[1], kinds.index(s[0]), s[2]))) for t, more in zip(texts, added(texts, **how))]


def test_spans_are_those_of_the_plain_patterns_and_of_counting_every_pair(spark):
    rng = random.Random(11)
    texts = FIXED + [noise(rng) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("file", F.lit(1)).repartition(5)
    found = pii.personal_data(docs).collect()
    assert len(found) == len(texts)
    expected = whole(texts)
    assert sum("remove" in e or "generalise" in e for e in expected) > 0
    for r in found:
        assert r.spans == expected[r.doc_id], repr((texts[r.doc_id] or "")[:80])
        own = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in own) for kind in pii.KINDS]


def mixed(rng):
    """Texts in which people, firms and networks share words, some copied, some with a word far from its entity."""
    common = [f"word{i}" for i in range(60)]
    names = [f"Name{i}" for i in range(25)]
    texts = []
    for _ in range(300):
        body = rng.sample(common, rng.randint(3, 8))
        if rng.random() < 0.4:
            who = rng.randrange(25)
            body.insert(rng.randint(0, len(body)), rng.choice([f"p{who}@firm{who % 4}.example", f"10.0.{who % 5}.{who}", f"+44 20 7946 {1000 + who}"]))
            body += ["filler"] * rng.choice([0, 40]) + rng.choice([[names[who] + ",", "again", names[who]], [f"Firm{who % 4}"], []])
        texts.append(" ".join(body))
    return texts + [rng.choice(texts) for _ in range(60)]


def test_added_spans_are_those_of_counting_every_pair(spark):
    texts = mixed(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for how in ({}, {"doubt": 3.0, "generalise": 0.4, "remove": 0.7}):
        expected = whole(texts, **how)
        assert sum("remove" in e or "generalise" in e for e in expected) > 10
        assert {r.doc_id: r.spans for r in pii.personal_data(docs, **how).collect()} == dict(enumerate(expected))


def test_hot_keys_and_long_lists_give_the_same_spans(spark, monkeypatch):
    """Joins by key instead of broadcast lists, and a third of all rows with one entity."""
    monkeypatch.setattr(pii, "MOST_TERMS", 0)
    texts = mixed(random.Random(4)) + [f"mail hot@busy.example, ask Hotname {i % 40}" for i in range(170)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.spans for r in pii.personal_data(docs).collect()} == dict(enumerate(whole(texts)))


def test_a_word_far_off_is_marked_at_every_place(spark):
    rng = random.Random(2)
    filler = " ".join(["plain"] * 60)
    texts = [f"me@x.example {filler} Zebulon wrote {i} {filler} ZEBULON." for i in range(10)] + [f"plain wrote {i}" for i in range(300)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitised(docs).collect():
        assert "zebulon" not in r.text.lower()
        assert r.text.count("[REMOVED]") == (2 if "[EMAIL]" in r.text else 0)


def test_an_entity_met_once_is_told_by_its_class(spark):
    texts = [f"p{i}@corp.example works at Corpname on {i}" for i in range(6)] + [f"works at home on {i}" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert found == dict(enumerate(whole(texts)))
    assert found[0].split(",")[1].startswith("generalise")


def corpus():
    """An address that always stands near one odd name, among names and words that stand everywhere."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(200):
        left, right = rng.sample(words, 3), rng.sample(words, 3)
        if i % 20 == 0:
            rows.append(f"{' '.join(left)} Zebulon, writes boss@corp.example today {' '.join(right)}")
        elif i % 20 == 1:
            rows.append(f"{' '.join(left)} writes one{i}@mail.example today {' '.join(right)}")
        else:
            rows.append(f"{' '.join(left)} writes today {' '.join(right)} 10.0.0.{i % 7}")
    return rows


def test_disclosing_terms_are_added_where_they_stand(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, text in enumerate(texts):
        expected = base(text)
        if i % 20 == 0:
            at = text.index("Zebulon")
            expected = sorted([*expected, ("remove", at, at + 7)], key=lambda s: s[1])
        assert found[i].spans == listed(expected), text
        assert found[i].base_sha256 == hashlib.sha256(listed(base(text)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitised(docs.withColumn("all", F.lit(1))).collect()}
    assert clean[0] == texts[0].replace("Zebulon", "[REMOVED]").replace("boss@corp.example", "[EMAIL]")
    assert clean[2] == re.sub(r"10\.0\.0\.\d", "[IP]", texts[2])


def test_disclosure_is_the_share_of_information(spark):
    texts = corpus() + ["Zebulon alone here"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # ten of thirteen documents with the name hold the address, in ten different texts
    expected = 1 + math.log(10 / 13 * 9 / 10) / -math.log(10 / len(texts))
    for limit, kind in ((expected - 0.001, "remove"), (expected + 0.001, "generalise")):
        spans = pii.personal_data(docs.where("true"), generalise=0.5, remove=limit).where("doc_id = 0").first().spans
        assert spans.split(",")[0].startswith(kind + ":")


def test_copies_prove_nothing(spark):
    texts = ["Odd Quixote writes to q@corp.example at night"] * 30 + ["plain words here"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.spans for r in pii.personal_data(docs).collect()} == {listed(base(texts[0])), ""}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "me@x.io"), (1, None), (1, None), (2, "+44 20 7946 0958")], "doc_id long, text string")
    assert sorted([(r.doc_id, r.spans) for r in pii.personal_data(docs).collect()], key=str) == sorted(
        [(None, "email:0:7"), (1, ""), (1, ""), (2, "phone:0:16")], key=str)
    assert sorted([r.text for r in pii.sanitised(docs).collect()], key=str) == sorted([None, None, "[EMAIL]", "[PHONE]"], key=str)
    assert pii.personal_data(docs.where("false")).count() == 0
    assert pii.sanitised(docs.where("false")).count() == 0

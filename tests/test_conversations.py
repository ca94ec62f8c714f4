import hashlib
import json
import random
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from casetrail.operators import conversations as C
from casetrail.sources.jsonl import write_dataset


def turn_table(seed=4, n=60):
    """Conversations 0..: one of them very long, some of them copies."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        size = 150 if conv == 7 else rng.randrange(1, 6)
        state = rng.getstate()
        if conv % 5 == 4:
            rng.seed(99)
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), f" text {rng.randrange(3)}\n")
                 for t in range(size if conv % 5 != 4 else 3)]
        rng.setstate(state)
    return rows


def grouped(rows):
    by = defaultdict(list)
    for conv, t, role, text in sorted(rows):
        by[conv].append((t, role, text))
    return by


@pytest.mark.parametrize("piecewise", [False, True])
def test_shaping_against_brute_force(spark, request, piecewise):
    if piecewise:
        request.getfixturevalue("tiny_groups")
    rows = turn_table()
    turns = C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    trimmed = C.trim_to_assistant(turns)
    expected = {}
    for conv, said in grouped(rows).items():
        last = max((t for t, role, _ in said if role == "assistant"), default=None)
        if last is not None:
            expected[conv] = [x for x in said if x[0] <= last]
    found = grouped([tuple(r) for r in trimmed.rows.select("conv_id", "turn", "role", "text").collect()])
    assert found == expected

    merged = C.merge_turns(trimmed).rows.collect()
    want = []
    for conv, said in expected.items():
        for role, run in groupby(said, key=lambda x: x[1]):
            run = list(run)
            want.append((conv, run[0][0], role, "\n".join(text for _, _, text in run), len(run)))
    assert sorted((r.conv_id, r.turn, r.role, r.text, r.n_turns) for r in merged) == sorted(want)

    prints = {r.conv_id: r.fingerprint for r in C.fingerprints(trimmed).collect()}
    content = {conv: tuple((role, text.strip()) for _, role, text in said) for conv, said in expected.items()}
    same = defaultdict(set)
    for conv, value in content.items():
        same[value].add(conv)
    groups = defaultdict(set)
    for conv, value in prints.items():
        groups[value].add(conv)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, groups.values()))
    statuses = {r.conv_id: r.status for r in C.first_copies(C.fingerprints(trimmed), "conv_id").collect()}
    assert {c for c, s in statuses.items() if s == "written"} == {min(convs) for convs in same.values()}

    records = C.to_records(trimmed, min_turns=2)
    assert {r.conv_id: [(m.role, m.content) for m in r.messages] for r in records.collect()} == {
        conv: [(role, text) for _, role, text in said] for conv, said in expected.items() if len(said) >= 2}


def test_a_run_is_one_message_whatever_its_length(spark):
    rows = [(1, t, "user", str(t)) for t in range(12_000)] + [(1, 12_000, "assistant", "x")]
    merged = C.merge_turns(C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert [(r.turn, r.text) for r in merged.rows.orderBy("turn").collect()] == [
        (0, "\n".join(map(str, range(12_000)))), (12_000, "x")]


def test_fingerprints_tell_nulls_and_borders_apart(spark):
    rows = [(1, 0, None, "user"), (2, 0, "user", None), (3, 0, "user", ""), (4, 0, "us", "er"), (5, 0, "user", None)]
    turns = C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    prints = {r.conv_id: r.fingerprint for r in C.fingerprints(turns).collect()}
    assert prints[2] == prints[5] and len(set(prints.values())) == 4


def test_contract(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "robot", "b"), (2, 2, "user", " "),
            (3, 0, "user", " \t"), (3, 1, "assistant", "b"), (4, 0, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "user", "b"),
            (6, 0, "assistant", "a"), (6, 1, "user", "b")]
    checked = C.contract(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.first_error, r.faulty_turn) for r in checked.collect()} == {
        1: (None, None), 2: ("invalid role", 1), 3: ("empty content", 0), 4: ("fewer than two messages", None),
        5: ("no assistant message", None), 6: ("does not end with an assistant message", None)}
    assert [r.conv_id for r in C.contract_errors(checked, 2).collect()] == [2, 3]


ROWS = [
    {"messages": [{"role": "User ", "content": " hi é  "}, {"role": "assistant", "content": "yo \"q\" \\ /"}]},
    {"instruction": "Give ", "output": "Do", "input": "more"}, {"instruction": "Give", "output": "Do", "input": ""},
    {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": "r"}, {"x": 1}, [1],
    {"conversations": [{"from": "human", "value": "q"}, {"role": "GPT", "content": "a"}]},
    {"messages": [{"role": "user", "content": "hi é"}, {"role": "assistant", "content": "yo \"q\" \\ /"}]},
    {"messages": [{"role": "user", "content": 5}, {"role": "assistant", "content": "yo"}]},
    {"messages": [{"role": "assistant", "content": "yo"}, {"role": "user", "content": "z"}]},
    {"messages": ["x", "y"]}, {"instruction": "a", "output": 3}, {"messages": []},
]


def fingerprint(messages):
    payload = json.dumps(messages, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(payload.encode()).hexdigest()


def test_records(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in ROWS) + "\n", encoding="utf-8")
    sources = [{"name": "a", "path": str(path), "license": "x", "notes": "n"},
               {"name": "b", "path": str(path), "license": "y", "limit": 4}, {"name": "off", "enabled": False, "license": ""}]
    records = C.collect_records(C.read_sources(spark, sources), eval_fraction=0.3).cache()
    own = records.where("source = 'a'").orderBy("entry").collect()
    assert [r.status for r in own] == ["written"] * 5 + ["bad"] * 2 + ["written", "duplicate"] + ["bad"] * 5
    assert own[1].messages[0].content == "Give\n\nmore" and own[7].messages[0].role == "user"
    assert own[0].fingerprint == fingerprint([{"role": "user", "content": "hi é"}, {"role": "assistant", "content": 'yo "q" \\ /'}])
    assert own[9].error == "message 0 has empty content" and own[5].error == "unsupported row shape"
    assert [r.status for r in records.where("source = 'b'").collect()] == ["duplicate"] * 4
    stats = {(r.source, r.status): r.n for r in C.source_stats(records).collect()}
    assert stats == {("a", "written"): 6, ("a", "duplicate"): 1, ("a", "bad"): 7, ("b", "duplicate"): 4}
    write_dataset(C.record_lines(records), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 6 and set(back.columns) == {"messages", "source", "license", "notes", "split"}

    capped = C.collect_records(C.read_sources(spark, sources), max_total=2)
    assert [r.status for r in capped.orderBy("entry").collect()] == ["written", "written"]


def test_every_row_of_many_files_counts_once(spark, tmp_path):
    def row(n):
        return json.dumps({"prompt": f"question {n}", "completion": "answer"})

    for name in ("b", "a", "c d"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(row(f"{name}{n % 18}") for n in range(20)) + "\n")
    source = {"name": "many", "path": str(tmp_path), "license": "x"}
    records = C.collect_records(C.read_sources(spark, [source])).collect()
    assert Counter(r.status for r in records) == {"written": 54, "duplicate": 6}
    assert len({r.entry for r in records}) == 60
    order = [r.messages[0].content[9:] for r in sorted(records, key=lambda r: tuple(r.entry))]
    assert order == [f"{name}{n % 18}" for name in ("a", "b", "c d") for n in range(20)]
    assert all(r.file.endswith(".jsonl") and r.place is not None for r in records)
    first = C.read_sources(spark, [{**source, "limit": 25}]).collect()
    assert sorted(tuple(r.entry) for r in first) == sorted(tuple(r.entry) for r in records)[:25]
    capped = C.collect_records(C.read_sources(spark, [source]), max_total=21).collect()
    assert Counter(r.status for r in capped) == {"written": 21, "duplicate": 2}


def test_sources_must_be_ready(spark, tmp_path):
    for license_name in ("", "check-before-use"):
        with pytest.raises(ValueError, match="license"):
            C.ready_sources([{"name": "a", "path": "x", "license": license_name}])
    path = tmp_path / "bad.jsonl"
    path.write_text('{"messages": []}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl at .*: invalid JSON"):
        C.read_sources(spark, [{"name": "a", "path": str(path), "license": "x"}]).collect()


def test_split_card_and_contamination(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"),
                                      F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    rows = rows.withColumn("split", C.split_of(F.col("fingerprint"), 0.05))
    card = C.dataset_card(rows).collect()
    assert sum(r.n_rows for r in card) == 20_000 and all(r.share == 0.25 for r in card)
    assert 0.04 < sum(r.n_eval for r in card) / 20_000 < 0.06
    held = rows.where("split = 'eval'")
    train = rows.where("split = 'train'").unionByName(held.limit(7))
    kept, removed = C.decontaminate(train, held)
    assert removed.first().n_removed == 7 and kept.where("split = 'eval'").count() == 0


def test_answers(spark):
    rows = [("Use [::-1] here", ["[::-1]"]), ("X-Frame-Options", ["x-frame-options"]), ("no", ["yes"]), ("any", None), ("a", [])]
    scored = C.score_answers(spark.createDataFrame(rows, "output string, expect array<string>")).first()
    assert (scored.passed, scored.total) == (4, 5)


def test_a_run_of_any_length_is_rows(spark):
    turns = spark.range(300_000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "'said' as text").unionByName(
        spark.createDataFrame([(2, 0, "user", "a"), (2, 1, "user", None), (2, 2, "assistant", "b"), (3, 0, "user", "a")],
                              "conv_id long, turn long, role string, text string"))
    found = {(r.conv_id, r.turn): r for r in C.runs(C.run_pieces(C.turns_of(turns))).collect()}
    assert found[1, 0].n_turns == 300_000 and found[1, 0].n_chars == 5 * 300_000 - 1
    assert {k: (r.role, r.n_turns) for k, r in found.items() if k[0] > 1} == {(2, 0): ("user", 2), (2, 2): ("assistant", 1), (3, 0): ("user", 1)}
    assert found[3, 0].digest != found[2, 0].digest


def test_the_digest_of_a_run_is_that_of_its_joined_text(spark):
    """Pieces of one text over two turns differ from those in one; texts that are null are left out; ends of batches are no ends of runs."""
    rows = [(1, t, "user", str(t)) for t in range(25_000)] + [
        (2, 0, "user", "a"), (2, 1, "user", None), (2, 2, "user", "é"), (2, 3, "assistant", ""), (2, 4, "user", None), (None, 0, "user", "a\né")]
    turns = C.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    found = {(r.conv_id, r.turn): r for r in C.digested_runs(C.run_pieces(turns)).collect()}
    sha = {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in {
        (1, 0): "\n".join(map(str, range(25_000))), (2, 0): "a\né", (2, 3): "", (2, 4): None, (None, 0): "a\né"}.items()}
    assert {k: r.digest for k, r in found.items()} == sha
    assert found[2, 0].pieces != found[None, 0].pieces and found[1, 0].n_turns == 25_000

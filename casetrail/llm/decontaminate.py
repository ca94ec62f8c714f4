"""Benchmark decontamination: a BM25 index of the test items, queried by every passage with block-max WAND.

A document is cut into passages of ``2 s`` words at every ``s`` words, ``s`` being at least the length of the longest
item, so an item that was copied lies in one passage whole. A passage scores an item by the BM25 weights of the item's
terms it has, divided by the weight of all the item's terms: 1 is an item whose terms are all there.

All items with a score of ``threshold`` or more are retrieved. The bounds are those of block-max WAND, for all passages of a
batch at once: of a passage's terms in order of their greatest weight, those that cannot reach the threshold together
bring up no item; of the other terms' postings, a block whose greatest weight cannot reach it with all other terms is
passed over; what is left is summed, and completed by the terms put aside only where the sum can still reach the threshold.

A retrieved item is then verified: of the five-word shingles of its question, and of its answer, at least 0.8 must stand
in the passage. Where the table gives no answer, the last sentence counts as one, and it is enough as well that 0.8 of the
shingles of the whole item stand there: a word changed in a short sentence does not hide a copy.

The index goes to the tasks; documents are not shuffled. An index holds at most ``shard`` items; more items are indexed
in several shards, each with a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from casetrail.llm.rows import col, lean, packed, unpacked

THRESHOLD = 0.5
OVERLAP = 0.8
WIDTH = 5
SHARD = 20_000
LEAST_STEP = 64
K1, B = 1.2, 0.75
BLOCK = 16
"""Postings in a block with a bound of its own."""
WORDS = 100_000
CELLS = 4_000_000
"""Passages times items whose scores are held at a time."""
_MEMO = 100_000
_NOT_A_WORD, _UNKNOWN = -2, -1
_INNER = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def term(chunk: str) -> str:
    """The word in a piece of text without white space: its letters and digits, lower-cased; may be empty."""
    word = chunk.lower()
    return word if word.isalnum() else _INNER.sub("", word)


def question_and_answer(text: str | None) -> tuple[str, str]:
    """The text up to its last sentence, and that sentence; a text of one sentence is a question without an answer."""
    parts = _SENTENCE.split((text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` ids."""
    if len(ids) < width or not width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        total = (total ^ (ids[k:len(ids) - width + 1 + k].astype(np.int64) + 3).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


class Words(dict):
    """Pieces of text without white space to term numbers, remembered for the pieces seen lately."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, chunk: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        word = term(chunk)
        found = self[chunk] = self.numbers.get(word, _UNKNOWN) if word else _NOT_A_WORD
        return found

    def ids(self, text: str) -> np.ndarray:
        chunks = text.split()
        found = np.fromiter(map(self.__getitem__, chunks), np.int32, len(chunks))
        return found[found != _NOT_A_WORD]

    def __reduce__(self):
        return Words, (self.numbers,)


class Index:
    """An inverted index of items. Terms are numbered in order of their greatest weight in any item."""

    def __init__(self, items: list[tuple[int, str, str | None]], threshold: float = THRESHOLD):
        """``items``: number, question and answer; number, text and None where no answer is given."""
        texts = [[term(c) for c in f"{q} {a or ''}".split()] for _, q, a in items]
        texts = [[w for w in words if w] for words in texts]
        items, texts = zip(*[(i, t) for i, t in zip(items, texts) if t]) if any(texts) else ((), ())
        self.items, self.threshold = [i for i, _, _ in items], threshold
        self.longest = max(map(len, texts), default=0)
        mean = sum(map(len, texts)) / max(1, len(texts))
        found = [dict(zip(*np.unique(words, return_counts=True))) for words in texts]
        df: dict[str, int] = {}
        for counts in found:
            for w in counts:
                df[w] = df.get(w, 0) + 1
        weights: dict[str, list[tuple[int, float]]] = {w: [] for w in df}
        for i, counts in enumerate(found):
            norm = K1 * (1 - B + B * len(texts[i]) / mean)
            own = {w: np.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
            total = sum(own.values())
            for w, x in own.items():
                weights[w].append((i, x / total))
        order = sorted(weights, key=lambda w: (max(x for _, x in weights[w]), w))
        self.words = Words({str(w): k for k, w in enumerate(order)})
        self.most = np.array([max(x for _, x in weights[w]) for w in order])
        lengths = np.array([len(weights[w]) for w in order], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.item = np.array([i for w in order for i, _ in weights[w]], np.int64)
        self.weight = np.array([x for w in order for _, x in weights[w]])
        blocks = -(-lengths // BLOCK)
        self.block_starts = np.concatenate([[0], np.cumsum(blocks)])
        first = np.concatenate([s + np.arange(0, n, BLOCK) for s, n in zip(self.starts, lengths)]) if len(order) else self.starts[:0]
        self.block_first = first.astype(np.int64)
        self.block_end = np.minimum(self.block_first + BLOCK, np.repeat(self.starts[1:], blocks))
        self.block_most = np.maximum.reduceat(self.weight, self.block_first) if len(first) else self.weight[:0]
        self.parts = []
        self.given = [a is not None for _, _, a in items]
        for _, q, a in items:
            ids = [self.words.ids(x) for x in (*((q, a) if a is not None else question_and_answer(q)), f"{q} {a or ''}")]
            self.parts.append([(min(WIDTH, len(x)), np.unique(_shingles(x, min(WIDTH, len(x))))) for x in ids])

    @property
    def step(self) -> int:
        return max(LEAST_STEP, self.longest)

    @property
    def words_at_once(self) -> int:
        """Words of texts whose passages are searched at a time, which bounds a task's memory."""
        return self.step * max(16, min(WORDS // self.step, CELLS // max(1, len(self.items))))

    def search(self, passage: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) that reach the threshold, given pairs of passage and known term (repeats allowed)."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(word):
            return none
        terms, n, least = len(self.most), len(self.items), self.threshold - 1e-9
        pairs = np.unique(passage * terms + word)
        passage, word = np.divmod(pairs, terms)  # by passage, terms of little weight first
        most = self.most[word]
        begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        spans = np.diff(np.concatenate([begins, [len(pairs)]]))
        group = np.repeat(np.arange(len(begins)), spans)
        running = np.cumsum(most)
        before = (running[begins] - most[begins])[group]
        bound = running[begins + spans - 1][group] - before
        low = running - before < least  # together with all lighter terms below the threshold
        aside = np.add.reduceat(np.where(low, most, 0.0), begins)
        # postings of the other terms, but for blocks that cannot reach the threshold: no hit has a posting there
        some = np.flatnonzero(~low & (bound >= least))
        blocks = self.block_starts[word[some] + 1] - self.block_starts[word[some]]
        at = np.repeat(some, blocks)
        block = _ranges(self.block_starts[word[some]], blocks)
        able = self.block_most[block] + bound[at] - most[at] >= least
        at, block = at[able], block[able]
        sums = self._summed(group[at], self.block_first[block], self.block_end[block], len(begins))
        able = (sums > 0) & (sums + aside[:, None] >= least)
        # the terms put aside, where they decide
        rest = np.flatnonzero(low & able.any(axis=1)[group])
        sums += self._summed(group[rest], self.starts[word[rest]], self.starts[word[rest] + 1], len(begins))
        where, item = np.nonzero(able & (sums >= least))
        return passage[begins[where]], item, sums[where, item]

    def _summed(self, group: np.ndarray, first: np.ndarray, end: np.ndarray, groups: int) -> np.ndarray:
        """The weights of runs of postings, added up by group and item."""
        sizes, n = end - first, len(self.items)
        posting = _ranges(first, sizes)
        codes = np.repeat(group * n, sizes) + self.item[posting]
        return np.bincount(codes, self.weight[posting], groups * n).reshape(groups, n)

    def verified(self, item: int, ids: np.ndarray) -> tuple[float, float, float]:
        """The shares of the shingles of an item's question, answer and whole that stand in a passage; 1 for a part without words."""
        shares = []
        for width, own in self.parts[item]:
            there = np.isin(own, _shingles(ids, width)).sum() if width else 1
            shares.append(float(there / max(1, len(own))))
        return shares[0], shares[1], shares[2]

    def matches(self, texts: list[str | None]) -> Iterator[list[tuple[int, float, float, float, float]]]:
        """For every text its verified items: number, score and the three shares, of the passage that fits best."""
        found: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in texts]
        waiting, words = [], 0
        for doc, text in enumerate(texts):
            for ids in self._runs(text):
                waiting.append((found[doc], ids))
                words += len(ids)
                if words >= self.words_at_once:
                    self._look(waiting)
                    waiting, words = [], 0
        self._look(waiting)
        for best in found:
            yield [(self.items[i], *shares) for i, shares in sorted(best.items())]

    def _runs(self, text: str | None) -> Iterator[np.ndarray]:
        """A text's words in runs of whole passages, a run for all but very long texts."""
        ids = self.words.ids(text) if text and self.items else np.zeros(0, np.int32)
        step, most = self.step, self.words_at_once // self.step
        passages = max(1, -(-len(ids) // step) - 1)  # the last one ends with the text
        for at in range(0, passages if len(ids) else 0, most):
            yield ids[at * step:(min(at + most, passages) + 1) * step]

    def _look(self, runs: list[tuple[dict[int, tuple[float, float, float, float]], np.ndarray]]) -> None:
        """Search all passages of some runs at once and put what is verified into their dictionaries."""
        step, starts, passage, word, count = self.step, [], [], [], 0
        for _, ids in runs:
            starts.append(count)
            n = max(1, -(-len(ids) // step) - 1)
            known = np.flatnonzero(ids >= 0)
            for place in (known // step, known // step - 1):
                inside = (place >= 0) & (place < n)
                passage.append(place[inside] + count)
                word.append(ids[known[inside]].astype(np.int64))
            count += n
        if not runs:
            return
        for p, i, score in zip(*self.search(np.concatenate(passage), np.concatenate(word))):
            run = int(np.searchsorted(starts, p, "right")) - 1
            best, ids = runs[run]
            at = (int(p) - starts[run]) * step
            question, answer, whole = self.verified(int(i), ids[at:at + 2 * step])
            if min(question, answer) >= OVERLAP or whole >= OVERLAP and not self.given[int(i)]:
                best[int(i)] = max(best.get(int(i), (0.0, 0.0, 0.0, 0.0)), (float(score), question, answer, whole))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...`` of ``sizes[k]`` numbers, for all k in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)


def _items(benchmark: DataFrame, item_id: str, text: str, answer: str | None, shard: int) -> Iterator[list[tuple[int, str, str | None]]]:
    """The items in shards of about ``shard``, each small enough for one index."""
    given = [col(item_id).alias("item_id"), col(text).cast("string").alias("text")]
    given.append((col(answer) if answer else F.lit(None)).cast("string").alias("answer"))
    items = benchmark.select(*given)
    shards = max(1, -(-items.count() // shard))
    part: Column = F.pmod(F.xxhash64("text"), F.lit(shards))
    for k in range(shards):
        rows: list[Row] = items.where(part == k).distinct().collect()
        yield [(r.item_id, r.text or "", r.answer) for r in rows]


MATCHES = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double, overlap: double>>"


def _matched(rows: DataFrame, index: Index, text: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(None).cast(MATCHES).alias("found")).schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                               ("answer_overlap", pa.float64()), ("overlap", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value.as_py() for value in batch.column(text)]
            found = [[dict(zip(names, m)) for m in matches] for matches in sent.value.matches(texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, kind)], [*kept, "found"])

    return rows.mapInArrow(lean(matched), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", item_answer: str | None = None, threshold: float = THRESHOLD,
                 shard: int = SHARD) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``, ``overlap`` (of the whole item): one row for
    every document row and item that stands in it, of the passage that fits best.

    Null and empty texts and items have no words and match nothing; rows that are repeated are each looked at. Equal
    items of one number count once. Without documents or items there are no rows. Other columns are not looked at.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    found = [_matched(rows, Index(items, threshold), "text").select("doc_id", F.inline("found"))
             for items in _items(benchmark, item_id, item_text, item_answer, shard)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          item_answer: str | None = None, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    for items in _items(benchmark, item_id, item_text, item_answer, shard):
        rows = packed(docs, body=col(text).cast("string"))
        docs = unpacked(_matched(rows, Index(items, threshold), "body").where(F.size("found") == 0))
    return docs

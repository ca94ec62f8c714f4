"""Language-model scores from a Brown class-based bigram model.

Words are what ASCII white space parts, with A-Z lower-cased; every text ends with an end token. Counts of all words are
taken over all training documents. Words that make up at least ``CLUSTERED`` of all tokens (so at most 1 / CLUSTERED of
them) get their class by exchange: starting from classes by frequency, every word moves to the class that raises the
likelihood of the class bigrams most, shard by shard with own copies of the class counts, again and again. All rarer words
start in open classes by their last bytes and move among these by the same exchange, once, as a table sharded by a hash, with as many
shards as their number asks for; the moves stay if they raise the objective. A rarer word has its own emission probability from its own
count. A word never seen has the open class of its last bytes.

    P(text) = product of P(class | class before) * P(word | class)

Class transitions are interpolated with class frequencies, emissions are discounted in favour of one unseen word per
open class. The end token is a class of its own and stands before the first word.

Texts are scored where they are with the counts of words that make up at least ``SENT`` of all tokens (at most 1 / SENT
words, a bound by their definition). Rarer words are joined with their counts, as numbers in arrays: 64-bit hashes of words, dealt
by hash, and the number of the block of documents. At 10^9 rare words about one pair in a few dozen corpora shares a hash, and then shares its count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.rows import col, fold, held_out, lean
from casetrail.session import stash

FOLDS, HELD_OUT = 7, 2
CLASSES = 48
OPEN = 64
"""Classes of rare words, which new words can join."""
CLUSTERED = 2.5e-5
SENT = 2e-6
ROUNDS = 4
SHARDS = 16
DISCOUNT = 0.75
END = b""
_HELD = 400_000
_PAIRS = 4_000_000
_MEMO = 300_000
_SHARD_ROWS = 400_000
"""Occurrences of rarer words in one shard, on average."""
_PIECE = 8_000_000
"""Bytes of text whose tokens are held at once; a longer text is held whole."""
_AT_ONCE = 512
"""Rarer words that are compared with the same class counts, at most; in small shards a 64th of the words, lest all run to one class."""


def hashed(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >> 63 else value


def open_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % OPEN


@dataclass
class Tokens:
    """The tokens of some texts, one text after the other: each distinct token once, and their places."""

    words: list[bytes]
    at: np.ndarray
    """The place in ``words`` of each token; every text ends with the end token, which so stands before the next one too."""
    sizes: np.ndarray
    """Tokens of each text."""

    @property
    def text(self) -> np.ndarray:
        """The number of the text of each token."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def of(self, numbers: dict[bytes, int]) -> np.ndarray:
        """The number of each distinct token."""
        return np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))


def tokens(texts: pa.Array) -> Tokens:
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    # by way of numpy, which makes the bytes objects ten times as fast as to_pylist
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    at, sizes = coded.indices.to_numpy(), split.value_lengths().to_numpy()
    if END in words:  # what stands before leading and after trailing white space
        kept = at != words.index(END)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        at = at[kept]
    else:
        words.append(END)
    whole = np.full(len(at) + len(sizes), words.index(END), np.int64)
    inner = np.ones(len(whole), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    whole[inner] = at
    return Tokens(words, whole, sizes + 1)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about as much text as is held at once."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // _PIECE
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])).tolist()
    for low, high in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(low, high - low)


def _tokens(batch: pa.RecordBatch) -> Iterator[Tokens]:
    for part in _parts(batch):
        yield tokens(part.column("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary; empty: the end token), ``n``: all tokens of the column ``text``, added up per task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for own in _tokens(batch):
                for word, n in zip(own.words, np.bincount(own.at, minlength=len(own.words)).tolist()):
                    held[word] += n
                if len(held) > _HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return texts.select("text").mapInArrow(lean(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols(dict):
    """Words to the numbers of a table; other words to ``-1 - open class``, remembered for those seen lately."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__(numbers)
        self.most = len(numbers) + _MEMO
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.numbers)
        found = self[word] = -1 - open_class(word)
        return found

    def __reduce__(self):
        return Symbols, (self.numbers,)


def class_bigrams(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """``a``, ``b``, ``n``: neighbours, as numbers of ``words`` or, from ``len(words)`` on, of open classes. The end token is
    before the first word and after the last."""
    size = len(words) + OPEN
    sent = texts.sparkSession.sparkContext.broadcast(Symbols({w: i for i, w in enumerate(words)}))
    end = words.index(END)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, waiting = sent.value, [], 0

        def added() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            for own in _tokens(batch):
                ids = own.of(numbers)
                ids = np.where(ids < 0, len(words) - 1 - ids, ids)[own.at]
                held.append(np.concatenate([[end], ids[:-1]]) * size + ids)
                waiting += len(ids)
                if waiting > _PAIRS:
                    yield added()
                    held, waiting = [], 0
        if held:
            yield added()

    codes = texts.select("text").mapInArrow(lean(paired), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return codes.select((F.col("code") / size).cast("long").cast("int").alias("a"),
                        (F.col("code") % size).cast("int").alias("b"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def objective(bigrams: np.ndarray) -> float:
    """The part of the log-likelihood of class bigrams that classes decide."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(axis=0)).sum() - _xlogx(bigrams.sum(axis=1)).sum())


def gains(n: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, movable: int) -> np.ndarray:
    """How much the objective rises when a word that is in no class joins each of the first ``movable`` classes.

    ``n``: class bigrams without the word; ``left``, ``right``: how often each class stands before and after it; ``own``:
    how often it follows itself.
    """
    k = np.arange(movable)
    rows = (_xlogx(n[:movable] + right) - _xlogx(n[:movable])).sum(axis=1)
    columns = (_xlogx(n[:, :movable] + left[:, None]) - _xlogx(n[:, :movable])).sum(axis=0)
    corner = n[k, k]
    both = _xlogx(corner + left[k] + right[k] + own) - _xlogx(corner + right[k]) - _xlogx(corner + left[k]) + _xlogx(corner)
    out, into = n.sum(axis=1) + left, n.sum(axis=0) + right  # its neighbours' share is there for any class
    r, c = right.sum() + own, left.sum() + own
    return rows + columns + both - (_xlogx(out[:movable] + r) - _xlogx(out[:movable])) - (_xlogx(into[:movable] + c) - _xlogx(into[:movable]))


def _folded(sent, k: int):
    """Neighbours of each word by class (kind 1: after it, 2: before it, 3: itself) and class bigrams (kind 0), added up per batch."""
    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b, n = (f[c].to_numpy() for c in ("a", "b", "n"))
            ca, cb, same = sent.value[a].astype(np.int64), sent.value[b].astype(np.int64), a == b
            for kind, code, weight in ((0, ca * k + cb, n), (1, a[~same].astype(np.int64) * k + cb[~same], n[~same]),
                                       (2, b[~same].astype(np.int64) * k + ca[~same], n[~same]), (3, a[same].astype(np.int64) * k, n[same])):
                codes, where = np.unique(code, return_inverse=True)
                yield pd.DataFrame({"kind": np.int32(kind), "code": codes, "n": np.bincount(where, weight, len(codes)).astype(np.int64)})

    return folded


def _moved(sent, bigrams: np.ndarray, words: int, classes: int):
    """The words of one shard move one after the other, in a copy of the class bigrams."""
    k = len(bigrams)

    def moved(frame: pd.DataFrame) -> pd.DataFrame:
        n, own, around = bigrams.copy(), {}, {1: {}, 2: {}}
        for kind, code, count in zip(frame["kind"].tolist(), frame["code"].tolist(), frame["n"].tolist()):
            word, c = divmod(code, k)
            if kind == 3:
                own[word] = count
            else:
                around[kind].setdefault(word, np.zeros(k))[c] += count
        found = {}
        for word in sorted(set(around[1]) | set(around[2]) | set(own)):
            if word >= words:
                continue
            right, left = (around[kind].get(word, np.zeros(k)) for kind in (1, 2))
            was, same = int(sent.value[word]), own.get(word, 0)
            n[was] -= right
            n[:, was] -= left
            n[was, was] -= same
            np.maximum(n, 0, out=n)  # neighbours may have moved meanwhile
            gain = gains(n, left, right, same, classes)
            to = int(np.argmax(gain))
            to = to if gain[to] > gain[was] + 1e-9 else was
            n[to] += right
            n[:, to] += left
            n[to, to] += same
            found[word] = to
        return pd.DataFrame({"word": np.array(list(found.keys()), np.int64), "class": np.array(list(found.values()), np.int32)})

    return moved


def exchange(pairs: DataFrame, words: int, start: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol after exchange rounds over the landed ``pairs``; ``start``: classes to begin with.

    The first ``words`` symbols move among the first ``classes`` classes, the others keep their class. Of all rounds the
    classes with the best objective are returned.
    """
    spark = pairs.sparkSession
    k = int(start.max()) + 1
    best, now = (-np.inf, start), start
    for step in range(rounds + 1):
        sent = spark.sparkContext.broadcast(now)
        sums = stash(pairs.mapInPandas(_folded(sent, k), "kind int, code long, n long")
                     .groupBy("kind", "code").agg(F.sum("n").alias("n")))
        n = np.zeros((k, k))
        for r in sums.where("kind = 0").collect():
            n[r.code // k, r.code % k] = r.n
        best = max(best, (objective(n), now), key=lambda x: x[0])
        if step < rounds:
            shard = F.pmod(F.xxhash64(F.lit(step), F.floor(F.col("code") / k)), F.lit(SHARDS)).alias("shard")
            moves = sums.where("kind > 0").groupBy(shard).applyInPandas(_moved(sent, n, words, classes), "word long, class int").collect()
            now = now.copy()
            for r in moves:
                now[r.word] = r["class"]
    return best[1]


def rare_places(texts: DataFrame, words: list[bytes], of: np.ndarray, shards: int) -> DataFrame:
    """Every place of a word that is none of ``words``, dealt by the hash of the word into ``shards``, in arrays. Of each such word: its ``hash``,
    its open class ``was`` and how many ``times`` it follows; of each of its places, word by word: the classes ``before`` and ``after`` it (-1:
    the word itself), and in ``peers``, for places before another such word, the hash of that."""
    sent = texts.sparkSession.sparkContext.broadcast((Symbols({w: i for i, w in enumerate(words)}), of, len(words), words.index(END)))
    types = {"hash": pa.int64(), "was": pa.int16(), "times": pa.int32(), "before": pa.int16(), "after": pa.int16(), "peers": pa.int64()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, classes, size, end = sent.value
        for batch in batches:
            for own in _tokens(batch):
                ids = own.of(numbers)
                rare = ids < 0
                hashes = np.zeros(len(ids), np.int64)
                hashes[rare] = [hashed(own.words[i]) for i in np.flatnonzero(rare).tolist()]
                ids = np.where(rare, size - 1 - ids, ids)
                kinds = np.flatnonzero(rare)
                shard = np.mod(hashes[kinds], shards)
                kinds, shard = kinds[np.argsort(shard, kind="stable")], np.sort(shard)
                rank = np.zeros(len(ids), np.int64)
                rank[kinds] = np.arange(len(kinds))
                # the end token is last, so every rare word has a next one
                here = np.flatnonzero(rare[own.at])
                here = here[np.argsort(rank[own.at[here]], kind="stable")]
                times = np.bincount(rank[own.at[here]], minlength=len(kinds))
                path = np.concatenate([[end], ids[own.at]])
                around = np.concatenate([[0], hashes[own.at]])
                me, last, following = around[here + 1], around[here], around[here + 2]
                before, after = (classes[path[here + i]].astype(np.int64) for i in (0, 2))
                before[(path[here] >= size) & (last == me)] = -1
                after[(path[here + 2] >= size) & (following == me)] = -1
                peer = (path[here + 2] >= size) & (following != me)
                dealt, starts = np.unique(shard, return_index=True)
                ends = np.append(starts, len(shard))
                places = np.concatenate([[0], np.cumsum(times)])[ends]
                values = {"hash": hashes[kinds], "was": ids[kinds] - size, "times": times, "before": before, "after": after, "peers": following[peer]}
                offsets = {**dict.fromkeys(("hash", "was", "times"), ends), **dict.fromkeys(("before", "after"), places),
                           "peers": np.concatenate([[0], np.cumsum(peer)])[places]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt, pa.int64()), *[pa.ListArray.from_arrays(pa.array(offsets[c], pa.int32()), pa.array(values[c], t))
                                                    for c, t in types.items()]], ["shard", *types])

    return texts.select("text").mapInArrow(
        lean(found), "shard long, hash array<long>, was array<short>, times array<int>, before array<short>, after array<short>, peers array<long>")


def rare_gains(n: np.ndarray, was: np.ndarray, own: np.ndarray, before: tuple, after: tuple, first: int) -> np.ndarray:
    """:func:`gains` for many words with few neighbours: words by open classes (from ``first`` on), all against the same ``n``, which holds
    them in their classes ``was``. ``before`` and ``after``: neighbours as word, class and count, sorted by word."""
    k, size = len(n), len(was)
    to = np.arange(first, k)
    dense = []
    for word, c, m in (before, after):
        d = np.zeros((size, k))
        d[word, c] = m
        dense.append(d)
    left, right = dense
    here = to == was[:, None]
    gain = np.zeros((size, len(to)))
    for counts, (word, c, m), other in ((n, after, left), (n.T, before, right)):
        if len(word):
            cell = counts[first:, c].T - here[word] * m[:, None]
            inside = np.flatnonzero(c == was[word])
            cell[inside] -= other[word[inside]][:, first:] + here[word[inside]] * own[word[inside]][:, None]
            cell = np.maximum(cell, 0)
            some, starts = np.unique(word, return_index=True)
            gain[some] += np.add.reduceat(_xlogx(cell + m[:, None]) - _xlogx(cell), starts, axis=0)
    for margin, weight in ((n.sum(axis=1), right.sum(axis=1) + own), (n.sum(axis=0), left.sum(axis=1) + own)):
        rest = np.maximum(margin[first:] - here * weight[:, None], 0)
        gain -= _xlogx(rest + weight[:, None]) - _xlogx(rest)
    near, far = left[:, first:], right[:, first:]
    both = np.flatnonzero((own > 0) | ((near > 0) & (far > 0)).any(axis=1))
    if len(both):
        near, far, mine = near[both], far[both], own[both, None]
        corner = np.maximum(n[to, to] - here[both] * (near + far + mine), 0)
        gain[both] += _xlogx(corner + near + far + mine) - _xlogx(corner + far) - _xlogx(corner + near) + _xlogx(corner)
    return gain


def _joined(arrays: pd.Series, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays]).astype(kind, copy=False)


def _rare_moved(bigrams: np.ndarray, first: int, shards: int):
    """The rarer words of one shard move among the open classes, some at once, in a copy of the class bigrams. Gives rows of arrays: the words
    with their classes (``kind`` 0, ``shard`` their own), the hashes of rarer words after them with the class of the word before (1, ``shard``
    that of the former), and the bigrams of these words with frequent ones, and with themselves, as ``code, n`` (2)."""
    k = len(bigrams)

    def moved(frame: pd.DataFrame) -> pd.DataFrame:
        whole = {c: _joined(frame[c]) for c in ("hash", "was", "times", "before", "after", "peers")}
        n, cells = bigrams.copy(), np.zeros((k, k), np.int64)
        hashes, sample, at = np.unique(whole["hash"], return_index=True, return_inverse=True)
        at = np.repeat(at, whole["times"])
        was, now = whole["was"][sample] + first, np.zeros(len(hashes), np.int64)
        own = np.bincount(at[whole["after"] < 0], minlength=len(hashes)).astype(np.float64)
        sides = []
        for side in ("before", "after"):
            c = whole[side]
            code, m = np.unique(at[c >= 0] * k + c[c >= 0], return_counts=True)
            sides.append((code // k, code % k, m.astype(np.float64)))
        at_once = min(_AT_ONCE, 1 + len(hashes) // 64)
        for low in range(0, len(hashes), at_once):
            high = min(low + at_once, len(hashes))
            old, mine, part = was[low:high], own[low:high], []
            for word, c, m in sides:
                here = slice(*np.searchsorted(word, [low, high]))
                part.append((word[here] - low, c[here], m[here]))
            gain = rare_gains(n, old, mine, *part, first)
            to, rows = np.argmax(gain, axis=1), np.arange(high - low)
            to = np.where(gain[rows, to] > gain[rows, old - first] + 1e-9, to + first, old)
            now[low:high] = to
            (bw, bc, bm), (aw, ac, am) = part
            for sign, where in ((-1, old), (1, to)):
                np.add.at(n, (where[aw], ac), sign * am)
                np.add.at(n, (bc, where[bw]), sign * bm)
                np.add.at(n, (where, where), sign * mine)
            np.maximum(n, 0, out=n)  # neighbours may have moved meanwhile
            np.add.at(cells, (to[aw[ac < first]], ac[ac < first]), am[ac < first].astype(np.int64))
            np.add.at(cells, (bc[bc < first], to[bw[bc < first]]), bm[bc < first].astype(np.int64))
        np.add.at(cells, (now, now), own.astype(np.int64))
        code = np.flatnonzero(cells)
        rows = [(0, int(frame["shard"].iloc[0]), hashes, now - first, [], []), (2, -1, [], [], code, cells.ravel()[code])]
        # a word after itself is counted above
        classes, to = (now - first)[at[whole["after"] >= first]], np.mod(whole["peers"], shards)
        order = np.argsort(to, kind="stable")
        dealt, starts = np.unique(to[order], return_index=True)
        for shard, part in zip(dealt.tolist(), np.split(order, starts[1:])):
            rows.append((1, shard, whole["peers"][part], classes[part], [], []))
        return pd.DataFrame(rows, columns=["kind", "shard", "hash", "class", "code", "n"])

    return moved


def _followed(frame: pd.DataFrame) -> pd.DataFrame:
    """Bigrams of open classes as ``code, n``, from the words of one shard with their classes and the rarer words that stand before them."""
    (hashes, classes), (peers, before) = ((_joined(rows["hash"]), _joined(rows["class"])) for rows in (frame[frame["kind"] == i] for i in (0, 1)))
    order = np.argsort(hashes)
    after = classes[order[np.searchsorted(hashes, peers, sorter=order)]]
    code, n = np.unique(before * OPEN + after, return_counts=True)
    return pd.DataFrame({"code": code.astype(np.int32), "n": n.astype(np.int64)})


def rare_exchange(texts: DataFrame, words: list[bytes], of: np.ndarray, n: np.ndarray, classes: int, places: int) -> tuple[DataFrame, np.ndarray] | None:
    """Open classes of all rarer words by exchange (``hash, class``, landed) and the class bigrams with them; None if they are no better than
    ``n``, those with classes by last bytes. ``places``: how many tokens are rarer words."""
    first, k, shards = classes + 1, len(n), 1 + places // _SHARD_ROWS
    found = stash(rare_places(texts, words, of, shards).groupBy("shard").applyInPandas(
        _rare_moved(n, first, shards), "kind int, shard long, hash array<long>, class array<int>, code array<int>, n array<long>"))
    best = n.copy()
    best[first:] = 0
    best[:, first:] = 0
    sums = found.where("kind = 2").select(F.inline(F.arrays_zip("code", "n")))
    for r in sums.groupBy("code").agg(F.sum("n").alias("n")).collect():
        best[r.code // k, r.code % k] += r.n
    neighbours = found.where("kind < 2").select("kind", "shard", "hash", "class").groupBy("shard").applyInPandas(_followed, "code int, n long")
    for r in neighbours.groupBy("code").agg(F.sum("n").alias("n")).collect():
        best[first + r.code // OPEN, first + r.code % OPEN] += r.n
    moved = found.where("kind = 0").select(F.inline(F.arrays_zip("hash", "class")))
    return (moved, best) if objective(best) > objective(n) else None


@dataclass
class Model:
    tokens: int
    """Training tokens."""
    kinds: int
    """Distinct training tokens."""
    symbols: Symbols
    count: np.ndarray
    word_class: np.ndarray
    emission: np.ndarray
    """Log10 of the probability of each sent word in its class."""
    transition: np.ndarray
    open_first: int
    open_total: np.ndarray
    open_unseen: np.ndarray
    """Log10 of the probability of an unseen word in each open class."""
    end: int


def train(texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, rare: bool = False) -> tuple[Model, DataFrame] | None:
    """The model, and the counts of all words (landed); None without training texts. With ``rare`` rarer words take part in the exchange.

    Counts: ``word`` (only of words in the model), ``hash``, ``n``, ``class`` (the open class, of rarer words).
    """
    counts = stash(word_counts(texts))
    total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return None
    texts = texts.select("text")
    often = counts.where((F.col("n") >= CLUSTERED * total) | (F.col("word") == END)).orderBy(F.desc("n"), "word").collect()
    words = [bytes(r.word) for r in often]
    if END not in words:
        raise ValueError("the end token was not counted")
    # classes: movable ones, the end token's, open ones
    start = np.array([i % classes for i in range(len(words))] + [classes + 1 + i for i in range(OPEN)], np.int32)
    start[words.index(END)] = classes
    pairs = stash(class_bigrams(texts, words))
    # the end token keeps its class: in the exchange it is the last symbol, after the open classes
    fixed = pairs.select(*[F.when(F.col(c) == words.index(END), len(words) + OPEN).otherwise(F.col(c)).cast("int").alias(c)
                           for c in ("a", "b")], "n")
    of = exchange(fixed, len(words), np.append(start, classes), classes, rounds)[:-1]
    k = classes + 1 + OPEN
    sent_of = texts.sparkSession.sparkContext.broadcast(of)

    def by_class(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"a": sent_of.value[f["a"].to_numpy()], "b": sent_of.value[f["b"].to_numpy()], "n": f["n"]})

    n = np.zeros((k, k))
    for r in pairs.mapInPandas(by_class, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        n[r.a, r.b] = r.n
    counts, places = _with_open_classes(counts, words, SENT * total), total - sum(r.n for r in often)
    better = rare_exchange(texts, words, of, n, classes, places) if rare and places else None
    if better:
        moved, n = better
        counts = counts.withColumnRenamed("class", "was").join(moved, "hash", "left").select(
            "word", "hash", "n", F.when(F.col("was").isNotNull(), F.coalesce("class", "was")).alias("class"))
    counts = stash(counts)
    return _model(counts, total, kinds, words, of, n, classes), counts


def _with_open_classes(counts: DataFrame, words: list[bytes], sent: float) -> DataFrame:
    """Counts with the ``hash`` of each word and, of those not in ``words``, the open ``class`` by last bytes; words below ``sent`` are left out."""
    names = counts.sparkSession.sparkContext.broadcast(frozenset(words))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column("word").to_numpy(zero_copy_only=False).tolist(), batch.column("n")
            yield pa.RecordBatch.from_arrays(
                [pa.array([w if c >= sent or w == END else None for w, c in zip(own, n.to_pylist())], pa.binary()),
                 pa.array(list(map(hashed, own)), pa.int64()), n,
                 pa.array([None if w in names.value else open_class(w) for w in own], pa.int32())], ["word", "hash", "n", "class"])

    return counts.select("word", "n").mapInArrow(lean(classed), "word binary, hash long, n long, class int")


def _model(counts: DataFrame, total: int, kinds: int, words: list[bytes], of: np.ndarray, n: np.ndarray, classes: int) -> Model:
    clustered = dict(zip(words, of))
    totals = counts.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    open_n, open_kinds = np.zeros(OPEN), np.zeros(OPEN)
    for r in totals:
        open_n[r["class"]], open_kinds[r["class"]] = r.n, r.kinds
    first = classes + 1
    # an open class without words still has room for an unseen one
    open_total = np.where(open_n > 0, open_n, 1.0)
    unseen = np.where(open_n > 0, DISCOUNT * open_kinds / open_total, 1.0)
    sent = counts.where("word is not null").collect()
    symbols = Symbols({bytes(r.word): i for i, r in enumerate(sent)})
    count = np.array([r.n for r in sent], np.float64)
    word_class = np.array([clustered[bytes(r.word)] if r["class"] is None else first + r["class"] for r in sent])
    closed_total = np.bincount(word_class, count, first + OPEN)
    emission = np.where(word_class < first, count / closed_total[word_class],
                        (count - DISCOUNT) / open_total[np.maximum(word_class - first, 0)])
    # transitions: discounted counts, the rest by class frequency, with a little for classes never seen
    frequency = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * len(n))
    outgoing = n.sum(axis=1, keepdims=True)
    discounted = np.maximum(n - DISCOUNT, 0)
    rest = outgoing - discounted.sum(axis=1, keepdims=True)
    transition = np.where(outgoing > 0, (discounted + rest * frequency) / np.maximum(outgoing, 1), frequency)
    return Model(int(total), int(kinds), symbols, count, word_class, np.log10(emission), np.log10(transition), first, open_total,
                 np.log10(unseen), symbols[END])


_DEALT = "shard long, key long, hash array<long>, at array<int>, n array<long>, class array<int>"


def _dealt(shards: int, key: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Arrays of equal length, ``hash`` among them, dealt by the hash: a row of arrays (see ``_DEALT``) for each shard."""
    shard = np.mod(columns["hash"], shards)
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    ends = pa.array(np.append(starts, len(shard)), pa.int32())
    none = pa.array(np.zeros(len(found) + 1), pa.int32())
    types = {"hash": pa.int64(), "at": pa.int32(), "n": pa.int64(), "class": pa.int32()}
    lists = [pa.ListArray.from_arrays(ends, pa.array(columns[c][order], t)) if c in columns else pa.ListArray.from_arrays(none, pa.array([], t))
             for c, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), key), pa.int64()), *lists], ["shard", "key", *types])


def _asked(shards: int):
    """The rare words of each block of texts, by hash and place in its list."""
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column("key").to_pylist(), batch.column("words")):
                hashes = words.values.to_numpy()
                yield _dealt(shards, key, hash=hashes, at=np.arange(len(hashes)))

    return asked


def _counted(shards: int):
    """The counts of rare words with their classes (-1: none), under the key -1."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = pc.fill_null(batch.column("class"), -1)
            yield _dealt(shards, -1, hash=batch.column("hash").to_numpy(), n=batch.column("n").to_numpy(), **{"class": classes.to_numpy()})

    return counted


def _answered(frame: pd.DataFrame) -> pd.DataFrame:
    """The counts and classes of the words of one shard for the blocks that ask for them; words never counted are left out."""
    known = frame[frame["key"] < 0]
    hashes, which = np.unique(_joined(known["hash"]), return_inverse=True)
    n, classes = np.zeros(len(hashes), np.int64), np.full(len(hashes), OPEN)
    # words that share a hash share the count and the first class
    np.add.at(n, which, _joined(known["n"]))
    given = _joined(known["class"])
    np.minimum.at(classes, which, np.where(given < 0, OPEN, given))
    classes[classes == OPEN] = -1
    rows = []
    for key, asked, at in frame.loc[frame["key"] >= 0, ["key", "hash", "at"]].itertuples(index=False) if len(hashes) else ():
        place = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        found = hashes[place] == asked
        rows.append((key, at[found], n[place[found]], classes[place[found]]))
    return pd.DataFrame(rows, columns=["key", "at", "n", "class"])


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``rows`` (narrow columns and ``text``) with ``n_tokens``, ``n_known``, ``base_score`` and ``score`` in place of the text."""
    kept = [c for c in rows.columns if c != "text"]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    more = {"key": "long", "n_tokens": "long", "n_known": "long", "base": "double", "own": "double", "words": "array<long>",
            "kinds": "array<int>", "path": "array<int>"}
    schema = rows.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in more.items()]).schema
    bottom = float(np.log10(model.tokens + model.kinds + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, nth = sent.value, TaskContext.get().partitionId() << 40
        base = np.log10(m.count + 1) - bottom
        for batch in batches:
            for part in _parts(batch):
                own = tokens(part.column("text"))
                kinds, texts = own.of(m.symbols), own.text
                ids, size = kinds[own.at], len(own.sizes)
                known = ids >= 0
                n_known = np.bincount(texts[known], minlength=size)
                rare = np.flatnonzero(kinds < 0)
                # classes, or -1 - the place in the list of rare words, which the first text of a block has
                path_of = np.zeros(len(kinds), np.int32)
                path_of[kinds >= 0] = m.word_class[kinds[kinds >= 0]]
                path_of[rare] = -1 - np.arange(len(rare))
                sums = [np.bincount(texts[known], values[ids[known]], size) for values in (base, m.emission)]
                lists = [pa.array([values, *[None] * (size - 1)], pa.list_(t)) for values, t in (
                    (np.array([hashed(own.words[i]) for i in rare.tolist()], np.int64), pa.int64()), ((-1 - kinds[rare]).astype(np.int32), pa.int32()))]
                paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own.sizes)]), pa.int32()), pa.array(path_of[own.at]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(np.full(size, nth)), pa.array(own.sizes, pa.int64()),
                     pa.array(n_known, pa.int64()), pa.array(sums[0] - bottom * (own.sizes - n_known)), pa.array(sums[1]), *lists, paths],
                    [*kept, *more])
                nth += 1

    landed = stash(rows.select(*kept, "text").mapInArrow(lean(scored), schema))
    few = counts.where("word is null").select("hash", "n", "class")
    unknown = landed.agg(F.sum(F.col("n_tokens") - F.col("n_known"))).first()[0] or 0
    shards = 1 + max(unknown, few.count()) // _SHARD_ROWS
    asked = landed.where("words is not null").select("key", "words").mapInArrow(_asked(shards), _DEALT)
    answers = asked.unionByName(few.mapInArrow(lean(_counted(shards), 10_000), _DEALT)).groupBy("shard").applyInPandas(
        _answered, "key long, at array<int>, n array<long>, class array<int>")
    out = [*kept, "n_tokens", "n_known", "base_score", "score"]
    open_total = np.log10(model.open_total)

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        kinds, path = (left.column(c).combine_chunks() for c in ("kinds", "path"))
        sizes, path = pc.list_value_length(path).to_numpy(zero_copy_only=False), path.flatten().to_numpy().astype(np.int64)
        kinds = kinds.flatten().to_numpy().astype(np.int64)
        at, n_of, class_of = (right.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "n", "class"))
        n = np.zeros(len(kinds))
        n[at] = n_of
        kinds[at] = np.where(class_of < 0, kinds[at], class_of)
        emitted = np.where(n > 0, np.log10(np.maximum(n, 1) - DISCOUNT) - open_total[kinds], m.open_unseen[kinds])
        texts = np.repeat(np.arange(len(sizes)), sizes)
        rare = np.flatnonzero(path < 0)
        which, of = -1 - path[rare], texts[rare]
        known, base, own = (np.bincount(of, values[which], len(sizes)) for values in (n > 0, np.log10(n + 1), emitted))
        path[rare] = kinds[which] + m.open_first
        # every path ends with the end token's class, which so stands before the next one too
        own = own + np.bincount(texts, m.transition[np.concatenate([[m.word_class[m.end]], path[:-1]]), path], len(sizes))
        sums = [left.column(c).to_numpy() + more for c, more in (("n_known", known.astype(np.int64)), ("base", base), ("own", own))]
        return pa.Table.from_arrays([*[left.column(c) for c in (*kept, "n_tokens")], *map(pa.array, sums)], out)

    types = rows.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(out[-4:], ("long", "long", "double", "double"))]).schema
    return landed.drop("words").groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(walked, types)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams), ``score`` (the class model), both log10 of the whole text's probability.

    A null text counts as empty and has its end token only. Documents with a null id are in no fold: scored, not learned from.
    Without training documents scores are those of a text of unseen words under no counts: null. Repeated rows are each
    learned from and scored. Other columns are not looked at.
    """
    part = fold(doc_id, FOLDS)
    rows = docs.select(col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, HELD_OUT).alias("held_out"),
                       col(text).cast("string").alias("text"))
    found = train(docs.where(part != HELD_OUT).select(col(text).cast("string").alias("text")), **{"rare": True, **how})
    if found is None:
        counted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")) + 1
        return rows.select("doc_id", "held_out", counted.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                           F.lit(0).cast("long").alias("train_tokens"), F.lit(None).cast("double").alias("base_score"),
                           F.lit(None).cast("double").alias("score"))
    model, counts = found
    scored = score(rows, model, counts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")

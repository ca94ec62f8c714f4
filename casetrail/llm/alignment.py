"""Alignment of two tokenizers' tokens over the bytes of a text, with counts of linked ids over the corpus.

Both tokenizers cut the same bytes (a blank and the text). For the documents of a batch, the tokens of each side are a table of document,
start and end; ``merge_asof`` by document finds for each token's start the token of the other side that covers it, and both directions
together are all overlaps. Where tokens of both sides end together a group ends, and the two are linked.

Two ids can be linked only where the bytes of one end with those of the other, so the number of different linked id pairs is
bounded by the bytes of both vocabularies, whatever the corpus; their counts over the corpus are summed by task, then by pair, and
sent to the tasks that score the documents.

A blank between two characters that are no white space starts a new token on both sides. So a very long text is cut there into windows
that are aligned one after the other, and memory does not grow with its length; and a text without other blanks is encoded word by
word, where the ids of words met lately are remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.rows import col, lean
from casetrail.session import spread, stash

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WINDOW = 1 << 18
"""Characters that are aligned at once, about; of a longer text, at least up to the end of a unit."""
_KNOWN = 200_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER = re.compile(r"\s | \s|\s\Z")
_PLAIN = "\u024f"
_BLANK = "▁"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# byte-level vocabularies write a byte that cannot be seen as a letter from 256 on
_BYTES = {chr(b): b for b in _VISIBLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevel:
    """A byte-level tokenizer and the bytes of its tokens.

    Texts of letters whose classes no version of Unicode changes go to a faster encoder with the same vocabulary, where ids follow the
    order of merges.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = self.tokenizer.get_added_tokens_decoder()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [name.encode() if i in special else bytes(map(_BYTES.__getitem__, name)) for i, name in enumerate(names)]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        self.fast = None
        if [x + y for x, y in merges] == names[256:256 + len(merges)] and all(len(v) == 1 for v in self.bytes[:256]):
            ranks = {v: i for i, v in enumerate(self.bytes) if i not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, text in enumerate(texts) if not self.fast or not text.isascii() and max(text) > _PLAIN]
        found = dict(zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)))
        return [np.array(found[i].ids, np.int64) if i in found else self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                for i, text in enumerate(texts)]


class Pieces:
    """A tokenizer of pieces and the bytes of its tokens. The texts it is given begin with the blank that it adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(_BLANK, " ").encode()
                      for i, name in enumerate(names)]
        self.apart = not any(re.search(f"[^{_BLANK}]{_BLANK}", name) for name in names)
        """Whether no piece goes on over a blank, so that a text can be encoded in parts that begin with one."""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode([text[1:] for text in texts], num_threads=1)]


class Tokens:
    """Both tokenizers, the sizes of their tokens in bytes, and how a listing writes their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes = [np.array([len(v) for v in side.bytes], np.int64) for side in (self.a, self.b)]
        self.written = [b"%d%s" % (i, mark) for i in range(len(self.a.bytes)) for mark in (b",", b"|")]
        self.written += [b"%d%s" % (i, mark) for i in range(len(self.b.bytes)) for mark in (b",", b";")]
        self.forget()

    def windows(self, text: str) -> Iterator[str]:
        """A blank and the text, whole or in windows that begin with a blank after no white space and before none."""
        text, start = " " + text, 0
        while self.b.apart and len(text) - start > WINDOW and (cut := _CUT.search(text, start + WINDOW)):
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, or nothing where the bytes of one are not those of the text."""
        found = []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            data = text.encode()
            same = _spelled(self.a.bytes, a) == data and _spelled(self.b.bytes, b) == data
            found.append((a, b) if same else None)
        return found

    def _learn(self, words: list[str]) -> None:
        """Remember the words' ids. Encoded together; a word whose bytes come out otherwise is remembered as such."""
        units = [" " + word for word in words]
        whole = self._whole(["".join(units)])[0]
        if whole:
            ends = np.cumsum([len(unit.encode()) for unit in units])
            cuts = [np.searchsorted(np.cumsum(sizes[ids]), ends, "right") for sizes, ids in zip(self.sizes, whole)]
            usable = np.ones(len(units), bool)
        else:
            each = self._whole(units)
            none = np.zeros(0, np.int64)
            whole = [np.concatenate([own[side] if own else none for own in each]) for side in (0, 1)]
            cuts = [np.cumsum([len(own[side]) if own else 0 for own in each]) for side in (0, 1)]
            usable = np.array([own is not None for own in each])
        for word in words:
            self.known[word] = len(self.known)
        self.usable = np.concatenate([self.usable, usable])
        for side in (0, 1):
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + cuts[side]])
            self.ids[side] = np.concatenate([self.ids[side], whole[side]])

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.usable = np.zeros(0, bool)
        self.ends = [np.zeros(1, np.int64) for _ in range(2)]
        self.ids = [np.zeros(0, np.int64) for _ in range(2)]

    def _by_words(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        words = [text[1:].split(" ") for text in texts]
        if len(self.known) > _KNOWN:
            self.forget()
        new = [*set().union(*words).difference(self.known)]
        if new:
            self._learn(new)
        at = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in words]
        all_, stops = np.concatenate(at), np.cumsum([len(own) for own in at])
        sides = []
        for ids, ends in zip(self.ids, self.ends):
            count = ends[all_ + 1] - ends[all_]
            after = np.cumsum(count)
            taken = ids[np.repeat(ends[all_] - (after - count), count) + np.arange(after[-1])]
            sides.append(np.split(taken, after[stops - 1][:-1]))
        return [(a, b) if self.usable[own].all() else None for own, a, b in zip(at, *sides)]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of texts that begin with a blank, or nothing where the bytes of one are not those of the text."""
        plain = [bool(self.b.apart and not _OTHER.search(text)) for text in texts]
        found = {True: iter(()), False: iter(())}
        for kind, encode in ((True, self._by_words), (False, self._whole)):
            own = [text for text, p in zip(texts, plain) if p is kind]
            found[kind] = iter(encode(own) if own else ())
        return [next(found[p]) for p in plain]


def _spelled(words: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(words.__getitem__, ids.tolist()))


@cache
def _tokens(path_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, path_b)


def _frame(doc: np.ndarray, size: np.ndarray, side: str) -> pd.DataFrame:
    """The tokens of a batch as a table: document, number, start and end. Documents lie end to end, so starts are sorted."""
    end = np.cumsum(size)
    return pd.DataFrame({"doc": doc, "start": end - size, f"start_{side}": end - size, f"end_{side}": end,
                         f"token_{side}": np.arange(len(size))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of tokens that share bytes: ``token_a``, ``end_a``, ``token_b``, ``end_b``.

    Of two such tokens, one starts within the other: each start is looked up on the other side, in both directions. Pairs that
    start together are found by both and taken once.
    """
    from_a = pd.merge_asof(a, b, on="start", by="doc")
    from_b = pd.merge_asof(b, a, on="start", by="doc")
    columns = ["token_a", "end_a", "token_b", "end_b"]
    return pd.concat([from_a[columns], from_b.loc[from_b["start_a"] != from_b["start_b"], columns]])


class Aligned:
    """Alignment of a batch of windows, given as ids of both sides with equal bytes: counts, links and groups by window."""

    def __init__(self, tokens: Tokens, ids: list[tuple[np.ndarray, np.ndarray]]):
        own = [np.concatenate([pair[side] for pair in ids]) for side in (0, 1)]
        self.of = [np.array([len(pair[side]) for pair in ids], np.int64) for side in (0, 1)]
        windows = [np.repeat(np.arange(len(n)), n) for n in self.of]
        pairs = overlaps(*(_frame(w, sizes[ids], side) for w, sizes, ids, side in zip(windows, tokens.sizes, own, "ab")))
        linked = pairs[pairs["end_a"] == pairs["end_b"]]
        self.ids, at = own, [linked["token_a"].to_numpy(), linked["token_b"].to_numpy()]
        self.key = own[0][at[0]] * len(tokens.b.bytes) + own[1][at[1]]
        self.window = windows[0][at[0]]
        self.links = np.bincount(self.window, minlength=len(ids))
        self.last = [np.zeros(len(ids), bool) for ids in own]
        for last, tokens_ in zip(self.last, at):
            last[tokens_] = True
        self.groups = np.bincount(windows[0][self.last[0]], minlength=len(ids))
        self.tokens = tokens

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By window: the different id pairs that are linked, sorted, and how often."""
        kinds = len(self.tokens.a.bytes) * len(self.tokens.b.bytes)
        found, n = np.unique(self.window * kinds + self.key, return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, len(self.links)) * kinds)
        return [(keys % kinds, own) for keys, own in zip(np.split(found, cuts), np.split(n, cuts))]

    def listed(self) -> list[bytes]:
        """By window: its groups as ``a1,a2|b1;a3|b2,b3``."""
        group = [np.cumsum(last) - last for last in self.last]
        many = int(max([g[-1] for g in group if len(g)], default=-1)) + 1
        before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=many))]) for g in group]
        order = np.zeros(len(self.ids[0]) + len(self.ids[1]), np.int64)
        # in a group, side A comes before side B; every id has a form with a comma and one that ends its side
        order[np.arange(len(group[0])) + before[1][group[0]]] = 2 * self.ids[0] + self.last[0]
        order[np.arange(len(group[1])) + before[0][group[1] + 1]] = 2 * (len(self.tokens.a.bytes) + self.ids[1]) + self.last[1]
        ends = np.cumsum(self.of[0] + self.of[1])
        return [_spelled(self.tokens.written, part)[:-1] for part in np.split(order, ends[:-1])]


class _Document:
    """What has been found of a document so far."""

    def __init__(self, with_groups: bool):
        self.n = np.zeros(4, np.int64)
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.listed: list[bytes] | None = [] if with_groups else None
        self.same = True

    def add(self, n: tuple, pairs: tuple[np.ndarray, np.ndarray], listed: bytes) -> None:
        if self.n[0]:
            self.digest.update(b";")
        self.n += n
        self.digest.update(listed)
        self.pairs.append(pairs)
        if self.listed is not None:
            self.listed.append(listed)

    def result(self) -> tuple:
        if not (self.same and self.n[0]):
            return (0, 0, 0, 0, "", b"", b"", "")
        keys, at = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in self.pairs])).astype(np.int64)
        return (*self.n.tolist(), self.digest.hexdigest(), keys.tobytes(), n.tobytes(), b";".join(self.listed or []).decode())


def _decoded(value: bytes | None) -> str:
    try:
        return (value or b"").decode()
    except UnicodeDecodeError:
        return ""


def align(tokens: Tokens, texts: list[bytes | None], with_groups: bool = False) -> list[tuple]:
    """Per text: tokens of both sides, groups, links, digest of the groups, linked id pairs and their counts, and the groups."""
    found = [_Document(with_groups) for _ in texts]
    held: list[tuple[_Document, str]] = []
    size = 0

    def flush() -> None:
        ids = tokens.encoded([text for _, text in held])
        for (document, _), own in zip(held, ids):
            document.same = document.same and own is not None
        owners = [document for (document, _), own in zip(held, ids) if own is not None]
        if owners:
            batch = Aligned(tokens, [own for own in ids if own is not None])
            counts = zip(*batch.of, batch.groups, batch.links)
            for document, n, pairs, listed in zip(owners, counts, batch.pairs(), batch.listed()):
                document.add(n, pairs, listed)
        held.clear()

    for document, value in zip(found, texts):
        for text in tokens.windows(own) if (own := _decoded(value)) else ():
            held.append((document, text))
            size += len(text)
            if size >= WINDOW:
                flush()
                size = 0
    flush()
    return [document.result() for document in found]


COLUMNS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
           "keys": pa.binary(), "times": pa.binary(), "groups": pa.string()}
SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary, groups string"


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
            with_groups: bool = False) -> DataFrame:
    """``doc_id``, counts, ``groups_sha256``, the linked id pairs (``keys``: id of A times the size of B plus id of B; ``times``: how often)
    and, ``with_groups``, the ``groups`` themselves. Written to the shared folder."""
    path_a, path_b = path_a or tokenizer_path(BYTE_LEVEL), path_b or tokenizer_path(PIECES)
    rows = spread(docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path_a, path_b)
        for batch in batches:
            columns = [*zip(*align(tokens, batch.column("text").cast(pa.binary()).to_pylist(), with_groups))] or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(values, kind) for values, kind in zip(columns, COLUMNS.values())]],
                ["doc_id", *COLUMNS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stash(rows.mapInArrow(lean(work, 500), f"doc_id {kind}, {SCHEMA}"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("keys", "times"))
        found, at = np.unique(keys, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.bincount(at, times, len(found)).astype(np.int64))], ["key", "n"])


def link_counts(found: DataFrame) -> DataFrame:
    """``key``, ``n``: how many links of the corpus hold each linked id pair. ``found`` comes from ``aligned``."""
    return found.select("keys", "times").mapInArrow(lean(_totals), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def most_pairs(tokens: Tokens) -> int:
    """How many id pairs can be linked at most: of two linked ids, the bytes of one end with those of the other.

    An id has as many endings as bytes, and each ending is at most as many ids of the other side as the other side has ids for
    one string of bytes.
    """
    repeats = [max(pd.Series(side.bytes).value_counts()) for side in (tokens.a, tokens.b)]
    return int(tokens.sizes[0].sum() * repeats[1] + tokens.sizes[1].sum() * repeats[0])


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
               with_groups: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b`` (tokens of both sides), ``n_groups``, ``n_links``, ``n_best`` (links whose id pair
    is in as many links of the corpus as any pair with its id of B), ``count_sum`` (over links: in how many links of the corpus its id pair
    is), ``groups_sha256``, and ``with_groups`` the ``groups``.

    A text that is null, empty, not valid UTF-8, or whose tokens of one side do not spell a blank and the text has no tokens: counts are 0 and
    ``groups_sha256`` is empty. Repeated rows, null ids and ties (all best pairs count) are rows like any other. An empty
    table gives no rows. Other columns are not looked at. A text of any length is aligned in windows; only a stretch without a
    single blank between other characters has to fit into memory with its tokens.
    """
    path_a, path_b = path_a or tokenizer_path(BYTE_LEVEL), path_b or tokenizer_path(PIECES)
    found = aligned(docs, doc_id, text, path_a, path_b, with_groups)
    counts = link_counts(found).toArrow()
    tokens = _tokens(path_a, path_b)
    if counts.num_rows > most_pairs(tokens):
        raise AssertionError("more linked id pairs than the vocabularies allow")
    key, n = (counts.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    key, n = key[order], n[order]
    highest = np.zeros(len(tokens.b.bytes), np.int64)
    np.maximum.at(highest, key % len(highest), n)
    table = docs.sparkSession.sparkContext.broadcast((key, n, n == highest[key % len(highest)]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = table.value
        for batch in batches:
            sums = []
            for keys, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist()):
                at, own = np.searchsorted(key, np.frombuffer(keys, np.int64)), np.frombuffer(times, np.int64)
                sums.append((int(own[best[at]].sum()), int(own @ n[at])))
            extra = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
            names = [c for c in batch.schema.names if c not in ("keys", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *extra], [*names, "n_best", "count_sum"])

    kept = found if with_groups else found.drop("groups")
    schema = kept.drop("keys", "times").withColumns({c: F.lit(0).cast("long") for c in ("n_best", "count_sum")}).schema
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return kept.mapInArrow(lean(scored), schema).select(*columns, *(["groups"] if with_groups else []))

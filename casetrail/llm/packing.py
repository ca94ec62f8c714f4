"""Best-fit packing planned on the histogram of lengths.

Documents become token ids and, where they are longer than a sequence, pieces. Only how many pieces of each length there
are goes to the driver: at most as many numbers as a sequence has tokens. Best-fit, longest first, runs over these counts:
open sequences with equal free space are one entry, so a step places as many equal pieces as the entry has sequences. The
plan is a list of slots per length; a piece takes the slot of its rank within its length by an equi-join on length and
rank, a key that no two pieces share. Ranks come from counts per task, so no length is gathered in one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm.rows import SMALL_ROWS, col, lean
from casetrail.session import broadcast_if_small, stash

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = b"\0\0\0\0"
_MEMO = 150_000
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# byte-level vocabularies write a byte that cannot be seen as a letter from 256 on
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_STEP = 1 << 14
_MARKS = re.compile(r"(?:^|(?<=[^\W_]))([!-&(-/:-@\[-^`{-~]+)(?=[^\W_]|$)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of texts.

    The tokenizer lower-cases, drops white space and never joins across it, nor across the border between letters or
    digits and a run of ASCII marks (but for apostrophes). So a text's ids are those of its words in turn, a word's those
    of its parts, and words and parts seen lately are remembered. Texts that may hold a special token, or the one letter
    whose lower case ends in a mark, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.number = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        """Ids of words and of parts of words."""
        self.before: dict[bytes, bytes] = {}

    def _encoded(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isalpha() and max(text) <= "\xff":
            # lower-cased letters that nothing composes with: the model alone gives the same, it has a letter for each byte
            tokens = self.tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTES))
            return b"".join([self.number[token.id] for token in tokens])
        return b"".join([self.number[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _learned(self, word: bytes) -> bytes:
        found = self.known.get(word) or self.before.get(word)
        if found is None:
            core = word.rstrip(b".,;:!?")
            if core and len(core) < len(word) and core.decode().isalnum():
                parts = [core, word[len(core):]]
            elif word.isalpha():
                parts = [word]
            else:
                parts = [p.encode() for p in _MARKS.sub(" \\1 ", word.decode()).split(" ") if p]
            found = self._encoded(word) if len(parts) == 1 else b"".join([self._learned(part) for part in parts])
        self.known[word] = found
        return found

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if b"<|" in text or b"\xc4\xb0" in text:
            return b"".join([self.number[i] for i in self.tokenizer.encode(text.decode(), add_special_tokens=False).ids])
        words = text.lower().split()  # A-Z and ASCII white space only
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > _MEMO:  # what was used lately stays
                self.known, self.before = {}, self.known
            known, learned = self.known.get, self._learned
            return b"".join([known(word) or learned(word) for word in words])


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(rows: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """The pieces of the rows' texts: the other columns, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``with_ids``
    the ``ids`` themselves (little-endian unsigned 32-bit), and ``part``, ``nth``: the task and which of the pieces of this
    length in the task it is.

    The result is written to the shared folder, so that ``part`` and ``nth`` hold.
    """
    path = path or tokenizer_path()
    kept = [c for c in rows.columns if c != text]
    added = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {})
    added |= {"part": "int", "nth": "long"}
    schema = rows.select(*kept, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, data, nth = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(text).cast(pa.binary())):
                ids = encoder.ids(value.as_py()) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    n = len(own) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        data.append(own)
            columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64()), *([pa.array(data, pa.binary())] if with_ids else []),
                       pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], *columns], [*kept, *added])

    return stash(rows.select(*kept, text).mapInArrow(lean(cut), schema))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit over counts, longest first: runs of slots (length, first rank, slots, first sequence, offset).

    The k-th slot of a run is in the k-th sequence after the run's first, always at the same offset.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, number)
    sizes: list[int] = []  # the keys of free, sorted
    sequences, slots = 0, []

    def put(size: int, run: tuple[int, int]) -> None:
        if size not in free:
            insort(sizes, size)
        free.setdefault(size, []).append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                new = -(-left // (capacity // length))
                put(capacity, (sequences, new))
                sequences += new
                at = bisect_left(sizes, length)
            size = sizes[at]
            first, number = free[size].pop()
            if not free[size]:
                del free[size], sizes[at]
            n = min(left, number)
            slots.append((length, rank, n, first, capacity - size))
            if number > n:
                put(size, (first + n, number - n))
            if size > length:
                put(size - length, (first, n))
            rank, left = rank + n, left - n
    return slots


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, and without ``part`` and ``nth``."""
    spark = cut.sparkSession
    counts = stash(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, rank long, n long, sequence_id long, offset long")
    # every slot as a row: long runs are cut before they are spread out
    steps = runs.withColumn("at", F.explode(F.expr(f"sequence(0, n - 1, {_STEP})"))).repartition("length", "rank", "at")
    slots = steps.withColumn("k", F.explode(F.expr(f"sequence(at, least(at + {_STEP}, n) - 1)"))).select(
        "length", (F.col("rank") + F.col("k")).alias("rank"), (F.col("sequence_id") + F.col("k")).alias("sequence_id"), "offset")
    ranked = cut.join(broadcast_if_small(bases, SMALL_ROWS), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    columns = [c for c in cut.columns if c not in ("part", "nth")]
    return ranked.join(slots, ["length", "rank"]).select(*columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                     capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null texts count as empty; every document ends with id 0, so an empty one has length 1. Repeated rows and null ids
    are packed like any other. No documents give no rows. Other columns are not looked at.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    return pack(pieces(rows, "text", path, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``ids``: the sequences themselves, from pieces packed ``with_ids``; each is bounded by
    the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, part: F.concat(all_, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))

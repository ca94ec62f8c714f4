"""Language identification with interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text becomes its lower-cased letters with one blank between words. Models of order four are counted by Spark on a
sample of labelled documents, bounded by ``per_language`` documents of each language, so tables are bounded too. Every
text is scored whole; the language with the least cross-entropy per character wins. A calibration part of the training
documents gives the temperature of the probability and, by language and length, the cross-entropy beyond which a text is
rejected as being in none of the languages. That is measured piece by piece, each by the model that fits it best, so a text
in several known languages is as near as one in a single language; what a text in an unknown language has is learned from
calibration texts scored without the model of their own language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.rows import col, fold, held_out, lean, packed, unpacked

UNKNOWN = "und"
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
PER_LANGUAGE = 20_000
MOST_LANGUAGES = 1_000
TEMPERATURES = [1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005]
TOLERANCE = 6.0
"""Without enough texts of other languages a limit lies so many standard deviations above the mean of a language's own texts."""
LOST = 10.0
"""A limit parts a language's own texts from those of left-out languages: one lost of the former weighs as much as so many
passed of the latter."""
ENOUGH = 30
PIECE = 32
"""Symbols of a piece that is in one language."""
BIN = 0.01
ANY = ""
_BLANK, _BLOCK = 32, 1 << 20
_ORDERS = (4, 3, 2, 1)


@cache
def _symbols() -> np.ndarray:
    """Code point to 16-bit symbol: letters stand for themselves (beyond 16 bits by a hash), the rest is blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    short = np.where(points < 0x10000, points, 0x8000 | (points * np.uint32(2654435761) >> np.uint32(17)))
    return np.where(letters, short, _BLANK).astype(np.uint16)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The text's four-symbol windows, packed into 64 bits, in blocks; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = _symbols()[points]
    letter = symbols != _BLANK
    if not letter.any():
        return
    seen = letter.copy()
    seen[1:] |= letter[:-1]  # of a run of blanks the first
    symbols = np.concatenate([np.full(3, _BLANK, np.uint16), symbols[seen], np.full(1, _BLANK, np.uint16)])
    if symbols[-2] == _BLANK:
        symbols = symbols[:-1]
    if symbols[3] == _BLANK:
        symbols = symbols[1:]
    for at in range(0, len(symbols) - 3, _BLOCK):
        s = symbols[at:at + _BLOCK + 3].astype(np.uint64)
        yield s[:-3] << np.uint64(48) | s[1:-2] << np.uint64(32) | s[2:-1] << np.uint64(16) | s[3:]


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in sorted ``keys`` and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Model:
    """One language: per order the sorted n-grams with their log10 probability, and contexts with their log10 back-off."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(keys)
        tables = [(keys[order], counts[order].astype(np.float64))]
        for n in _ORDERS[1:]:  # of shorter n-grams count what can stand before them
            tables.append(np.unique(tables[-1][0] & _mask(n), return_counts=True))
        self.floor = -np.log10(alphabet + 1.0)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (grams_, c) in zip(reversed(_ORDERS), reversed(tables)):
            once, twice = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
            contexts, which, types = np.unique(grams_ >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(which, weights=c)
            weight = discount * types / total
            shorter = self.log10(grams_ & _mask(n - 1), n - 1)
            share = (c - discount) / total[which] + weight[which] * 10.0 ** shorter
            self.tables[n] = grams_, np.log10(share)
            self.backoff[n] = contexts, np.log10(weight)

    def log10(self, wanted: np.ndarray, n: int = 4) -> np.ndarray:
        """Log10 of the probability of each n-gram's last symbol after the ones before it."""
        if n == 0:
            return np.full(len(wanted), self.floor)
        at, known = _find(self.tables[n][0], wanted)
        found = self.tables[n][1][at]
        if not known.all():
            rest = wanted[~known]
            context, met = _find(self.backoff[n][0], rest >> np.uint64(16))
            found[~known] = np.where(met, self.backoff[n][1][context], 0.0) + self.log10(rest & _mask(n - 1), n - 1)
        return found


@dataclass
class Identifier:
    languages: list[str] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)
    temperature: float = 1.0
    limits: dict[tuple[str, int], float] = field(default_factory=dict)
    """By language and length class the greatest cross-entropy of a text's pieces that is not rejected; class -1 is for all
    lengths, ``ANY`` for languages without calibration texts."""

    def entropies(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of symbols and cross-entropy per symbol for each language."""
        n, total = 0, np.zeros(len(self.models))
        for keys in grams(text):
            n += len(keys)
            kinds, counts = np.unique(keys, return_counts=True)
            total -= [float(counts @ model.log10(kinds)) for model in self.models]
        return n, total / max(n, 1)

    def pieces(self, text: str | None) -> np.ndarray:
        """Of every piece of a text the summed cross-entropy under each model (models by pieces)."""
        found = [np.zeros((len(self.models), 0))]
        for keys in grams(text):
            kinds, which = np.unique(keys, return_inverse=True)
            starts = np.arange(0, len(keys), PIECE)
            found.append(np.array([-np.add.reduceat(model.log10(kinds)[which], starts) for model in self.models]))
        return np.concatenate(found, axis=1)

    def limit(self, language: str, n: int) -> float:
        for key in ((language, length_class(n)), (language, -1), (ANY, length_class(n)), (ANY, -1)):
            if key in self.limits:
                return self.limits[key]
        return np.inf

    def shares(self, n: int, entropies: np.ndarray, temperature: float) -> np.ndarray:
        less = (entropies - entropies.min()) * n * temperature * np.log(10)
        share = np.exp(-np.minimum(less, 700))
        return share / share.sum()

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its calibrated probability, and whether the text is rejected."""
        n, entropies = self.entropies(text) if self.models else (0, np.zeros(0))
        if not n:
            return UNKNOWN, 0.0, True
        best = int(np.argmin(entropies))
        language = self.languages[best]
        limit = self.limit(language, n)
        # piece by piece it is never more than by one model for the whole text
        rejected = entropies[best] > limit and self.pieces(text).min(axis=0).sum() / n > limit
        return language, float(self.shares(n, entropies, self.temperature)[best]), bool(rejected)


def length_class(n: int) -> int:
    return min(n, 1 << 14).bit_length()


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most about ``per_language`` rows of each language, by a hash of the id; all rows of languages that have fewer."""
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    keep = F.lit(False)
    for row in sizes:
        keep |= (F.col("lang") == row["lang"]) & (part < int(1_000_000 * min(1.0, per_language / row["count"])))
    return labelled.where(keep)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams of each language with their counts, added up in the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for frame in frames:
        for language, texts in frame.groupby("lang")["text"]:
            blocks = [k for text in texts for k in grams(text)]
            if blocks:
                keys, counts = np.unique(np.concatenate(blocks), return_counts=True)
                old = held.get(language, (keys[:0], counts[:0]))
                merged, where = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                held[language] = merged, np.bincount(where, np.concatenate([old[1], counts])).astype(np.int64)
    for language, (keys, counts) in held.items():
        yield pd.DataFrame({"lang": language, "gram": keys.view(np.int64), "n": counts})


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Identifier:
    """Models and calibration from the documents of the training folds that have a language."""
    spark = docs.sparkSession
    part = fold(doc_id, FOLDS)
    labelled = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).cast("string").alias("lang"),
                           (part == CALIBRATION).alias("calibration"))
    labelled = labelled.where((part != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = _sample(labelled, per_language)
    rows = (chosen.where("not calibration").select("lang", "text").mapInPandas(_counted, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if rows.empty:
        return Identifier()
    alphabet = len(np.unique(rows["gram"].to_numpy().view(np.uint64) & _mask(1)))
    by = {k: v for k, v in sorted(rows.groupby("lang"))}
    found = Identifier(list(by), [Model(v["gram"].to_numpy().view(np.uint64), v["n"].to_numpy(), alphabet) for v in by.values()])
    return _calibrated(found, chosen.where("calibration"), spark)


_OWN, _OTHER, _LOSS = 0, 1, 2


def _calibrated(found: Identifier, texts: DataFrame, spark) -> Identifier:
    sent = spark.sparkContext.broadcast(found)
    names = {name: i for i, name in enumerate(found.languages)}

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many texts of a language and length class have a cross-entropy: own ones, and others whose own model is left
        out, at the language that is nearest then; and the loss at each temperature."""
        sums: Counter = Counter()
        for frame in frames:
            for language, text in zip(frame["lang"], frame["text"]):
                n, entropies = sent.value.entropies(text)
                if n and language in names:
                    right, size = names[language], length_class(n)
                    for i, t in enumerate(TEMPERATURES):
                        sums[ANY, 0, _LOSS, i] += -np.log(max(1e-12, sent.value.shares(n, entropies, t)[right]))
                    pieces = sent.value.pieces(text)
                    if np.argmin(entropies) == right:
                        sums[language, size, _OWN, int(pieces.min(axis=0).sum() / n / BIN)] += 1.0
                    if len(names) > 1:
                        entropies[right] = np.inf
                        e = np.delete(pieces, right, axis=0).min(axis=0).sum() / n
                        sums[sent.value.languages[int(np.argmin(entropies))], size, _OTHER, int(e / BIN)] += 1.0
        yield pd.DataFrame([[*key, float(v)] for key, v in sums.items()], columns=["lang", "size", "kind", "bin", "n"])

    sums = (texts.select("lang", "text").mapInPandas(measured, "lang string, size int, kind int, bin int, n double")
            .groupBy("lang", "size", "kind", "bin").agg(F.sum("n").alias("n")).toPandas())
    if sums.empty:
        return found
    losses = sums[sums["kind"] == _LOSS].sort_values("bin")["n"].to_numpy()
    found.temperature = TEMPERATURES[int(np.argmin(losses))]
    found.limits = _limits(sums[sums["kind"] != _LOSS])
    return found


def _parting(own: pd.DataFrame, other: pd.DataFrame) -> float:
    """The value above which least of ``own`` and most of ``other`` lie (``e``, ``n``); the middle of those that part equally well."""
    edges = np.unique(np.concatenate([own["e"], other["e"]]))
    above, below = ([f.loc[(f["e"] > edge) == more, "n"].sum() / f["n"].sum() for edge in edges] for f, more in ((own, True), (other, False)))
    cost = LOST * np.array(above) + np.array(below)
    best = int(np.argmin(cost))
    return float(edges[best] + edges[best + 1]) / 2 if best + 1 < len(edges) else float(edges[best])


def _limits(sums: pd.DataFrame) -> dict[tuple[str, int], float]:
    """Limits by language and length class from the numbers of texts by cross-entropy (see ``measured``).

    Where a language has few texts or few others come near it, the limit lies as far above the mean of its own texts as it
    does for the texts of all languages together."""
    sums = sums.assign(e=(sums["bin"] + 0.5) * BIN)
    sums = pd.concat([sums, sums.assign(size=-1)])
    groups, excess = {}, {}
    for key, rows in sums.groupby(["lang", "size"]):
        own, other = rows[rows["kind"] == _OWN], rows[rows["kind"] == _OTHER]
        if len(own):
            mean = float(np.average(own["e"], weights=own["n"]))
            spread = float(np.sqrt(np.average((own["e"] - mean) ** 2, weights=own["n"]))) + BIN
            groups[key] = own, other, mean, spread
            excess.setdefault(key[1], []).append(rows.assign(e=rows["e"] - mean))
    pooled = {}
    for size, rows in excess.items():
        rows = pd.concat(rows)
        own, other = rows[rows["kind"] == _OWN], rows[rows["kind"] == _OTHER]
        if min(own["n"].sum(), other["n"].sum()) >= ENOUGH:
            pooled[size] = _parting(own, other)
    limits: dict[tuple[str, int], float] = {}
    for (language, size), (own, other, mean, spread) in groups.items():
        many = own["n"].sum() >= ENOUGH
        if many and other["n"].sum() >= ENOUGH:
            limits[language, int(size)] = _parting(own, other)
        elif many or size == -1:  # fewer of a length say little; the limit for all lengths then holds
            far = pooled.get(size, pooled.get(-1, 0.0))
            limits[language, int(size)] = mean + max(TOLERANCE * spread, far)
    for (_, size), limit in list(limits.items()):
        limits[ANY, size] = max(limits.get((ANY, size), 0.0), limit)
    return limits


def identify(rows: DataFrame, found: Identifier, text: str = "text") -> DataFrame:
    """``rows`` without ``text`` and with ``lang_pred``, ``score`` and ``rejected``.

    A null text and a text without a letter have language ``und``, score 0 and are rejected; so is every text when there
    was nothing to learn from. Equal cross-entropies go to the language that comes first by name.
    """
    sent = rows.sparkSession.sparkContext.broadcast(found)
    kept = [c for c in rows.columns if c != text]
    added = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")]
    schema = rows.select(*kept, *added).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [sent.value.judge(value.as_py()) for value in batch.column(text)]
            columns = [pa.array([v[i] for v in verdicts], kind)
                       for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns],
                                             [*kept, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(judged), schema)


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected`` (see ``identify``)."""
    found = train(docs, doc_id, text, lang, **how)
    rows = docs.select(col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, HELD_OUT).alias("held_out"),
                       col(text).cast("string").alias("text"))
    return identify(rows, found)


def in_known_languages(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    found = train(docs, text=text, **how)
    judged = identify(packed(docs, body=col(text).cast("string")), found, "body")
    return unpacked(judged.where("not rejected"))

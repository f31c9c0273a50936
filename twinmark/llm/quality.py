"""Document quality: fixed word and line rules, and n-gram perplexity bands by language.

The model is a modified Kneser-Ney 5-gram model over characters of any script, one for each language,
counted by Spark over all texts and kept in sorted hash arrays in the shared folder; see ngrams.py.

Bands: log perplexity of a language's documents, of whatever length, is summed into a global histogram
by length (powers of two); its median is m. A document of n symbols is rejected if its log perplexity
leaves m +- width * sqrt(s**2 + v / n), where v is the variance of one symbol's log probability: short
texts vary more and get wider bands. The scale s is the one at which the median deviation, in units of
that root, is a normal variable's. Below the lower band lie texts of
repeated stock phrases, above the upper one noise.

Texts are read twice by assess() (counts, scores), three times by fit() and filter() (counts, histogram,
verdict), and never shuffled; very long ones go through in slices of a few megabytes, or alone, whole. Nulls are empty texts;
a text without words fails the base rules. Rows with equal ids are judged one by one; other
columns pass through filter() unchanged, whatever their names. Documents whose language isn't
listed, or null, share one more model. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm import ngrams
from twinmark.llm.common import cut, ship, slices
from twinmark.llm.ngrams import slots_of, texts_of

LANGUAGES = ("en", "de", "fr", "es")
WIDTH = 4.0
BIN = 0.002
SPACE = "\t\n\v\f\r "
SYMBOLS = "#*$%&|<>"


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # of bytes: splits at exactly the six ASCII spaces
    word_chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], span: int = 5) -> int:
    """Words inside windows of `span` words that are found twice or more."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    if n <= 50_000:
        windows = list(zip(*(words[k:] for k in range(span)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        hit = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:  # the same in flat arrays: ranks of ever longer windows
        ids: dict[bytes, int] = {}
        one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank = one
        for k in range(1, span):
            rank = np.unique(rank[:-1] * len(ids) + one[k:], return_inverse=True)[1]
        hit = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[span : span + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


@dataclass
class QualityModel:
    """The fitted model and, by slot, (median, scale, variance) of the bands."""

    model: ngrams.Model
    bands: dict[int, tuple[float, float, float]]
    languages: tuple[str, ...]
    width: float

    def log_perplexity(self, texts: list[str], slots: np.ndarray, squares: bool = False):
        """Per text: mean of -log p (0 for no symbols), number of symbols; each symbol's log p and slot."""
        g = ngrams.grams(texts)
        keys, store, slot = g.keys(), self.model.store(), np.repeat(slots, g.n)
        lp = np.empty(len(keys))
        for s in np.unique(slots).tolist():
            rows = np.flatnonzero(slot == s)
            lp[rows] = store.log_p(s, g, keys, rows)
        ends = np.cumsum(g.n)
        total = np.concatenate([[0], np.cumsum(lp)])
        mean = -(total[ends] - total[ends - g.n]) / np.maximum(g.n, 1)
        return (mean, g.n, lp, slot) if squares else (mean, g.n)

    def verdicts(self, texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: log perplexity, and the lower and upper band it is held against."""
        mean, n = self.log_perplexity(texts, slots)
        m, s, v = (np.array([self.bands.get(int(k), (0.0, np.inf, 0.0))[i] for k in slots], float) for i in range(3))
        room = self.width * np.sqrt(s**2 + v / np.maximum(n, 1))
        return mean, m - room, m + room


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(docs: DataFrame, model: QualityModel, rules: bool) -> DataFrame:
    """Per document: slot, log_perplexity, n of symbols, sum and sum of squares of their log probabilities;
    with rules doc_id and the word counts too."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, slots = texts_of(b), slots_of(b, held.value.languages)
                mean, n, lp, _ = held.value.log_perplexity(texts, slots, squares=True)
                ends = np.cumsum(n)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (lp, lp**2)]
                cols = [slots.astype(np.int32), mean, n, *(x[ends] - x[ends - n] for x in sums)]
                names = ["slot", "log_perplexity", "n", "total", "square"]
                if rules:
                    cols += [b.column("doc_id"), *map(np.array, zip(*map(word_rules, texts), strict=True))]
                    names += ["doc_id", *COUNTS]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)

    more = ", doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) if rules else ""
    rows = docs.select(*([F.col("doc_id").cast("long").alias("doc_id")] if rules else []), "text", "lang")
    return rows.mapInArrow(run, f"slot int, log_perplexity double, n long, total double, square double{more}")


def _bands(scored: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Median, scale and variance of each language, from histograms by length in powers of two."""
    some = scored.where("n > 0").groupBy("slot", F.floor(F.col("log_perplexity") / BIN).alias("bin"), F.floor(F.log2("n")).alias("power"))
    rows = some.agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in ("n", "total", "square"))).toPandas()  # a few thousand bins a language
    out = {}
    for s, r in rows.groupby("slot"):
        w, mid = r.docs.to_numpy(float), (r.bin.to_numpy() + 0.5) * BIN
        m, many = _median(mid, w), r.n.sum()
        v = max(r.square.sum() / many - (r.total.sum() / many) ** 2, 0.0)
        out[int(s)] = (m, _scale(np.abs(mid - m), w, v / (1.5 * 2.0 ** r.power.to_numpy())), v)
    return out


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, width: float = WIDTH) -> QualityModel:
    """Count, model, and bands over all documents (columns text and lang)."""
    model = QualityModel(ngrams.train(docs.select("text", "lang"), languages), {}, languages, width)
    model.bands = _bands(_scored(docs, model, rules=False))
    return model


def _median(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x)
    return float(x[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])


def _scale(off: np.ndarray, weight: np.ndarray, own: np.ndarray) -> float:
    """The scale at which the median of off / sqrt(scale**2 + own) is a normal variable's, BIN at least."""
    low, high = BIN, max(1.4826 * _median(off, weight), BIN)
    for _ in range(40):
        s = (low + high) / 2
        low, high = (s, high) if 1.4826 * _median(off / np.sqrt(s**2 + own), weight) > 1 else (low, s)
    return high


def assess(docs: DataFrame, model: QualityModel | None = None, languages: tuple[str, ...] = LANGUAGES, width: float = WIDTH) -> DataFrame:
    """One row per document: doc_id, the word counts, base_failed, the log perplexity with its band, kept.
    Without a fitted model one is fitted over these documents, which then are scored only once."""
    if model is None:
        model = QualityModel(ngrams.train(docs.select("text", "lang"), languages), {}, languages, width)
        scored = cut(_scored(docs, model, rules=True))
        model.bands = _bands(scored)
    else:
        scored = _scored(docs, model, rules=True)
    of = lambda i, none: F.coalesce(F.create_map(*(x for k, v in model.bands.items() for x in (F.lit(k), F.lit(float(v[i])))))[F.col("slot")], F.lit(none)) if model.bands else F.lit(none)
    room = F.lit(model.width) * F.sqrt(of(1, float("inf")) ** 2 + of(2, 0.0) / F.greatest("n", F.lit(1)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = scored.select("doc_id", *COUNTS, failed.alias("base_failed"), "log_perplexity", (of(0, 0.0) - room).alias("band_low"), (of(0, 0.0) + room).alias("band_high"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")))


def filter(docs: DataFrame, model: QualityModel) -> DataFrame:  # noqa: A001
    """The documents that pass, with all their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, slots = texts_of(b), slots_of(b, held.value.languages)
                mean, low, high = held.value.verdicts(texts, slots)
                good = (mean >= low) & (mean <= high)
                for i in np.flatnonzero(good):
                    r = word_rules(texts[i])
                    good[i] = not base_failed(r[0], r[4])
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

1. Heuristic labellers look at every text and vote good, bad or nothing.
2. Vote patterns of all documents are counted (there are 3^labellers at most) and expectation-maximisation estimates
   how accurate each labeller is on good and on bad documents, and how many are good.
3. The posterior of a sample of ``TRAIN_ROWS`` documents (a bound, drawn by the hash of the text over all of them) trains a logistic
   scorer on hashed features (byte trigrams, levels of the measures) in one task.
4. Every whole text gets its score; it is kept at ``THRESHOLD`` or above.

Toxicity is judged apart, as form does not show it, when ``ToxicTerms`` are given: ``TERMS``, and beginnings of words learned
from labels, each with the share of toxic documents among those that hold it. A text's toxicity is the highest share of its
words' terms; at ``TOXIC`` or above it is rejected, however well formed. Terms that stand in few labelled documents are not
learned, so small or missing labels leave languages other than English without terms.

Null texts count as empty; texts without words are rejected with score 0. Every row is scored by itself: repeated rows
get equal scores, null ids and further columns do not matter. An empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed
from .text_arrays import SPACE, text_bytes, words_of

TRAIN_ROWS = 6000
BUCKETS = 1 << 14
THRESHOLD = 0.5
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
GOOD, BAD, NONE = 1, 0, 2
#: Prior of the accuracies: how often labellers vote bad on bad and on good documents, and the share of all votes it weighs.
HIT, FALSE_ALARM, PRIOR = 0.4, 0.005, 0.2
LEVELS = 12

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"!#$%&*+<=>?@^_`{|}~\\/")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:?!")] = True
_UPPER, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True

#: name, measure, votes bad at or above, votes good at or below.
LABELLERS = (
    ("symbols", 0.08, 0.02), ("decorated_words", 0.10, 0.005), ("capitals", 0.40, 0.15), ("word_repeats", 0.10, 0.02),
    ("few_words", 0.85, 0.65), ("separators", 0.05, 0.002), ("no_stops", 0.99, 0.95),
)
LEAST_WORDS = 40

#: Words that make a text toxic wherever no labels say so.
TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
TOXIC = 0.85
#: Labelled documents that terms are learned from, about at most; drawn by the hash of their ids over all labels.
LABEL_ROWS = 6000
BEGINNINGS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 1 << 18


def measures(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The labellers' measures of a text with words; higher is worse."""
    word = ~SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    last, before, size = data[end - 1], data[np.maximum(end - 2, 0)], end - start
    n, letters = len(start), max(1, int(_LETTER[data].sum()))
    out = np.array([
        _SYMBOL[data].sum() / word.sum(), (_SYMBOL[last] & (last == before) & (size > 1)).mean(), _UPPER[data].sum() / letters,
        (words[1:] == words[:-1]).mean() if n > 1 else 0.0, 1 - len(np.unique(words)) / n,
        ((size == 1) & _SYMBOL[last]).mean(), 1 - _STOP[last].mean()])
    return out


def votes(words: np.ndarray, m: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.full(len(LABELLERS), NONE)
    out = np.array([BAD if x >= bad else GOOD if x <= good else NONE for x, (_, bad, good) in zip(m, LABELLERS)])
    if len(words) < LEAST_WORDS:
        out[[4, 6]] = NONE  # shares of a few words say little
        if m[3] < 0.25:
            out[3] = NONE
    return out


def pattern_of(v: np.ndarray) -> int:
    return int(v @ 3 ** np.arange(len(v)))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class WeakLabels:
    """Two classes; each labeller has an accuracy in each of them. A labeller that says nothing is no evidence."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        v, c = votes_of(patterns), counts.astype(float)
        bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
        p = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.7))  # a start: most labellers see one kind of fault alone
        for _ in range(rounds):
            self.good = float(np.clip((c @ p) / max(c.sum(), 1), 1e-3, 1 - 1e-3))
            self.table = np.ones((2, len(LABELLERS), 3))
            for k, q in ((GOOD, p), (BAD, 1 - p)):
                n = np.stack([(c * q) @ (v == x) for x in (BAD, GOOD)], axis=1)
                rate = FALSE_ALARM if k == GOOD else HIT
                n += np.array([rate, 1 - rate]) * (PRIOR * c.sum() + 1)
                self.table[k, :, :2] = n / n.sum(axis=1, keepdims=True)
            p = self._posterior(v)

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        j = np.arange(v.shape[1])
        one = np.log(self.good) + np.log(self.table[GOOD, j, v]).sum(axis=1)
        other = np.log(1 - self.good) + np.log(self.table[BAD, j, v]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(other - one, -50, 50)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(votes_of(patterns))


def features(data: np.ndarray, words: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: byte trigrams with damped counts, scaled to length 1, the levels of the
    labellers' measures, and a constant."""
    d = data.astype(np.uint32)
    at, x = np.zeros(0, np.int64), np.zeros(0)
    if len(d) >= 3:
        h = ((d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(18)
        count = np.bincount(h, minlength=BUCKETS)
        at = np.flatnonzero(count)
        x = np.log1p(count[at])
        x /= np.sqrt(x @ x)
    if len(words):
        level = np.minimum((np.sqrt(m) * LEVELS).astype(np.int64), LEVELS)
        own = (np.arange(len(LABELLERS)) * (LEVELS + 1) + level + 1) * 2654435761 % BUCKETS
        at, x = np.concatenate([at, own]), np.concatenate([x, np.full(len(own), 0.3)])
        at, of = np.unique(at, return_inverse=True)
        x = np.bincount(of, x)
    return np.append(at, BUCKETS), np.append(x, 0.3)


class ToxicTerms:
    """Terms, a word's beginning or a whole word with ``$``, and the share of toxic documents among those that hold one."""

    def __init__(self, learned: dict[str, float]):
        self.shares = learned | {f"{w}$": 1.0 for w in TERMS}

    @staticmethod
    def of(word: str) -> list[str]:
        return [word + "$"] + [word[:n] for n in BEGINNINGS if len(word) >= n]

    def toxicity(self, texts: list[str | None]) -> np.ndarray:
        known, out = {}, np.zeros(len(texts))
        for k, t in enumerate(texts):
            for w in set(_WORD.findall((t or "").lower())):
                x = known.get(w)
                if x is None:
                    if len(known) == KNOWN_WORDS:
                        known.clear()
                    x = known[w] = max(self.shares.get(g, 0.0) for g in self.of(w))
                if x > out[k]:
                    out[k] = x
        return out


def _learn_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    holds = {True: Counter(), False: Counter()}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            holds[toxic].update({g for w in set(_WORD.findall((text or "").lower())) for g in ToxicTerms.of(w)})
    # one document less, so that a term of few documents is none
    share = {g: (n - 1) / (n + holds[False][g]) for g, n in holds[True].items()}
    found = sorted(g for g, x in share.items() if x >= TOXIC)
    yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "share": pa.array([share[g] for g in found], pa.float64())})


def learn_terms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_rows: int = LABEL_ROWS) -> ToxicTerms:
    """Terms of the documents whose label ``toxic`` is 1; labels of null are left out, distinct texts count once."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).alias("toxic"))
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(min(1.0, label_rows / max(1, labels.count())) * 1_000_000) + 1)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own.filter(drawn)), id_col)
    sample = texts.select("text", "toxic").distinct().repartition(1)
    return ToxicTerms({r["term"]: r["share"] for r in sample.mapInArrow(_learn_terms, "term string, share double").collect()})


def _rows(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for r in range(len(offsets) - 1):
        own = data[offsets[r]:offsets[r + 1]]
        words = words_of(own, np.array([0, len(own)]))[0]
        yield own, words, measures(own, words) if len(words) else np.zeros(len(LABELLERS))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"pattern": pa.array([pattern_of(votes(w, m)) for _, w, m in _rows(b)], pa.int32())})


def _train(model: WeakLabels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for b in batches:
            for d, w, m in _rows(b):
                if len(w):
                    rows.append(features(d, w, m))
                    target.append(pattern_of(votes(w, m)))
        weight, power = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-4)
        if rows:
            y = model.posterior(np.array(target))
            order = np.random.Generator(np.random.PCG64(5))
            for _ in range(EPOCHS):
                for i in order.permutation(len(rows)):
                    at, x = rows[i]
                    p = 1 / (1 + np.exp(-np.clip(weight[at] @ x, -40, 40)))
                    g = (p - y[i]) * x + DECAY * weight[at]
                    power[at] += g * g
                    weight[at] -= RATE * g / np.sqrt(power[at])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weight.tobytes()], pa.binary())})

    return run


def _score(model: WeakLabels, weight: np.ndarray, toxic: ToxicTerms | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pattern, score = [], []
            for d, w, m in _rows(b):
                at, x = features(d, w, m)
                pattern.append(pattern_of(votes(w, m)))
                score.append(1 / (1 + np.exp(-np.clip(weight[at] @ x, -40, 40))) if len(w) else 0.0)
            p = model.posterior(np.array(pattern, dtype=np.int64).reshape(-1)) if pattern else np.zeros(0)
            columns = {n: b.column(n) for n in b.schema.names if n != "text"}
            if toxic is not None:
                columns["toxicity"] = pa.array(toxic.toxicity(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict(columns | {"pattern": pa.array(pattern, pa.int32()), "posterior": pa.array(p), "score": pa.array(score, pa.float64())})

    return run


def _keep(model: WeakLabels, weight: np.ndarray, text_col: str, toxic: ToxicTerms | None):
    score = _score(model, weight, toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (scored,) = score([pa.RecordBatch.from_pydict({"text": b.column(text_col)})])
            kept = scored.column("score").to_numpy() >= THRESHOLD
            if toxic is not None:
                kept &= scored.column("toxicity").to_numpy() < TOXIC
            yield b.filter(pa.array(kept))

    return run


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[WeakLabels, np.ndarray]:
    """The weak-label model of all documents and the weights of the scorer."""
    own = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = own.mapInArrow(_patterns, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    model = WeakLabels(np.array([r["pattern"] for r in counts], dtype=np.int64), np.array([r["n"] for r in counts], dtype=np.int64))
    share = min(1.0, train_rows / max(1, sum(r["n"] for r in counts)))
    drawn = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)
    sample = own.filter(drawn).distinct().repartition(1)
    found = checkpointed(sample.mapInArrow(_train(model), "weights binary")).collect()
    return model, np.frombuffer(found[0]["weights"]) if found else np.zeros(BUCKETS + 1)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, toxic: ToxicTerms | None = None) -> DataFrame:
    """Per row: id, pattern (votes), posterior (of the weak labels), score (of the linear scorer), kept; with terms also
    toxicity, and kept then asks for both."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    more = "" if toxic is None else "toxicity double, "
    scored = own.mapInArrow(_score(*fit(docs, text_col, train_rows), toxic), f"id {kind}, {more}pattern int, posterior double, score double")
    kept = F.col("score") >= THRESHOLD
    return scored.withColumn("kept", kept if toxic is None else kept & (F.col("toxicity") < TOXIC))


def keep_good(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS, toxic: ToxicTerms | None = None) -> DataFrame:
    """The rows whose text is kept, with all their columns; nothing is shuffled for it."""
    return docs.mapInArrow(_keep(*fit(docs, text_col, train_rows), text_col, toxic), docs.schema)

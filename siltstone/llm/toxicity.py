"""Toxicity by bags of subwords.

A word is the bag of its character n-grams and of itself, each of which has a
vector by its hash; a misspelling that was never seen shares most n-grams, and
so the vector, of what it was made from. Words' vectors are averaged and go into a
linear softmax; vectors and softmax are trained jointly, in numpy, on long
passages of labelled texts. A whole text has log-odds by the worst of its short
and of its longer windows, which begin at every word, so that a long text can't
hide a passage, and by the whole. How these become a score is fitted on
labelled texts that didn't train.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, fresh, python_ready, remainder, table

#: Bounds of the labelled sample: rows of each label, and characters of a row; longer rows aren't drawn.
SAMPLE_ROWS, ROW_CHARS = {0: 3000, 1: 1500}, 10_000
#: Words of the windows, the last of which is the whole text; lengths of n-grams; buckets that n-grams are hashed to; width of the vectors.
WINDOWS, GRAMS, BUCKETS, WIDTH = (8, 64, None), (3, 4, 5, 6), 1 << 17, 12
#: Texts of the sample in which a subword must occur to have a vector; others count as zeros.
LEAST_TEXTS = 3
#: Words of a passage to train on; passages drawn in all, within the least and most passes over the texts; passages a step; step size; decay of what a step touches.
PASSAGE, DRAWN, PASSES, BATCH, STEP, DECAY = 256, 18_000, (6, 40), 64, 0.5, 1e-4
#: One in so many labelled texts calibrates and doesn't train; what draws each window's slope to 0, so that the short one counts most.
CALIBRATES, SHRINK = 4, (0.1, 3.0, 3.0)
#: Words whose scores a worker keeps.
KNOWN_WORDS = 400_000
#: What is cut from the ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class ToxicModel(NamedTuple):
    """Vectors of buckets, weights and biases of the two labels, and how the windows' log-odds become a score."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slopes: np.ndarray
    offset: float

    def scores(self) -> WordScores:
        return WordScores(self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0]), self.slopes, self.offset)


class WordScores(NamedTuple):
    """What scoring needs of a model: a bucket's part of the log-odds, as all that is done with vectors is linear."""

    parts: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float


def words_of(text: str | None) -> list[str]:
    """Runs without white space, in small letters, without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w] if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and of the words themselves, one word after the other, and where each word's begin and end."""
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(words)), sizes)
    left = begin[word + 1] - np.arange(len(codes))
    powers = np.concatenate([[1], np.cumprod(np.full(sizes.max(), _BASE))]).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(7)) * powers[np.arange(len(codes)) - begin[word]], begin[:-1])
    hashes, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * _BASE
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(word[at])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    h = (h ^ (h >> np.uint64(32))) * _BASE
    order = np.argsort(owner, kind="stable")
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def _means(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each run of rows; no run is empty, as a word is a subword of itself."""
    return np.add.reduceat(values, ends[:-1]) / np.diff(ends).reshape(-1, *[1] * (values.ndim - 1))


def worst_windows(scores: np.ndarray, widths: tuple[int | None, ...] = WINDOWS) -> list[float]:
    """For each width, the largest mean of so many neighbours; fewer are one window, and none give 0."""
    n = len(scores)
    if not n:
        return [0.0] * len(widths)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return [float(sums[-1] / n if w is None or n <= w else (sums[w:] - sums[:-w]).max() / w) for w in widths]


class Trainer:
    """Texts as numbers of words, words as bags of buckets, and the model in training."""

    def __init__(self, texts: list[list[str]], labels: np.ndarray, seed: int = 1, least_texts: int = LEAST_TEXTS):
        self.rng = np.random.default_rng(seed)
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
        self.labels = labels
        self.grams, self.ends = subwords(list(number))
        held = np.zeros(BUCKETS, np.int64)
        for t in self.texts:
            if len(t):
                held[np.unique(self.bags(np.unique(t))[0])] += 1
        self.known = held >= least_texts
        self.begin()

    def begin(self) -> None:
        """A model that knows nothing yet; small random vectors, so that they can differ."""
        self.vectors = self.rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)) * self.known[:, None]
        self.weights, self.bias = np.zeros((WIDTH, 2)), np.zeros(2)
        self.seen = [np.full(BUCKETS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)]

    def word_scores(self) -> np.ndarray:
        parts = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        return _means(parts[self.grams], self.ends)

    def bags(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, one word after the other, and where each word's begin and end."""
        sizes = self.ends[words + 1] - self.ends[words]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.grams[np.repeat(self.ends[words] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def gradients(self, windows: list[np.ndarray], labels: np.ndarray):
        """(loss, buckets, their gradients, those of weights and of biases) of the mean loss of some windows."""
        sizes = np.array([len(w) for w in windows])
        words, at = np.unique(np.concatenate(windows), return_inverse=True)
        buckets, ends = self.bags(words)
        of_word = _means(self.vectors[buckets], ends)
        means = _means(of_word[at], np.concatenate([[0], np.cumsum(sizes)]))
        z = means @ self.weights + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = -np.log(p[np.arange(len(labels)), labels] + 1e-30).mean()
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        _, to_words = _summed(at, np.repeat((p @ self.weights.T) / sizes[:, None], sizes, 0))
        grams = np.diff(ends)
        own, to_buckets = _summed(buckets, np.repeat(to_words / grams[:, None], grams, 0), self.known[buckets])
        return loss, own, to_buckets, means.T @ p, p.sum(0)

    def step(self, windows: list[np.ndarray], labels: np.ndarray) -> float:
        """One step of Adagrad; a bucket's vector has one step size."""
        loss, own, v, w, b = self.gradients(windows, labels)
        self.seen[0][own] += (v * v).sum(1)
        self.vectors[own] -= STEP * (v / np.sqrt(self.seen[0][own])[:, None] + DECAY * self.vectors[own])
        for x, g, seen in ((self.weights, w, self.seen[1]), (self.bias, b, self.seen[2])):
            seen += g * g
            x -= STEP * g / np.sqrt(seen)
        return loss

    def train(self) -> None:
        """Each pass trains on a passage of every text, drawn anew, so that long texts take part with all they have."""
        self.begin()
        own = [i for i, t in enumerate(self.texts) if len(t)]
        for _ in range(min(PASSES[1], max(PASSES[0], DRAWN // max(1, len(own))))):
            starts = self.rng.integers(0, [max(0, len(self.texts[i]) - PASSAGE) + 1 for i in own])
            windows, labels = [self.texts[i][k : k + PASSAGE] for i, k in zip(own, starts, strict=True)], self.labels[own]
            order = self.rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                self.step([windows[k] for k in some], labels[some])


def _turns(labels: np.ndarray) -> np.ndarray:
    """Each row's number among those of its label, by which both labels are dealt alike."""
    out = np.empty(len(labels), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        out[own] = np.arange(len(own))
    return out


def _summed(keys: np.ndarray, rows: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sums of their rows; only of rows in use, if that is told."""
    at = np.arange(len(keys)) if use is None else np.flatnonzero(use)
    at = at[np.argsort(keys[at], kind="stable")]
    if not len(at):
        return at, np.zeros((0, rows.shape[1]))
    k = keys[at]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(rows[at], first)


def calibrated(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a weighted logistic regression, by Newton's steps; no slope is below 0."""
    size = odds.std(0)
    size[size < 1e-9] = 1.0
    x = np.concatenate([odds / size, np.ones((len(odds), 1))], 1)
    a, prior = np.zeros(x.shape[1]), np.append(SHRINK[: odds.shape[1]], 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hess = (x.T * (weights * p * (1 - p))) @ x + np.diag(prior + 1e-9)
        new = a - np.clip(np.linalg.lstsq(hess, x.T @ (weights * (p - labels)) + prior * a)[0], -2, 2)
        new[:-1] = np.maximum(new[:-1], 0)
        done = np.abs(new - a).max() < 1e-6
        a = new
        if done:
            break
    return a[:-1] / size, float(a[-1])


def train_toxicity(sample: list[tuple[int, int, str]], shares: dict[int, float] | None = None) -> ToxicModel:
    """Of (order, label, text) rows; one in CALIBRATES, by order, calibrates. ``shares`` are the labels' shares of all rows.

    Without rows of both labels every text scores the share of the toxic, which is then 0 or 1; without any, 0.
    """
    shares = shares or {}
    rows = sorted(sample)
    labels = np.array([r[1] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        sure = 30.0 if len(labels) and labels[0] else -30.0
        return ToxicModel(np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 2)), np.zeros(2), np.zeros(len(WINDOWS)), sure)
    texts = [words_of(r[2]) for r in rows]
    apart = _turns(labels) % CALIBRATES == CALIBRATES - 1
    some = [i for i in range(len(rows)) if not apart[i]]
    t = Trainer([texts[i] for i in some], labels[some])
    t.train()
    trained = ToxicModel(t.vectors, t.weights, t.bias, np.zeros(len(WINDOWS)), 0.0)
    scorer = Scorer(trained.scores())
    use = np.flatnonzero(apart) if len(set(labels[apart].tolist())) > 1 else np.arange(len(rows))
    odds = np.array(scorer.log_odds([rows[i][2] for i in use]))
    own = np.bincount(labels[use], minlength=2) / len(use)
    weights = np.array([shares.get(k, own[k]) / own[k] for k in labels[use].tolist()])
    slopes, offset = calibrated(odds, labels[use], weights)
    return trained._replace(slopes=slopes, offset=offset)


class Scorer(dict):
    """Token as it stands in a text -> its part of the log-odds; None for one that is no word."""

    def __init__(self, model: WordScores):
        super().__init__()
        self.model = model

    def learn(self, tokens: set[str]) -> None:
        clean = {x: x.strip(EDGES) for x in tokens}
        words = sorted({w for w in clean.values() if w})
        scores: dict[str, float] = {}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            grams, ends = subwords(part)
            scores.update(zip(part, _means(self.model.parts[grams], ends).tolist(), strict=True))
        self.update((x, scores.get(w)) for x, w in clean.items())

    def log_odds(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text's worst windows; the bias alone for a text without words."""
        lists = [t.lower().split() if t else [] for t in texts]
        distinct = set().union(*lists)
        new = {x for x in distinct if x not in self}
        if len(self) + len(new) > KNOWN_WORDS:
            self.clear()
            new = distinct
        self.learn(new)
        scores = ([s for s in map(self.__getitem__, tokens) if s is not None] for tokens in lists)
        return [np.array(worst_windows(np.array(s))) + self.model.bias for s in scores]

    def score(self, texts: list[str | None]) -> list[float]:
        odds = np.array(self.log_odds(texts)).reshape(len(texts), len(WINDOWS))
        return (1 / (1 + np.exp(-np.clip(odds @ self.model.slopes + self.model.offset, -30, 30)))).tolist()


@lru_cache(maxsize=1)
def _scorer(parts: bytes, slopes: bytes, bias: float, offset: float) -> Scorer:
    """A worker builds it once."""
    return Scorer(WordScores(np.frombuffer(parts), bias, np.frombuffer(slopes), offset))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[int, int, str]], dict[int, float]]:
    """Labelled texts as (hash, label, text), at most SAMPLE_ROWS of each label, and the labels' shares of all labelled ids.

    Ids are drawn by the order of their hashes, whatever the number of rows.
    Null ids, labels and texts are passed over, and texts of more than
    ROW_CHARS characters; an id with several labels is toxic if one says so.
    An id of several texts may bring all of them, within the bound.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    h = F.xxhash64(id_col, F.lit("toxicity"))
    rows = []
    for label, most in SAMPLE_ROWS.items():
        drawn = known.filter(F.col("_label") == label).orderBy(h, id_col).limit(most)
        texts = docs.filter(F.length(text_col) <= ROW_CHARS).select(id_col, text_col).join(F.broadcast(drawn), id_col)  # of SAMPLE_ROWS rows at most
        order = F.xxhash64(id_col, text_col)
        rows += [tuple(r) for r in texts.select(order.alias("h"), F.lit(label).alias("label"), F.col(text_col).alias("t")).orderBy("h", "t").limit(most).collect()]
    return rows, {k: n / sum(counts.values()) for k, n in counts.items()}


def score_toxicity(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``out_col``, from 0 to 1: how likely the text is toxic, by its worst windows.

    Whole texts are scored. Null and empty texts and those without words have
    the score of no words at all, which the bias alone gives. Repeated rows
    score alike. Columns pass through; one named ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    python_ready(spark)
    m = model.scores()
    sent = spark.sparkContext.broadcast((m.parts.tobytes(), m.slopes.tobytes(), m.bias, m.offset))

    def start():
        known = _scorer(*sent.value)
        return known.score

    return append_column(docs, out_col, T.DoubleType(), start, [text_col])


def is_toxic(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null id isn't held out, but has no label to learn from either."""
    fold = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train_toxicity(*labelled_sample(docs, labels.filter(~fold)))
    (score,) = fresh(docs, "score")
    out = score_toxicity(docs.withColumn("held_out", fold), model, out_col=score)
    return out.select("doc_id", "held_out", score, is_toxic(F.col(score)).alias("predicted"))

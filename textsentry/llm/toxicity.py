"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents. Word labels are induced from them: a word of a
toxic document is toxic if one of its features (the word and its
beginnings) marks toxic documents, that is, occurs in many of them after differing
words and in next to no clean ones. (Text copied among toxic documents recurs
after the same words, which tells it from terms of abuse.) The field has two
states; its emissions are sums of feature weights, fitted with the transitions
by gradient ascent on the likelihood of labelled segments.

A document's score is a logistic function of its two largest forward-backward
marginals of the toxic state and of their sum, fitted on the same sample, as one
doubtful word may occur in clean documents too; runs of words with a marginal of
``THRESHOLD`` or more are the offending spans. The model is fitted on a bounded sample of labelled rows
(``SAMPLE`` toxic and twice as many clean ones, by hash, of at most
``SAMPLE_CHARS`` characters each); texts are scored whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
SAMPLE = 1500
SAMPLE_CHARS = 50_000
SEGMENT = 64
SEGMENTS = 12_000
ROUNDS = 60
REMEMBERED = 1 << 18
BATCH_CHARS = 4 << 20
# A marker occurs in so many toxic documents, and this share of them, this much oftener than in clean ones,
# and by so many standard deviations more often than if it had nothing to do with the label.
MARKER_DOCS = 3
MARKER_SHARE = 0.015
MARKER_LIFT = 20.0
MARKER_DEVIATIONS = 5.5

_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters, which stand for stems."""
    w = word.lower()
    return [w + "$", *(w[:k] + "*" for k in range(4, 7) if len(w) > k)]


@dataclass
class Field:
    """Weights by feature, log-potentials of bias and transitions, and weights of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -40.0
    stay: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 00, 01, 10, 11
    document: tuple[float, ...] = (-40.0, 0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return min(max(self.bias + sum([get(f, 0.0) for f in features(word)]), -40.0), 40.0)


def messages(odds: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages; ``odds`` is time by chain, chains longest first.

    Both are kept as ratios of the two states, so a place costs one fraction
    each way. ``step`` has the four transition factors.
    """
    t00, t01, t10, t11 = step
    steps, width = odds.shape
    # How many chains go on at each time; the longest come first.
    going = np.searchsorted(-lengths, -np.arange(steps), side="left")
    ahead = np.empty_like(odds)
    ahead[0] = odds[0]
    for t in range(1, steps):
        n = going[t]
        r = ahead[t - 1, :n]
        ahead[t, :n] = odds[t, :n] * (t01 + t11 * r) / (t00 + t10 * r)
        ahead[t, n:] = 0
    back = np.ones_like(odds)
    for t in range(steps - 2, -1, -1):
        n = going[t + 1]
        x = odds[t + 1, :n] * back[t + 1, :n]
        back[t, :n] = (t10 + t11 * x) / (t00 + t01 * x)
    return ahead, back


def marginals(odds: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The toxic state's marginal at every place."""
    ahead, back = messages(odds, lengths, step)
    both = ahead * back
    return both / (1 + both)


def _segments(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word types and labels in rows of ``SEGMENT``, and row lengths; those with toxic words first."""
    parts = [(w[i : i + SEGMENT], y[i : i + SEGMENT]) for w, y in docs for i in range(0, len(w), SEGMENT)]
    parts.sort(key=lambda p: -int(p[1].any()))
    toxic = sum(bool(y.any()) for _, y in parts)
    if len(parts) > SEGMENTS:
        # The rest of the sample is taken evenly from the clean segments.
        room = max(SEGMENTS - toxic, SEGMENTS // 2)
        clean = parts[toxic:]
        parts = parts[: SEGMENTS - min(room, len(clean))][:toxic] + clean[:: max(1, len(clean) // room)][:room]
    parts.sort(key=lambda p: -len(p[0]))
    words = np.zeros((len(parts), SEGMENT), np.int64)
    labels = np.zeros((len(parts), SEGMENT), bool)
    for k, (w, y) in enumerate(parts):
        words[k, : len(w)], labels[k, : len(w)] = w, y
    return words, labels, np.array([len(w) for w, _ in parts])


def fit(texts: list[str], toxic: list[bool], rounds: int = ROUNDS) -> Field:
    """Learn a field from labelled documents; without toxic or clean ones every word is clean."""
    types: dict[str, int] = {}
    docs = [np.array([types.setdefault(w.lower(), len(types)) for w in _WORD.findall(t)], np.int64) for t in texts]
    bad = np.array(toxic, bool)
    if not bad.any() or bad.all() or not types:
        return Field()
    names: dict[str, int] = {}
    lists = [[names.setdefault(f, len(names)) for f in features(w)] for w in types]
    sizes = np.array([len(x) for x in lists])
    flat = np.array([f for x in lists for f in x], np.int64)
    first = np.cumsum(sizes) - sizes
    n_types, n_features = len(types), len(names)
    owner = np.repeat(np.arange(n_types), sizes)

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of words, and the position each comes from."""
        at = np.repeat(np.arange(len(words)), sizes[words])
        inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes[words]) - sizes[words], sizes[words])
        return flat[first[words][at] + inner], at

    # In how many toxic and clean documents a feature occurs, and after how many different words in toxic ones.
    seen = [np.zeros(n_features, np.int64), np.zeros(n_features, np.int64)]
    after = []
    for words, is_bad in zip(docs, bad.tolist(), strict=True):
        if len(words):
            seen[is_bad][np.unique(spread(np.unique(words))[0])] += 1
            if is_bad:
                f, at = spread(words)
                after.append(f * n_types + np.concatenate([[0], words[:-1]])[at])
    contexts = np.bincount(np.unique(np.concatenate(after)) // n_types, minlength=n_features) if after else seen[1]
    # A beginning that is mostly that of one word adds nothing to the word.
    used = np.bincount(np.concatenate([w for w, b in zip(docs, bad.tolist(), strict=True) if b]), minlength=n_types)
    most = np.zeros(n_features, np.int64)
    np.maximum.at(most, flat, used[owner])
    total = np.bincount(flat, used[owner], n_features)
    whole = np.array([f.endswith("$") for f in names])
    useful = whole | (most <= 0.5 * total)
    lift = ((seen[1] + 0.1) / bad.sum()) / ((seen[0] + 0.1) / (~bad).sum())
    chance = np.maximum((seen[0] + seen[1]) * bad.mean(), 1e-9)
    marks = (
        (seen[1] >= max(MARKER_DOCS, MARKER_SHARE * bad.sum()))
        & (contexts >= np.maximum(MARKER_DOCS, 0.4 * seen[1]))
        & (lift >= MARKER_LIFT)
        & useful
        & (seen[1] - chance >= MARKER_DEVIATIONS * np.sqrt(chance))
    )
    marked = np.zeros(n_types, bool)
    np.logical_or.at(marked, owner, marks[flat])

    words, labels, lengths = _segments([(w, marked[w] & b) for w, b in zip(docs, bad.tolist(), strict=True)])
    inside = np.arange(SEGMENT)[None, :] < lengths[:, None]
    theta = np.zeros(n_features + 5)  # features, bias, four transitions
    theta[-5] = -4.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    pair_y = [((labels[:, :-1] == a) & (labels[:, 1:] == b) & inside[:, 1:]).sum() for a in (0, 1) for b in (0, 1)]
    for k in range(1, rounds + 1):
        by_type = np.clip(np.bincount(owner, theta[flat], n_types) + theta[-5], -40, 40)
        odds = np.exp(by_type)[words].T.copy()
        step = np.exp(theta[-4:])
        ahead, back = messages(odds, lengths, step)
        both = ahead * back
        p = (both / (1 + both)).T
        miss = np.where(inside, labels - p, 0.0)
        per_type = np.bincount(words.ravel(), miss.ravel(), n_types)
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(flat, per_type[owner], n_features)
        grad[-5] = miss.sum()
        r, x = ahead[:-1], odds[1:] * back[1:]
        pairs = np.array([np.full_like(r, step[0]), step[1] * x, step[2] * r, step[3] * r * x])
        expected = (pairs / pairs.sum(0) * inside.T[1:]).sum((1, 2))
        grad[-4:] = np.array(pair_y) - expected
        grad[:n_features] *= useful
        grad -= 0.01 * theta
        mean = 0.9 * mean + 0.1 * grad
        square = 0.98 * square + 0.02 * grad * grad
        theta += 0.25 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.98**k)) + 1e-6)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    kept = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.01}
    model = Field(kept, float(theta[-5]), tuple(theta[-4:].tolist()))
    model.document = _logistic(np.array([evidence(p) for p in Tagger(model).probabilities(texts)]), bad)
    return model


def evidence(p: np.ndarray) -> tuple[float, float, float, float]:
    """What a document's score depends on: one, its largest and second marginal, the logarithm of their sum."""
    if not len(p):
        return 1.0, 0.0, 0.0, 0.0
    top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    return 1.0, float(top[1]), float(top[0]), float(np.log1p(p[p >= 0.05].sum()))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, ...]:
    """Weights by Newton's rounds with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return tuple(w.tolist())


class Tagger:
    """Applies a field to texts; emissions of words are remembered."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}
        self.step = np.exp(np.array(model.stay))

    def _odds(self, text: str) -> np.ndarray:
        known = self.known
        words = _WORD.findall(text)
        try:
            return np.array([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = float(np.exp(self.model.emission(w)))
            return np.array([known[w] for w in words])

    def probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """The toxic marginal of every word of every text."""
        odds = [self._odds(t) for t in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        order = sorted((k for k in range(len(texts)) if len(odds[k])), key=lambda k: -len(odds[k]))
        while order:
            # Chains of similar length side by side, bounded in size.
            longest = len(odds[order[0]])
            width = max(1, min(512, (1 << 20) // longest))
            some, order = order[:width], order[width:]
            lengths = np.array([len(odds[k]) for k in some])
            grid = np.ones((longest, len(some)))
            for column, k in enumerate(some):
                grid[: lengths[column], column] = odds[k]
            p = marginals(grid, lengths, self.step)
            for column, k in enumerate(some):
                out[k] = p[: lengths[column], column]
        return out

    def tag(self, texts: list[str], threshold: float) -> tuple[list[float], list[list[dict]]]:
        """Scores, and the spans (character offsets, largest marginal) of toxic words."""
        scores, spans = [], []
        for text, p in zip(texts, self.probabilities(texts), strict=True):
            x = sum(w * e for w, e in zip(self.model.document, evidence(p), strict=True))
            score = float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))
            found: list[dict] = []
            if len(p) and p.max() >= threshold:
                last = -2
                for k, match in enumerate(_WORD.finditer(text)):
                    if p[k] >= threshold:
                        if last == k - 1:
                            found[-1]["end"] = match.end()
                            found[-1]["p"] = max(found[-1]["p"], float(p[k]))
                        else:
                            found.append({"start": match.start(), "end": match.end(), "p": float(p[k])})
                        last = k
            scores.append(score)
            spans.append(found)
        return scores, spans


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``_id``, ``text`` and ``_toxic`` of the sampled rows; held-out rows and null labels are left out."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("_toxic"))
    )
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.where("_toxic = 0").orderBy(*order).limit(2 * sample)
    )
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    return short.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "_toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit a field on the bounded sample, in one task on an executor; only the weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort()  # the order rows come in must not matter
        model = fit([r[1] for r in rows], [r[2] == 1 for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(model))])], ["model"])

    made = training_rows(docs, labels, sample).repartition(1).mapInArrow(run, "model string").collect()
    return Field(**json.loads(made[0]["model"])) if made else Field()


def tag_documents(docs: DataFrame, model: Field, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``toxic_score`` and ``toxic_spans`` in place of columns of these names.

    All rows and other columns stay as they are; null, empty and wordless texts
    have the least evidence and no spans.
    """
    docs = docs.drop("toxic_score", "toxic_spans")
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(spread.value)
        for batch in batches:
            first = 0
            sizes = np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in batch.column(at).to_pylist()])])
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + BATCH_CHARS, side="right")) - 1)
                part = batch.slice(first, last - first)
                scores, spans = tagger.tag([t or "" for t in part.column(at).to_pylist()], threshold)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    [*(f"_c{i}" for i in range(part.num_columns)), "toxic_score", "toxic_spans"],
                )
                first = last

    inner = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    fields = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = inner.mapInArrow(run, f"{fields}, toxic_score double, toxic_spans array<struct<start:int,end:int,p:double>>")
    return out.toDF(*docs.columns, "toxic_score", "toxic_spans")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, the model learned from ``docs`` and ``labels``."""
    tagged = tag_documents(docs, learn(docs, labels), threshold=threshold)
    return tagged.where(F.col("toxic_score") < threshold).drop("toxic_score", "toxic_spans")

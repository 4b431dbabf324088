"""Quality classifier (operator 9): Bradley-Terry scores from preference pairs.

Each labelled document of quality 1 is preferred to each labelled document of quality 0. A linear
score of text features is learned by the logistic loss on feature differences, so only the order of
documents matters. The cut is a quantile of the scores of the training rows, the one that agrees
best with their labels; scores are shifted so that the cut stands at ``THRESHOLD`` and squashed to (0, 1).

Training takes at most ``max_labelled`` labelled rows, those with the smallest hash of their id, so
what reaches the driver is bounded: a short vector of numbers for each. Scoring reads every whole
text once, without a shuffle. Labels, language, source and ids are never inputs of a score.

Null text counts as empty and gets the score of the empty text. A null id is not held out and has
no label. Null labels are left out of training; equal label rows count once, an id with both labels counts as one row of each,
of repeated documents with one id one is taken. With no label of either class every score is 0.5. Ties in score are ties. Other columns, whatever their names, pass through:
``score_col`` must be a new name (``common.added_name`` gives one).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

THRESHOLD, MAX_LABELLED, PAIRS_AT_ONCE = 0.3, 8_000, 1 << 20
FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "distinct_lines", "line_words", "upper", "digits", "symbols",
    "marks_a_word", "marked_words", "space", "short_words", "entropy", "pairs_seen_again", "non_ascii", "title_words", "longest_line", "links",
)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_PLAIN = _LETTERS + b"0123456789 \n\t\r.,;:'\"?-" + bytes(range(128, 256))
_DROP = {k: bytes(v) for k, v in {"upper": range(65, 91), "digits": b"0123456789", "space": b" \n\t\r", "high": range(128, 256), "marks": set(range(33, 127)) - set(_LETTERS) - set(b"0123456789")}.items()}
_LINK = re.compile("https?://|www\\.|@")


def text_features(text: str) -> list[float]:
    """The numbers of FEATURES for one whole text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw) or 1
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    words = text.split()
    w = len(words) or 1
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(raw) - len(raw.translate(None, _DROP["marks"]))
    top = max(seen.values(), default=0)
    counts = np.fromiter(seen.values(), float, len(seen))
    entropy = float(np.log(w) - (counts * np.log(counts)).sum() / w) if words else 0.0
    return [
        math.log1p(len(words)), min(len(text) / w, 40) / 10, sum(map((13).__lt__, map(len, seen))) / (len(seen) or 1), len(seen) / w, top / w,
        len(set(lines)) / (len(lines) or 1), math.log1p(w / (len(lines) or 1)), share(_DROP["upper"]), share(_DROP["digits"]), 1 - share(_PLAIN) if raw else 0.0,
        min(marks / w, 5), sum(x[-1] in "#$%&*!|" for x in words) / w, share(_DROP["space"]), sum(map((4).__gt__, map(len, words))) / w, entropy,
        1 - len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1) if len(words) > 1 else 0.0, share(_DROP["high"]), sum(map(str.istitle, seen)) / (len(seen) or 1),
        math.log1p(max(map(len, lines), default=0)), min(len(_LINK.findall(text)) * 20 / w, 3),
    ]


@dataclass
class Ranker:
    """A fitted linear score: features are centred, scaled and clipped before the weights apply."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -5, 5) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = self.latent(x) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _all_pairs(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean logistic loss over all pairs of a good and a bad row, a block of good rows at a time."""
    k, n = good.shape[1], len(good) * len(bad)
    gradient, curve = np.zeros(k), np.zeros((k, k))
    low = bad @ w
    for at in range(0, len(good), PAIRS_AT_ONCE // len(bad) + 1):
        z = good[at : at + PAIRS_AT_ONCE // len(bad) + 1]
        p = 1 / (1 + np.exp(np.clip((z @ w)[:, None] - low, -30, 30)))  # chance of the wrong order
        q = p * (1 - p)
        gradient += z.T @ p.sum(1) - bad.T @ p.sum(0)
        cross = z.T @ q @ bad
        curve += (z * q.sum(1)[:, None]).T @ z + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T
    return gradient / n, curve / n


def fit_ranker(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> Ranker:
    """Newton steps on the mean logistic loss of score differences over all preference pairs of the given rows."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - centre) / scale, -5, 5)
    w = np.zeros(k)
    for _ in range(60):
        gradient, curve = _all_pairs(z[good], z[bad], w)
        step = np.linalg.solve(curve + ridge * np.eye(k), gradient - ridge * w)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    cuts = np.quantile(s, np.arange(1, 100) / 100)
    return Ranker(centre, scale, w, float(cuts[np.argmax([((s >= c) == (label == 1)).mean() for c in cuts])]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out fold."""
    rows = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
    chosen = rows.orderBy(F.md5(F.col("k").cast("string")), "k", "y").limit(max_labelled)
    found = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")  # bounded by max_labelled

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "x": [text_features(t if isinstance(t, str) else "") for t in pdf["t"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    got = found.mapInPandas(run, f"k {kind}, y int, x array<double>").groupBy("k", "y").agg(F.min("x").alias("x")).toPandas()
    got = got.sort_values(["k", "y"])
    return fit_ranker(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["y"].to_numpy())


def score_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t if isinstance(t, str) else "") for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(ranker.score(x))

    return docs.select("*", score(quoted([text_col])[0]).alias(score_col))

"""Quality classifier: Bradley-Terry ranking of documents.

Each pair of a label-1 and a label-0 document is a preference; the score is
linear in text features and fitted by logistic loss on feature differences.
A quantile of the training scores becomes the threshold.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import trim

#: Labelled rows that a fit reads at most, lowest hash of the id first.
MAX_LABELLED = 20_000
#: Preference pairs drawn for a fit.
PAIRS = 200_000
#: Score of a document at the threshold quantile.
CUT = 0.3
BYTES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "bang": b"!",
    "pipe": b"|",
    "symbol": b"$%#&*@~^=+<>\\_",
    "line": b"\n",
    "stop": b".,;:?",
    "control": [*range(9), *range(14, 32), 127],
    "high": range(128, 256),
}
_CLASSES = np.zeros((256, len(BYTES)))
for _k, _bytes in enumerate(BYTES.values()):
    _CLASSES[list(_bytes), _k] = 1
FEATURES = [*(f"{k}_per_byte" for k in BYTES), *(f"log_{k}" for k in BYTES), "log_bytes", "log_words", "word_length", "distinct", "repeats", "log_repeats", "longest", "upper_of_letters"]


def features(text: bytes | None) -> np.ndarray:
    """Features of one whole text; zeros where it is null or empty."""
    if not text:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    words = text.split()
    n, size = max(1, len(words)), len(text)
    repeats = sum(map(eq, words, words[1:]))
    letters = counts[0] + counts[1]
    return np.concatenate(
        (
            counts / size,
            np.log1p(counts),
            (np.log1p(size), np.log1p(len(words)), min(50, size / n), len(set(words)) / n, repeats / n, np.log1p(repeats), np.log1p(max(map(len, words), default=0)), counts[0] / max(1, letters)),
        )
    )


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BradleyTerry:
    """Weights, scaling and threshold of a fitted ranking."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where((s := x.std(0) if len(x) else np.zeros(x.shape[1])) > 1e-9, s, 1)
        self.weights, self.cut = np.zeros(x.shape[1]), 0.0
        if not len(good) or not len(bad):
            return
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(seed)
        pairs = int(min(pairs, 20 * max(len(good), len(bad))))
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        for _ in range(30):  # Newton's method on the pairwise logistic loss
            p = sigmoid(-d @ self.weights)
            gradient = d.T @ p / pairs - ridge * self.weights
            curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(self.weights))
            step = np.linalg.solve(curvature, gradient)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        self.cut = self._quantile(z @ self.weights, y)

    @staticmethod
    def _quantile(s: np.ndarray, y: np.ndarray) -> float:
        """The score quantile, in steps of a thousandth, with the best balanced accuracy."""
        cuts = np.unique(np.quantile(s, np.linspace(0, 1, 1001)))
        good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
        right = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        return float(cuts[best].mean())

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        return sigmoid((x - self.mean) / self.scale @ self.weights - self.cut + np.log(CUT / (1 - CUT)))


def fit_quality(docs: DataFrame, labels: DataFrame, keep: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> BradleyTerry:
    """Fit on the documents of max_labelled labels at most.

    keep is a condition on id_col of the labels (all where None). Labels other
    than 0 and 1 and null ids are left out; an id labelled both ways counts as
    both, rows of docs equal in id and text count once, and of ids with several
    texts 2 * max_labelled rows are taken at most, by a hash of id and text.
    With one class or none, as with empty tables, every score is CUT. Texts are
    read whole, however long.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if keep is not None:
        own = own.join(labels.filter(keep).select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    own = own.distinct().orderBy(F.xxhash64("_id"), "_y").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    # The sample has max_labelled rows at most. Rows equal in id, text and label count once; ids with several texts
    # may make more rows, of which a hash chooses without regard to the label.
    measure = F.pandas_udf(_measured, "array<double>")
    one = texts.join(F.broadcast(own), "_id").groupBy("_id", "_y", F.xxhash64("_text").alias("_hash")).agg(F.first("_text").alias("_text"))
    measured = one.select("_id", "_hash", "_y", measure("_text").alias("x"))
    rows = measured.orderBy(F.xxhash64("_id", "_hash"), "_id", "_hash", "_y").limit(2 * max_labelled).collect()
    rows.sort(key=lambda r: (r._y, r.x))  # the model does not hang on the order in which rows arrive
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return BradleyTerry(x, np.array([r._y for r in rows], int))


def _measured(texts: pd.Series) -> pd.Series:
    return pd.Series(list(feature_matrix(texts)))


def quality_score(model: BradleyTerry, text: F.Column) -> F.Column:
    """Score of a text column; null and empty texts are scored as texts without features."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scores = pd.Series(model.score(feature_matrix(texts)), dtype="float64")
        trim()
        return scores

    return run(text.cast("binary"))


def keep_quality(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """Rows of docs, columns as they are, that the model scores CUT or more.

    Null and empty texts are scored as texts without features, repeated rows
    each; an empty table gives no rows. Extra columns may have any names.
    """
    found = docs.select(F.struct(*docs.columns).alias("row"), quality_score(model, F.col(text_col)).alias("score"))
    return found.filter(F.col("score") >= CUT).select("row.*")


def fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the registered query; labels of the documents of remainder 0 are not read. A null id has a null held_out."""
    model = fit_quality(docs, labels, fold() != 0)
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

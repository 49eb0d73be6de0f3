"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, whose statistics are cut into bins
once, so that each level of a tree is found from histograms of gradients. A fitted model is a few
arrays: for each tree the feature and limit of each inner node, and the value of each leaf. A task
sends a batch of documents through all trees together, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bpe import small_slices
from siftline.llm.quality import duplicate_lines, first_places, repeated_places


@dataclass(frozen=True)
class Boosting:
    #: Labelled documents that the trees are fitted on, at most; those with the smallest hash of their id.
    fitted_on: int = 20_000
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    #: Sum of second derivatives that a leaf needs, and the weight that draws its value to 0.
    least_weight: float = 1.0
    shrink: float = 1.0
    #: One document in so many is held out, by the crc32 of its id.
    folds: int = 5
    #: From this score on the prediction is 1.
    limit: float = 0.3
    seed: int = 11


# --- statistics of a document -----------------------------------------------------------------------

#: Characters whose share of the text is a statistic each.
_SINGLE = b"!?.,:;|#*$%&<>@/\\=_-\"'()[]{}\n \t"
#: Classes of bytes whose share is one: control, digits, upper case, lower case, the rest of ASCII, lead bytes beyond it.
_CLASS = np.zeros((256, 6))
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b, 0 if _b < 32 or _b == 127 else 1 if _c.isdigit() else 2 if _c.isupper() else 3 if _c.islower() else 4 if _b < 128 else 5] = _b < 128 or _b >= 192
FEATURES = [
    "log_words", "log_chars", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeated_words", "duplicate_lines", "words_per_line", "odd_ends", "upper_words", "digit_words", "entropy",
    "control", "digits", "upper", "lower", "other", "wide", *(f"share_{b}" for b in _SINGLE),
]


_BLANK, _UPPER, _LOWER, _DIGIT, _ODD = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!#*$%&|<>"))


def statistics(text: bytes) -> list[float]:
    """The FEATURES of one text in UTF-8; all 0 for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    seen = np.bincount(raw, minlength=256)
    chars = len(text) - int(seen[128:192].sum())
    share = seen[seen > 0] / len(text)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw], [True])).view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    size, n = end - start, max(1, len(start))
    places = first_places(text.split())
    times = np.bincount(places.astype(np.int64), minlength=1)
    inside = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[raw], dtype=np.int32)))[np.stack((start, end))], axis=0)[0]
    upper, lower, digit = inside(_UPPER), inside(_LOWER), inside(_DIGIT)
    lines = int(seen[10]) + 1
    part = lambda flags: float(np.count_nonzero(flags)) / n
    return [
        np.log1p(len(start)), np.log1p(chars), (chars - int(seen[_BLANK].sum())) / n, part(size > 15), part(size < 3), np.count_nonzero(times) / n, times.max() / n,
        repeated_places(places) / n, duplicate_lines(text) / lines, len(start) / lines, part(_ODD[raw[end - 1]]), part((upper > 0) & (lower == 0)), part(digit == size), float(-(share * np.log2(share)).sum()),
        *(seen @ _CLASS / max(1, chars)), *(seen[list(_SINGLE)] / max(1, chars)),
    ]


# --- trees ------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete trees in arrays: row t holds the inner nodes of tree t level by level; a row goes right where its feature is over the limit."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        rows = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.limit[tree, node])
        total = self.start + self.value[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin of each value, and the limits between the bins of each feature: quantiles of the sample, halfway between neighbours."""
    out, limits = np.zeros(x.shape, np.int64), []
    for j in range(x.shape[1]):
        kinds = np.unique(x[:, j])
        if len(kinds) > bins:
            kinds = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="nearest"))
        cut = (kinds[1:] + kinds[:-1]) / 2
        limits.append(cut)
        out[:, j] = np.searchsorted(cut, x[:, j])
    return out, limits


def fitted(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Trees:
    """Trees for the rows x with labels y (0 or 1). Without both labels, or without rows, the score is the smoothed share of label 1."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    inner = 2**how.depth - 1
    model = Trees(np.zeros((how.trees, inner), np.int64), np.full((how.trees, inner), np.inf), np.zeros((how.trees, inner + 1)), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    codes, limits = _binned(x, how.bins)
    n, features = codes.shape
    flat = codes + np.arange(features) * how.bins
    known = np.array([b < len(limits[j]) for j in range(features) for b in range(how.bins)]).reshape(features, how.bins)
    total = np.full(n, model.start)
    for t in range(how.trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        node, first = np.zeros(n, np.int64), 0
        for level in range(how.depth):
            width = 2**level
            at = ((node - first)[:, None] * (features * how.bins) + flat).ravel()
            size = width * features * how.bins
            g = np.bincount(at, np.repeat(slope, features), size).reshape(width, features, how.bins)
            h = np.bincount(at, np.repeat(curve, features), size).reshape(width, features, how.bins)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + how.shrink) + right_g**2 / (right_h + how.shrink) - all_g**2 / (all_h + how.shrink)
            gain = np.where(known[None] & (left_h >= how.least_weight) & (right_h >= how.least_weight), gain, -1).reshape(width, -1)
            best = gain.argmax(1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), how.bins)
                    model.feature[t, first + k], model.limit[t, first + k] = j, limits[j][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.limit[t, node])
            first += width
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        model.value[t] = how.rate * g / (h + how.shrink)
        total += model.value[t][leaf]
    return model


# --- documents --------------------------------------------------------------------------------------


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a document is held out; a null id has no label and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


_ROW = "doc_id string, features array<double>"


def _features(rows: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_slices(batch, 1):
                values = pa.array([statistics(t or b"") for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["doc_id", "features"])

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, _ROW)


def learned(docs: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> Trees:
    """Trees fitted on at most ``fitted_on`` of the documents that have a quality of 0 or 1 and are not held out."""
    key = F.col("doc_id").cast("string")
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), how.folds)).groupBy(key.alias("label_id")).agg(F.min("quality").alias("quality"))
    order = F.xxhash64("label_id", F.lit(how.seed))
    chosen = F.broadcast(known.orderBy(order, "label_id").limit(how.fitted_on))  # fitted_on rows at most
    rows = _features(docs.join(chosen, key == F.col("label_id"), "left_semi"))
    # Rows that repeat an id may be many, so that the bound is set once more.
    sample = rows.join(chosen, rows["doc_id"] == F.col("label_id")).orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id", "features").limit(how.fitted_on)
    found = sample.select("features", "quality").toArrow()
    x = found.column(0).combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)) if found.num_rows else np.zeros((0, len(FEATURES)))
    return fitted(x, found.column(1).to_numpy().astype(np.float64), how)


def scored(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """Add the score of each row's text; other columns stay, one named like the new one is replaced."""
    rest = docs.drop(out)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([statistics((t or "").encode()) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x))

    return rest.withColumn(out, score(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    ``labels``: doc_id and quality; rows whose quality is neither 0 nor 1 teach nothing, and of several rows of one
    id the smallest quality counts. Texts alone decide a score: equal texts score alike. Null and empty texts have statistics
    of 0 and are scored as well; null ids are held out; repeated rows each get their score; empty tables give an
    empty table. Without labels of both kinds the score is the same for all. Further columns are left aside.
    """
    rows = scored(docs.select("doc_id", "text"), learned(docs, labels, how))
    return rows.select("doc_id", held_out(F.col("doc_id"), how.folds).alias("held_out"), "score", F.when(F.col("score") >= how.limit, 1).otherwise(0).alias("predicted"))

"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of a whole text are transformed (logs, roots) so that each class is near a normal
distribution. Class means and covariances come from sums that Spark aggregates over every labelled
row outside the held-out fold; covariances are shrunk towards the pooled one and its diagonal. A
score is a squashed difference of Mahalanobis log-densities, with the Cholesky factors of both
classes computed once and shipped with the scoring function.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from reprolens.llm.common import Stage, as_bytes, batches, plain, trim

FOLDS = 5  # crc32(doc_id as text) modulo this; remainder 0 is held out
CUT = 0.3  # a score from here on predicts quality 1
SHRINK = 0.1  # least weight of the pooled covariance
RIDGE = 1e-3  # on standardised statistics
BATCH = 1 << 21  # bytes of text that a task of the pipeline judges at once
#: Frequent function words of the four languages of the corpus, fixed values.
FUNCTION_WORDS = frozenset(
    b"a an and are as at be by das de del den der des die du ein el elle en es est et for from he il in is ist it la las le les los mit nicht no of on or para par por pour que qui re se sich sie sur that the this to un una und une von was with y zu".split()
)
_FORMS = sorted({form + end for w in FUNCTION_WORDS for form in (w, w.capitalize(), w.upper()) for end in (b"", b",", b".")})
_ZEROS = [0] * len(_FORMS)
_KINDS = np.zeros((5, 256), dtype=np.int64)  # rows: upper case, digits, symbols, white space, other bytes of words
_KINDS[0, ord("A") : ord("Z") + 1] = 1
_KINDS[1, ord("0") : ord("9") + 1] = 1
_KINDS[2, [ord(c) for c in "#$%&*!|<>{}[]=+~^@\\/_`"]] = 1
_KINDS[3, [0x20, *range(0x09, 0x0E)]] = 1
_KINDS[4] = 1 - _KINDS[:4].sum(axis=0)
_LINE = re.compile(rb"[^\n]+")
_END = re.compile(rb"[.!?]")

NAMES = ("words", "word_length", "length_spread", "upper", "digits", "symbols", "bars", "shouts", "distinct", "repeats", "line_repeats", "function_words", "sentence", "top_word")


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one UTF-8 text; all zero without words. Long texts cost time in proportion."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts = _KINDS @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, int(counts[0] + counts[4]))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    seen = Counter(words)
    lines = _LINE.findall(raw)
    same = sum(map(operator.eq, words, words[1:]))
    known = sum(map(seen.get, _FORMS, _ZEROS))
    root = np.log1p(n)
    return [
        root,
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        (counts[0] / letters) ** 0.5,
        (counts[1] / max(1, len(raw))) ** 0.5,
        float(np.log1p(50 * counts[2] / n)),
        (raw.count(b"|") / n) ** 0.5,
        (raw.count(b"!") / n) ** 0.5,
        float(np.log(len(seen)) - 0.75 * root),
        (same / n) ** 0.5,
        (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        (known / n) ** 0.5,
        float(np.log1p(n / (1 + len(_END.findall(raw))))),
        (max(seen.values()) / (n + 3)) ** 0.5,
    ]


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each row's whole text (null: empty)."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            x = [statistics(raw) for raw in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


@dataclass
class Model:
    """Standardisation, and for classes 0 and 1: log prior, mean, inverse Cholesky factor, log determinant of it."""

    shift: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1. A class that had no labelled rows has density 0; without any labels all scores are 0.5."""
        if len(self.classes) < 2:
            return np.full(len(x), 0.5)
        z = (x - self.shift) / self.scale
        parts = []
        for prior, mean, inverse, log_det in self.classes:
            y = (z - mean) @ inverse.T
            parts.append(prior + log_det - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip((parts[1] - parts[0]) * self.temper, -60, 60)))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """From count, sum and sum of outer products of each class (0, 1)."""
    d = len(NAMES)
    have = {c: s for c, s in sums.items() if s[0] > 0}
    total = sum(s[0] for s in have.values())
    if len(have) < 2:
        return Model(np.zeros(d), np.ones(d), [])
    shift = sum(s[1] for s in have.values()) / total
    spread = np.diag(sum(s[2] for s in have.values())) / total - shift**2
    scale = np.sqrt(np.maximum(spread, 1e-12))
    scale[spread <= 1e-12] = 1.0
    covariance, mean = {}, {}
    for c, (n, s, o) in have.items():
        m = s / n
        covariance[c] = (o / n - np.outer(m, m)) / np.outer(scale, scale)
        mean[c] = (m - shift) / scale
    pooled = sum(have[c][0] * covariance[c] for c in have) / total
    classes = []
    for c in (0, 1):
        n = have[c][0]
        a = max(shrink, d / (n + d))
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
        full = (1 - a) * covariance[c] + a * target + ridge * np.eye(d)
        inverse = np.linalg.inv(np.linalg.cholesky(full))
        classes.append((float(np.log(n / total)), mean[c], inverse, float(np.log(np.diag(inverse)).sum())))
    return Model(shift, scale, classes, temper=1 / np.sqrt(d))


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Two rows of sums, whatever the number of labelled rows."""
    d, x = len(NAMES), F.col("x")
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    outer = [F.sum(x[i] * x[j]).alias(f"o{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for r in labelled.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n"), *sums, *outer).collect():
        o = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                o[i, j] = o[j, i] = r[f"o{i}_{j}"]
        out[r["quality"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), o)
    return out


def train(features: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows with a quality of 0 or 1 outside the held-out fold; null labels and other values count for nothing.

    Labels that repeat a doc_id count once, and not at all if they contradict each other; each row of a
    repeated document counts.
    """
    known = plain(labels, "doc_id", "quality").filter((fold(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    return fit(moments(features.join(known, "doc_id")))


def score(features: DataFrame, model: Model) -> DataFrame:
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.score(x), 9))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; repeated rows are scored alike, an empty table gives no rows."""
    features = Stage(spark, "quality").write(featurize(docs), "features")
    out = score(features, train(features, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that aren't predicted to be of quality 0, with all their columns.

    Each row is judged by its own text, whatever its id; rows travel with their statistics and are never joined.
    """
    row = StructField("row", docs.schema)
    held = StructType([row, StructField("x", ArrayType(DoubleType()))])

    def featurized(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches((pa.RecordBatch.from_arrays([f.column(0), f.column(0).field("text")], names=["row", "text"]) for f in frames if f.num_rows), limit=BATCH):
            x = [statistics(raw) for raw in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["row", "x"])
        trim()

    stage = Stage(spark, "quality")
    rows = stage.write(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(featurized, held), "rows")
    model = train(rows.select(F.col("row.doc_id").alias("doc_id"), "x"), labels)

    def good(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield b.select([0]).filter(pa.array(np.round(model.score(x), 9) >= CUT))
        trim()

    return rows.mapInArrow(good, StructType([row])).select("row.*")

"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= j) = sigmoid(theta_j - w.x) with one weight vector shared by all ordered thresholds
theta_0 < theta_1 < theta_2. The grades are 0 (clean) and 1 to 3 (mild, marked, severe). The labels
say only toxic or not; a toxic training row is graded by the evidence that a two-grade model fitted
on the other half of the rows finds in it, cut at the terciles, so no row's grade comes from weights
that the row itself has shaped. Features are sparse and binary: each distinct lower-cased word of
letters, and its beginnings of ``PREFIXES`` letters. Every feature that ``SUPPORT`` toxic rows share
and that is ``RATIO`` times as common in toxic rows as in clean ones takes part, however many these
are; the L1 penalty alone chooses among them, and weights never go below zero. Scores: the expected grade, P(grade >= 1), and the prediction
toxic where that is at least 0.5.

Null or empty text: no features, scored by the thresholds alone. Null doc_id: scored, never held
out. Repeated rows each return their row; in fitting, rows of equal features count once. No usable
label of both kinds: every row is clean. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import held_out, map_rows, texts_per_batch
from wayfold.llm.labelled import sample
from wayfold.session import Scratch

LETTERS = re.compile(r"[^\W\d_]+")
#: What a feature is: a word, or a word's beginning of so many letters.
PREFIXES = range(3, 9)
GRADES = 3
#: Labelled rows used to fit, at most.
MAX_TRAIN = 8000
#: Toxic rows that must share a feature, how much commoner it must be in these, and the L1 penalty on weights.
SUPPORT, RATIO, PENALTY = 5, 3.0, 1e-4
PIECE = 1 << 20


def words(text: str | None) -> set[str]:
    """The distinct lower-cased words of a whole text, taken in pieces that end at white space."""
    text = text or ""
    if len(text) <= PIECE:
        return set(LETTERS.findall(text.lower()))
    out, at = set(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        out.update(LETTERS.findall(text[at:end].lower()))
        at = end
    return out


def parts(word: str) -> list[str]:
    """The features of a word: itself, and its prefixes marked with ^."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: dict[str, float]
    thresholds: list[float]

    def __post_init__(self):
        #: How the words with any weight begin: most words are passed over by this alone.
        self.heads = {k.lstrip("^")[:3] for k in self.weights}

    def linear(self, text: str | None) -> float:
        heads, weights = self.heads, self.weights
        found = {x for w in words(text) if w[:3] in heads for x in parts(w) if x in weights}
        return sum(weights[x] for x in sorted(found))

    def above(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 - _sigmoid(np.array(self.thresholds) - self.linear(text))


@dataclass
class Rows:
    """Binary features of rows in coordinate form: ``row[i]`` has feature ``column[i]``."""

    row: np.ndarray
    column: np.ndarray
    n_rows: int
    n_columns: int

    def take(self, rows: np.ndarray) -> Rows:
        """The rows where ``rows`` holds, in their order."""
        number = np.cumsum(rows) - 1
        mine = rows[self.row]
        return Rows(number[self.row[mine]], self.column[mine], int(rows.sum()), self.n_columns)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=self.n_rows)


def loss_and_gradient(rows: Rows, grade: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades, and its gradient in the weights and the thresholds."""
    n, grades = rows.n_rows, len(theta)
    at, f = np.arange(n), rows.scores(w)
    below = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None] - f[:, None]), np.ones((n, 1))], 1)
    slope = below * (1 - below)
    like = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
    by_score = (slope[at, grade + 1] - slope[at, grade]) / like / n
    by_theta = np.array([((grade == j + 1) * slope[:, j + 1] / like - (grade == j) * slope[:, j + 1] / like).sum() / n for j in range(grades)])
    return float(-np.log(like).mean()), np.bincount(rows.column, by_score[rows.row], minlength=rows.n_columns), by_theta


def fit_grades(rows: Rows, grade: np.ndarray, grades: int, steps: int = 600, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights >= 0 and ordered thresholds by proximal gradient with Adam scaling."""
    over = [max(1e-3, min(1 - 1e-3, float((grade > j).mean()))) for j in range(grades)]
    w, theta = np.zeros(rows.n_columns), np.array([np.log((1 - p) / p) for p in over]) + 1e-3 * np.arange(grades)
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros(grades), np.zeros(grades)
    for t in range(1, steps + 1):
        _, g, dt = loss_and_gradient(rows, grade, w, theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * dt, 0.99 * vt + 0.01 * dt * dt
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        scale = rate / (np.sqrt(v) + 1e-4)
        w = np.maximum(w - scale * (m + penalty), 0)  # evidence only ever adds severity
        theta = np.sort(theta - rate * mt / (np.sqrt(vt) + 1e-4))
        theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades))
    return w, theta


def graded(rows: Rows, toxic: np.ndarray, half: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 to 3 for toxic ones, by what the model of the other half finds in them."""
    evidence = np.zeros(rows.n_rows)
    for side in (0, 1):
        mine, others = half == side, half != side
        if mine.any() and others.any():
            w, _ = fit_grades(rows.take(others), toxic[others], 1, steps=300)
            evidence[mine] = rows.take(mine).scores(w)
    low, high = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (evidence > low) + (evidence > high), 0).astype(int)


def fit_rows(rows: Rows, names: list[str], toxic: np.ndarray, half: np.ndarray) -> Ordinal:
    """Fit on rows of numbered features; ``half`` (0 or 1) deals the rows to two halves for grading."""
    toxic = np.asarray(toxic).astype(int)
    if not len(toxic) or toxic.min() == toxic.max():
        return Ordinal({}, [20.0 + j for j in range(GRADES)])
    w, theta = fit_grades(rows, graded(rows, toxic, half), GRADES)
    return Ordinal({names[k]: float(w[k]) for k in np.flatnonzero(w)}, theta.tolist())


def _features(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, y, features): the distinct features of each row, rows of equal features and label once.

    Rows are told apart by a digest of their features, so that only digests are dealt out.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted({x for w in words(t) for x in parts(w)}) for t in batch.column(2).to_pylist()]
            digests = [sha256("\n".join(x).encode()).digest() for x in found]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.string()))], ["id", "y", "digest", "features"])

        return one

    rows = scratch.keep(map_rows(known, ["doc_id", "y", F.col("text").cast("string")], make, "id long, y int, digest binary, features array<string>"))
    first = scratch.keep(rows.groupBy("y", "digest").agg(F.min("id").alias("id")).select("id"))
    return rows.join(F.broadcast(first), "id", "left_semi").select("id", "y", "features")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Ordinal:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold.

    Features are counted in Spark; the driver gets those that take part, and the numbers of these that each
    row has.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _features(sample(docs, labels, "toxic", ["text"], max_rows), scratch)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ill")).first()
    n, ill = totals["n"], totals["ill"]
    if not 0 < ill < n:
        return fit_rows(Rows(np.zeros(0, int), np.zeros(0, int), n, 0), [], np.full(n, int(ill > 0)), np.zeros(n))
    each = rows.select("id", "y", F.explode("features").alias("name"))
    counts = each.groupBy("name").agg(F.sum("y").alias("ill"), F.count("*").alias("all"))
    chosen = counts.where((F.col("ill") >= SUPPORT) & ((F.col("ill") + 0.5) / (ill + 1) > RATIO * (F.col("all") - F.col("ill") + 0.5) / (n - ill + 1)))
    chosen = scratch.keep(chosen.select("name"))
    names = sorted(r["name"] for r in chosen.collect())
    met = each.join(F.broadcast(chosen), "name").groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    got = rows.select("id", "y").join(met, "id", "left").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    number = {x: k for k, x in enumerate(names)}
    lists = [x or [] for x in got.column("names").to_pylist()]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.array([number[x] for mine in lists for x in mine], int)
    half = np.array([crc32(str(i).encode()) >> 8 & 1 for i in got.column("id").to_pylist()])
    return fit_rows(Rows(row, column, len(lists), len(names)), names, got.column("y").to_numpy(), half)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, held_out, score, predicted, expected_severity, grade) of every row; score is P(grade >= 1)."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = np.array([model.above(t) for t in batch.column(2).to_pylist()])
            at_least = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
            grade = np.where(p[:, 0] >= 0.5, 1 + np.argmax((at_least[:, :-1] - at_least[:, 1:])[:, 1:], 1), 0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32)), pa.array(p.sum(1)), pa.array(grade.astype(np.int32))], ["doc_id", "held_out", "score", "predicted", "expected_severity", "grade"])

        return one

    columns = [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")]
    return map_rows(docs, columns, make, "doc_id long, held_out boolean, score double, predicted int, expected_severity double, grade int")


def keep_clean(docs: DataFrame, model: Ordinal, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with P(grade >= 1) under ``below``, all columns as they are."""
    from pyspark.sql.functions import arrow_udf

    texts_per_batch(docs.sparkSession)

    @arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([float(model.above(t)[0]) < below for t in text.to_pylist()], pa.bool_())

    return docs.where(clean(docs["text"].cast("string")))

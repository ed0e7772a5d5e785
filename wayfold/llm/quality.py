"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): every pair of
features interacts through its low-rank factors, in time linear in the features of a text.

Features of a whole text: each distinct lower-cased word, hashed into ``WORDS`` buckets, and
structure statistics (shares of character classes, repetition, line and word lengths) and the
character count of the table, each cut into ``BINS`` bins. Labels, language, source and doc_id
are never features.

Null or empty text: the statistics of an empty text, scored like any other. Null n_chars: the
text's own length. Null doc_id: scored, never held out. Repeated rows each return their row. No
usable label: every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import held_out, map_rows
from wayfold.llm.labelled import sample
from wayfold.llm.texts import LONG_TEXT, LOWER, utf8, word_blocks

WORDS = 1 << 15
BINS = 16
RANK = 8
#: Labelled rows used to fit, at most.
MAX_TRAIN = 6000
EPOCHS = 12


def _share(part: float, whole: float) -> int:
    return min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole else 0


def _scale(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, x))))


def statistics(text: str | None, n_chars: int | None) -> tuple[list[int], Counter]:
    """The bin of each structure statistic, and the lower-cased words with their counts."""
    data = utf8(text)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts: Counter = Counter()
    n = repeats = pairs = fresh_pairs = word_bytes = short = 0
    last: list[bytes] = []
    codes: dict[bytes, int] = {}
    coded: list[np.ndarray] = []
    for words in word_blocks(data.translate(LOWER)):
        counts.update(words)
        n += len(words)
        word_bytes += sum(map(len, words))
        if len(data) > LONG_TEXT:  # pairs over all blocks, as numbers
            coded.append(np.array([codes.setdefault(w, len(codes)) for w in words], np.uint32))
            words = last + words
            last = words[-1:]
        next_words = words[1:]
        repeats += sum(map(bytes.__eq__, words, next_words))
        pairs += len(next_words)
        if not coded:
            fresh_pairs = len(set(zip(words, next_words, strict=False)))
    if coded:
        whole = np.concatenate(coded).astype(np.uint64)
        fresh_pairs = len(np.unique(whole[:-1] << np.uint64(32) | whole[1:]))
    short = sum(c for w, c in counts.items() if len(w) <= 2)
    lines = data.split(b"\n")
    size = len(data)
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    space = int(h[32] + h[9:14].sum())
    high = int(h[128:].sum())
    marks = size - upper - lower - digits - space - high
    ends = int(h[46] + h[63])
    top = max(counts.values(), default=0)
    bins = [
        _share(upper, upper + lower), _share(digits, size), _share(space, size), _share(high, size), _share(marks, size),
        _share(h[33], n), _share(h[35] + h[36] + h[37] + h[38] + h[42], n), _share(h[124], n), _share(h[44], n), _share(ends, n),
        _share(h[60] + h[62] + h[123] + h[125] + h[61] + h[59], n), _share(h[47] + h[58] + h[64], n),
        _share(len(counts), n), _share(top, n), _share(repeats, pairs), _share(fresh_pairs, pairs), _share(short, n),
        _scale(n), min(BINS - 1, int(word_bytes / n)) if n else 0, _scale(len(lines)), _share(len(set(lines)), len(lines)), _scale(n / len(lines)),
        _scale(n_chars if n_chars is not None else len(text or "")),
    ]
    return bins, counts


STATS = 23
SIZE = WORDS + STATS * BINS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the features that are not zero."""
    bins, counts = statistics(text, n_chars)
    words = np.array([crc32(w) % WORDS for w in counts], np.int32)
    index = np.concatenate([words, WORDS + BINS * np.arange(STATS, dtype=np.int32) + np.array(bins, np.int32)])
    value = np.concatenate([np.full(len(words), 1 / math.sqrt(len(words) or 1), np.float32), np.ones(STATS, np.float32)])
    return index, value


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (s @ s - (v * v).sum()))

    def score(self, text: str | None, n_chars: int | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.raw(*features(text, n_chars))))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Minibatch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(SIZE, np.float64), rng.normal(0, 0.02, (SIZE, RANK)), 0.0
    if not len(y) or y.min() == y.max():
        return Machine(0.0 if not len(y) else (4.0 if y[0] else -4.0), w.astype(np.float32), np.zeros_like(v, np.float32))
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            take = order[at : at + 64]
            index = np.concatenate([rows[i][0] for i in take])
            value = np.concatenate([rows[i][1] for i in take]).astype(np.float64)
            starts = np.r_[0, np.cumsum([len(rows[i][0]) for i in take])[:-1]]
            row = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
            vx = v[index] * value[:, None]
            s = np.add.reduceat(vx, starts)
            raw = b + np.add.reduceat(w[index] * value, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            d = (1 / (1 + np.exp(-raw)) - y[take]) / len(take)
            used, slot = np.unique(index, return_inverse=True)
            g = np.bincount(slot, d[row] * value) + 1e-5 * w[used]
            own = (d[row] * value)[:, None] * (s[row] - vx)
            f = np.stack([np.bincount(slot, own[:, k]) for k in range(RANK)], 1) + 1e-5 * v[used]
            gw[used] += g * g
            gv[used] += f * f
            gb += d.sum() ** 2
            w[used] -= 0.1 * g / np.sqrt(gw[used])
            v[used] -= 0.03 * f / np.sqrt(gv[used])
            b -= 0.1 * d.sum() / math.sqrt(gb)
    return Machine(float(b), w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold; features are made on the executors."""
    known = sample(docs, labels, "quality", ["text", "n_chars"], max_rows)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], ["doc_id", "y", "index", "value"])

        return one

    got = map_rows(known, ["doc_id", "y", F.col("text").cast("string"), F.col("n_chars").cast("long")], make, "doc_id long, y int, index array<int>, value array<float>").toArrow().sort_by("doc_id")
    rows = [(i.values.to_numpy(), x.values.to_numpy()) for i, x in zip(got.column("index"), got.column("value"), strict=True)]
    return fit_rows(rows, got.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([machine.score(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.float64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return one

    columns = [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars")]
    return map_rows(docs, columns, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``at_least``, all columns as they are."""
    from pyspark.sql.functions import arrow_udf

    from wayfold.llm.arrowtools import texts_per_batch

    texts_per_batch(docs.sparkSession)

    @arrow_udf("boolean")
    def good(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array([machine.score(t, n) >= at_least for t, n in zip(text.to_pylist(), n_chars.to_pylist(), strict=True)], pa.bool_())

    return docs.where(good(docs["text"].cast("string"), docs["n_chars"].cast("long")))

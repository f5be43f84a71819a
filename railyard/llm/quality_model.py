"""Quality classifier (operator 10): naive Bayes support vectors.

Indicators of n-grams (byte 3-grams, and 1- and 2-grams of word shapes with the
share of the text they make up), hashed into a fixed space, are scaled by their
class log-count ratios; a linear hinge-loss model is fitted on the scaled,
length-normalised indicators by dual coordinate descent; a logistic link on
held-back sample rows turns margins into scores.

The fit uses a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` of each
class, in the order of a hash of their ids); every whole text is scored.

Defined results: null and empty texts have no indicators and get the score of
the intercept; labels that are null are ignored, several labels of one id count
by their mean (0.5 and up is 1); with one class or no label at all the score is
the share of label 1 (0.5 if none); repeated rows each get a row; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import SPACE, U64, batch_of, mix, slices, text_bytes, word_hashes, word_spans

#: Labelled rows of each class that the fit takes at most.
SAMPLE_PER_CLASS = 3_000
#: Hashed n-gram space.
BUCKETS = 1 << 17
EPOCHS = 12
PENALTY = 1.0
SLICE = 1 << 20
#: A table of flags is used up to so many per indicator; few indicators of many rows are sorted.
DENSE = 16

_LOWER, _UPPER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_HIGH[128:] = True


def _any(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[end] > total[start]


def indicators(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct indicator of a slice, in row order. The
    memory goes with the text, not with rows x buckets."""
    rows = len(off) - 1
    found = [np.zeros(0, np.int64)]  # row * BUCKETS + bucket
    if len(raw) >= 3:
        row = np.repeat(np.arange(rows), np.diff(off))
        same = row[2:] == row[:-2]
        gram = raw[:-2].astype(U64) << U64(16) | raw[1:-1].astype(U64) << U64(8) | raw[2:].astype(U64)
        found.append(row[2:][same] * BUCKETS + (mix(gram[same]) % U64(BUCKETS)).astype(np.int64))
    start, end, bound = word_spans(raw, off, SPACE)
    if len(start):
        word = np.repeat(np.arange(rows), np.diff(bound))
        h = word_hashes(raw, start, end)
        tail = raw[end - 1]
        shape = sum(_any(f[raw], start, end).astype(np.int64) << i for i, f in enumerate((_LOWER, _UPPER, _DIGIT, _HIGH)))
        shape |= np.where((_LOWER | _UPPER | _DIGIT | _HIGH)[tail], 0, tail.astype(np.int64)) << 4
        shape |= _UPPER[raw[start]].astype(np.int64) << 12 | np.minimum(np.log2(end - start), 3).astype(np.int64) << 13
        for back in (1, 2):
            shape[back:] |= ((h[back:] == h[:-back]) & (word[back:] == word[:-back])).astype(np.int64) << (14 + back)
        pair = shape.copy()
        pair[1:] |= np.where(word[1:] == word[:-1], shape[:-1] + 1, 0) << 20
        n_words = np.maximum(1, np.diff(bound))
        for k, grams in enumerate((shape, pair)):
            key = mix(grams.astype(U64) + U64(k + 1 << 60))
            order = np.lexsort((key, word))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (word[order][1:] != word[order][:-1])
            at = np.flatnonzero(new)
            count, r = np.diff(np.append(at, len(order))), word[order][at]
            # one indicator per halving of the share of the text that the n-gram reaches
            share = np.minimum(6, -np.log2(count / n_words[r])).astype(np.int64)
            for level in range(7):
                on = share <= level
                found.append(r[on] * BUCKETS + (mix(key[order][at][on] + U64(level)) % U64(BUCKETS)).astype(np.int64))
    places = np.concatenate(found)
    if rows * BUCKETS <= DENSE * len(places):
        present = np.zeros(rows * BUCKETS, bool)
        present[places] = True
        places = np.flatnonzero(present)
    else:
        places = np.unique(places)
    return places // BUCKETS, places % BUCKETS


@dataclass
class Model:
    """score = logistic(a * margin + b); margin = sum(weight) / norm over a text's indicators."""

    weight: np.ndarray
    square: np.ndarray
    a: float
    b: float

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        row, bucket = indicators(raw, off)
        norm = np.sqrt(np.bincount(row, self.square[bucket], rows))
        margin = np.bincount(row, self.weight[bucket], rows) / np.maximum(norm, 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


class Scaled:
    """Row values ratio[row] / norm, made when asked for: the driver holds the indices alone."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.scale = [1 / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] * self.scale[i]

    def __len__(self) -> int:
        return len(self.rows)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray] | Scaled, y: np.ndarray, cost: np.ndarray, size: int,
                            epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost_i * hinge(y_i w.x_i), x_i sparse."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([max(1e-9, float(values[i] @ values[i])) for i in range(len(rows))])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ x) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


def logistic_link(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the weighted logistic fit of y (0/1) on the margin, by Newton steps with a small ridge."""
    x, beta = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        s = weight * p * (1 - p)
        beta += np.linalg.solve((x * s[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (y - p)) - 1e-3 * beta)
    return float(beta[0]), float(beta[1])


def train(rows: list[np.ndarray], y: np.ndarray, share_of_ones: float) -> Model:
    """Model of indicator lists and 0/1 labels; ``share_of_ones`` is that of all labelled rows."""
    prior = float(np.clip(share_of_ones, 0.01, 0.99))
    base = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        level = prior if len(y) else 0.5
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, float(np.log(level / (1 - level))))
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    fitted = np.flatnonzero(~held)
    counts = np.ones((2, BUCKETS))
    for i in fitted:
        counts[y[i], rows[i]] += 1  # the indicators of a row are distinct
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    n = {c: max(1, int((y[fitted] == c).sum())) for c in (0, 1)}
    cost = np.array([PENALTY * len(fitted) / (2 * n[y[i]]) for i in fitted])
    mine = [rows[i] for i in fitted]
    w = dual_coordinate_descent(mine, Scaled(mine, ratio), 2.0 * y[fitted] - 1, cost, BUCKETS)
    use = np.flatnonzero(held) if held.any() else fitted
    tried = [rows[i] for i in use]
    values = Scaled(tried, ratio)
    margin = np.array([w[r] @ values[k] for k, r in enumerate(tried)])
    ones = max(1, int(y[use].sum()))
    weight = np.where(y[use] == 1, prior * len(use) / ones, (1 - prior) * len(use) / max(1, len(use) - ones))
    a, b = logistic_link(margin, y[use].astype(float), weight)
    return Model(w * ratio, ratio ** 2, max(a, 0.0), b if np.isfinite(b) else base)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "quality", id_column: str = "doc_id",
        text_column: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class among the ids for which ``learn`` holds."""
    votes = (labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).filter(learn)
             .groupBy(F.col(id_column).alias("id")).agg((F.avg(F.col(label_column)) >= 0.5).cast("int").alias("y")))
    n = {r.y: r.n for r in votes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return train([], np.zeros(0, int), 0.5)
    picked = None
    for y in sorted(n):
        some = votes.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * per_class rows of (id, y): a bounded broadcast; of each id one row, that of the least text hash
    sample = (docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
              .join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    schema = T.StructType([sample.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("grams", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                raw, off, _ = text_bytes(part.column("text"))
                row, bucket = indicators(raw, off)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield batch_of(arrow, part.column("id"), part.column("y"), [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])])

    got = sample.mapInArrow(run, schema).toArrow()  # one index list an id
    grams = [np.frombuffer(g.as_buffer(), np.int32) for g in got.column("grams")]
    labels_of, ids = got.column("y").to_pylist(), got.column("id").to_pylist()
    order = sorted(range(len(grams)), key=lambda i: (str(ids[i]), zlib.crc32(grams[i])))
    order = [order[i] for i in np.random.default_rng(11).permutation(len(order))]
    return train([grams[i] for i in order], np.array([labels_of[i] for i in order], int), n.get(1, 0) / sum(n.values()))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the score column (an input column of that name is replaced)."""
    columns = [c for c in docs.columns if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_column, SLICE):
                raw, off, _ = text_bytes(part.column(text_column))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(raw, off))], names=[*part.schema.names, name])

    return source.mapInArrow(run, schema)


def remainder(id_column: str, modulus: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    model = fit(docs, labels, remainder("doc_id", 5) != 0)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

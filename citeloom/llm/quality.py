"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (shares of character kinds, word and line repetition, lengths) are
standardised and mapped by random Fourier features, which approximate a Gaussian kernel.
Partitions sum their normal equations, the driver solves the ridge system, and a monotone step
function fitted on documents that the ridge has not seen turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import lean, plain_text

FEATURES = 384
#: At most about this many labelled documents are used to fit; taken by a hash of the identifier.
LABELLED = 12_000
RIDGE = 1e-3
#: The normal equations are summed in so many tasks at most.
FIT_TASKS = 6


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all are 0 for the empty one."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, nw = len(data), len(words)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(c[list(chars)].sum()) / n
    p = c[c > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, nw)
    counts = Counter(words)
    top = counts.most_common(3)
    same = sum(map(bytes.__eq__, words, words[1:])) / nw
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = Counter(lines)
    ends = sum(w[-1] in b".!?;:" for w in words) / nw
    odd = sum(not (w[0] > 127 or w[:1].isalpha()) for w in words) / nw
    return [
        np.log1p(nw), share(range(65, 91)), share(range(97, 123)), share(range(48, 58)), share(range(128, 256)), share(b" "), share(b"\n") * 10,
        share(b".,;:'\""), share(b"!"), share(b"?"), share(b"|"), share(b"#*$%&@^~_=+<>"), share(b"()[]{}/\\"), share(b"-"),
        float(-(p * np.log2(p)).sum()), lengths.mean(), lengths.std(), float(lengths.max() > 30), len(counts) / nw, top[0][1] / nw, sum(x[1] for x in top) / nw,
        min(1.0, len(counts) / nw**0.75), same, len(lines) / nw * 10, len(kinds) / len(lines), 1 - kinds.most_common(1)[0][1] / len(lines), np.log1p(nw / len(lines)),
        ends, odd, float((lengths <= 3).mean()), sum(w[:1].isupper() for w in words) / nw, sum(w.isupper() and len(w) > 1 for w in words) / nw,
    ]


N_STATISTICS = 32


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, N_STATISTICS)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: upper edges of the scores of each block, and the block means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, edge = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, edge]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class QualityModel:
    """The fitted classifier; ``score`` gives probabilities for texts."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    means: np.ndarray
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.waves + self.phases) * (2 / FEATURES) ** 0.5, np.ones((len(z), 1))])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = self.features(matrix(texts)) @ self.weights
        return np.interp(raw, self.edges, self.means)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, one, two = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS)
    for batch in lean(batches):
        x = matrix(batch.column("body").to_pylist())
        n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
    yield pa.RecordBatch.from_pydict({"part": [np.concatenate([[n], one, two]).tobytes()]})


def _equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in lean(batches):
            if batch.num_rows:
                y = np.asarray(batch.column("quality").to_pylist(), float)
                x = np.hstack([model.features(matrix(batch.column("body").to_pylist())), y[:, None]])
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    return run


def _raw(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            raw = model.features(matrix(batch.column("body").to_pylist())) @ model.weights
            yield pa.RecordBatch.from_pydict({"raw": pa.array(raw, pa.float64()), "quality": batch.column("quality").cast(pa.int32())})

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, limit: int) -> DataFrame:
    """(doc_id, body, label, part): a bounded sample of labelled documents outside the held-out fold.

    The sample is the rows with the smallest hashes of their identifiers; its identifiers are
    few by construction and are broadcast. Rows without a label or an identifier are left out.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (part != held))
    own = own.groupBy("doc_id").agg(F.max(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text(F.col("text")).alias("body"))
    return texts.join(F.broadcast(own), "doc_id").withColumn("part", part)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: int = LABELLED) -> QualityModel:
    """Fits on labelled rows outside fold ``held``; one more fold calibrates. Without any the score is constant; with one kind only the ridge fits that one."""
    sample = labelled(docs, labels, "quality", folds, held, limit).select("body", "quality", "part").repartition(FIT_TASKS).persist()
    calibrating = (held + folds - 1) % folds
    fitting = sample.filter(F.col("part") != calibrating)
    rng = np.random.default_rng(11)
    m = np.sum([np.frombuffer(r["part"]) for r in fitting.select("body").mapInArrow(_moments, "part binary").collect()], axis=0) if fitting.take(1) else np.zeros(1)
    zero = np.zeros(1)
    if m[0] == 0:
        sample.unpersist()
        return QualityModel(zero, zero, zero, zero, zero, zero, zero, 1.0)
    n, one, two = m[0], m[1 : N_STATISTICS + 1], m[N_STATISTICS + 1 :]
    scale = np.sqrt(np.maximum(two / n - (one / n) ** 2, 1e-8))
    waves = rng.standard_normal((N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS)
    model = QualityModel(one / n, scale, waves, rng.uniform(0, 2 * np.pi, FEATURES), zero, zero, zero)
    total = np.sum([np.frombuffer(r["part"]).reshape(FEATURES + 2, -1) for r in fitting.select("body", "quality").mapInArrow(_equations(model), "part binary").collect()], axis=0)
    model.weights = np.linalg.solve(total[:-1, :-1] + RIDGE * n * 2 / FEATURES * np.eye(FEATURES + 1), total[:-1, -1])
    seen = sample.filter(F.col("part") == calibrating).select("body", "quality").mapInArrow(_raw(model), "raw double, quality int").collect()
    sample.unpersist()
    if len({r["quality"] for r in seen}) < 2:
        model.edges, model.means = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    raw, y = np.array([r["raw"] for r in seen]), np.array([r["quality"] for r in seen], float)
    model.edges, model.means = isotonic(raw, y)
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def scorer(model):
    """mapInArrow function over (doc_id, held_out, body) for any model with ``score(texts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            scores = model.score(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], schema=SCORES)

    return run


def score(docs: DataFrame, model: QualityModel, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only the text is an input of the score. A null text is the empty one, whose statistics are
    all 0; a null doc_id is kept and counts as not held out.
    """
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == held, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), plain_text(F.col("text")).alias("body"))
    out = rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            scores = model.score([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of two embeddings, one by a hash of the word and one by a hash of its first
four letters. Filters of three widths run over the words of the whole text, their largest
outputs feed a logistic unit. A threshold for each language, found on documents that training
has not seen, is moved to one common place, so that scores compare across languages. The
language is guessed from the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import lean
from citeloom.llm.quality import FIT_TASKS, labelled, scorer

BUCKETS = 1 << 15
#: Words that a worker remembers.
VOCABULARY = 150_000
EMBEDDING, FILTERS, WIDTHS = 6, 6, (1, 2, 3)
#: At most this many labelled documents are used to train and calibrate, and of them, by hash of the identifier, as many as have so
#: many bytes of text together (codes of a word take 4 bytes in the driver). Texts are taken whole or not at all.
LABELLED, LABELLED_BYTES = 12_000, 256 << 20
#: Training takes at most this many documents without the label for each one with it, from so many
#: in 1,000 of them by hash of the identifier. Calibration takes all.
NEGATIVES, THINNED = 2, 400
EPOCHS, BATCH, RATE = 6, 48, 0.03
#: Common words by language, fixed values.
COMMON = {
    "en": "the of and to in is that for with was",
    "de": "der die und den das von zu mit ist im",
    "fr": "de la le et les des en un une est",
    "es": "de la que el en y los se las un",
}
THRESHOLD = 0.7
STRIP = b".,;:!?\"'()[]*#%&$|"


class Vocabulary(dict):
    """word -> row of ``pairs`` (hash of the word, hash of its first four letters); bounded, dealt anew when full."""

    def __init__(self):
        self.pairs, self.turn = np.empty((1 << 14, 2), np.int32), 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        k = self[word] = len(self)
        if k == len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.empty_like(self.pairs)])
        bare = (word.strip(STRIP) or word).decode("utf-8", "replace").lower()
        self.pairs[k] = xxhash.xxh32_intdigest(bare.encode()) % BUCKETS, xxhash.xxh32_intdigest(b"\0" + bare[:4].encode()) % BUCKETS
        return k

    def rows(self, text: str) -> np.ndarray:
        """Row of each word of the whole text, valid until the next call."""
        words = text.encode().split()
        if len(self) > VOCABULARY:
            self.clear()
            self.turn += 1
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_words = Vocabulary()


def encode(text: str) -> np.ndarray:
    """Two bucket numbers for each word of the whole text."""
    rows = _words.rows(text)
    return _words.pairs[rows]


def language_table() -> np.ndarray:
    import xxhash

    out = np.zeros((BUCKETS, len(COMMON)), np.float32)
    for k, words in enumerate(COMMON.values()):
        for w in words.split():
            out[xxhash.xxh32_intdigest(w.encode()) % BUCKETS, k] = 1
    return out


def language(codes: np.ndarray, table: np.ndarray) -> int:
    """The language with most common words, or one more than the last where none occurs."""
    hits = table[codes[:, 0]].sum(0)
    return int(hits.argmax()) if hits.any() else len(COMMON)


@dataclass
class ToxicityModel:
    """Embeddings, filters and thresholds; ``score`` gives 0 to 1 with the threshold at THRESHOLD."""

    words: np.ndarray
    heads: np.ndarray
    filters: list[np.ndarray]  # by width: (width, EMBEDDING, FILTERS)
    biases: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: list[float] = field(default_factory=lambda: [0.5] * (len(COMMON) + 1))
    known: tuple | None = None

    def taps(self, codes: np.ndarray) -> np.ndarray:
        """What each filter adds at each of its places, for each pair of buckets."""
        every = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        return (self.words[codes[:, 0]] + self.heads[codes[:, 1]]) @ every

    def pooled(self, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest output of each filter (0 at least), and the place where it stands (-1: none)."""
        best, where = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
        first = 0
        for j, width in enumerate(WIDTHS):
            n = len(taps) - width + 1
            if n > 0:
                total = taps[:n, first : first + FILTERS]
                for k in range(1, width):
                    total = total + taps[k : n + k, first + k * FILTERS : first + (k + 1) * FILTERS]
                at, s = total.argmax(0), slice(j * FILTERS, (j + 1) * FILTERS)
                top = total[at, np.arange(FILTERS)] + self.biases[s]
                best[s], where[s] = np.maximum(top, 0), np.where(top > 0, at, -1)
            first += width * FILTERS
        return best, where

    def chance(self, taps: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(taps)[0] @ self.out + self.shift, -30, 30))))

    def score(self, texts: list[str]) -> np.ndarray:
        """Remembers the taps of each word of the worker's vocabulary, so that a text needs look-ups and sums only."""
        common, out = language_table(), np.zeros(len(texts))
        for i, text in enumerate(texts):
            rows = _words.rows(text)
            turn, table, tongue, n = self.known or (-1, np.empty((0, sum(WIDTHS) * FILTERS), np.float32), np.empty((0, len(COMMON)), np.float32), 0)
            if turn != _words.turn:
                n = 0
            if n < len(_words):
                if len(table) < len(_words.pairs):
                    table, tongue = (np.concatenate([x[:n], np.empty((len(_words.pairs) - n, x.shape[1]), np.float32)]) for x in (table, tongue))
                new = _words.pairs[n : len(_words)]
                table[n : len(_words)], tongue[n : len(_words)] = self.taps(new), common[new[:, 0]]
            self.known = (_words.turn, table, tongue, len(_words))
            hits = tongue.take(rows, axis=0).sum(0)
            p, t = self.chance(table.take(rows, axis=0)), self.thresholds[int(hits.argmax()) if hits.any() else len(COMMON)]
            out[i] = THRESHOLD * p / t if p < t else THRESHOLD + (1 - THRESHOLD) * (p - t) / max(1 - t, 1e-9)
        return out

    def __getstate__(self):
        return self.__dict__ | {"known": None}


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Adam on the logistic loss; the first embedding column starts at how much more often a bucket occurs in documents with the label."""
    rng = np.random.default_rng(seed)
    lift = []
    for col in (0, 1):
        counts = np.full((2, BUCKETS), 0.5)
        for codes, label in zip(docs, y, strict=True):
            counts[int(label)][np.unique(codes[:, col])] += 1
        rate = counts / np.array([[(y == 0).sum() + 1], [y.sum() + 1]])
        seen = counts[1] - 0.5
        lift.append(np.clip(np.log(rate[1] / rate[0]), -3, 4) * seen / (seen + 3))
    emb = [np.hstack([x[:, None], rng.normal(0, 0.05, (BUCKETS, EMBEDDING - 1))]).astype(np.float32) for x in lift]
    filters = [rng.normal(0, 0.2, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :])
    model = ToxicityModel(emb[0], emb[1], filters, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.5)
    params = {"words": emb[0], "heads": emb[1], "biases": model.biases, "out": model.out} | {f"f{j}": f for j, f in enumerate(filters)}
    m, v, t = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            grads = {k: np.zeros_like(p) for k, p in params.items() if k not in ("words", "heads")}
            g_words: dict[int, np.ndarray] = {}
            g_heads: dict[int, np.ndarray] = {}
            g_shift = 0.0
            for i in own:
                codes = docs[i]
                best, where = model.pooled(model.taps(codes))
                d = (1 / (1 + np.exp(-np.clip(best @ model.out + model.shift, -30, 30))) - y[i]) / len(own)
                grads["out"] += d * best
                g_shift += d
                back = d * model.out
                for c in np.flatnonzero(where >= 0):
                    j, f = divmod(int(c), FILTERS)
                    grads["biases"][c] += back[c]
                    for k in range(WIDTHS[j]):
                        w, h = codes[where[c] + k]
                        grads[f"f{j}"][k, :, f] += back[c] * (model.words[w] + model.heads[h])
                        g = back[c] * filters[j][k, :, f]
                        g_words[w] = g_words.get(w, 0) + g
                        g_heads[h] = g_heads.get(h, 0) + g
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            model.shift -= float(rate * 3 * g_shift)
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
            for name, part in (("words", g_words), ("heads", g_heads)):
                if part:
                    at, g = np.fromiter(part, np.int64, len(part)), np.array(list(part.values()))
                    m[name][at], v[name][at] = 0.9 * m[name][at] + 0.1 * g, 0.999 * v[name][at] + 0.001 * g * g
                    params[name][at] -= 0.3 * rate * m[name][at] / (np.sqrt(v[name][at]) + 1e-8)
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with fewest mistakes, in the middle of the widest such gap."""
    order = np.argsort(p)
    p, y = p[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[(1 - y).sum()], (1 - y).sum() - np.cumsum(1 - y)])
    edges = np.concatenate([[0.0], p, [1.0]])
    gaps = np.where(wrong == wrong.min(), np.diff(edges), -1)
    k = int(gaps.argmax())
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, limit: int = LABELLED, limit_bytes: int = LABELLED_BYTES) -> ToxicityModel:
    """Trains on labelled rows outside fold ``held``: three quarters train, thinned, and one quarter calibrates, all of it.

    The sample of at most ``limit`` documents and ``limit_bytes`` bytes is gathered as bucket numbers in the driver.
    Without labels of both kinds the model knows nothing and gives one score to all texts.
    """
    sample = labelled(docs, labels, "toxic", folds, held, limit)
    sizes = sample.groupBy("doc_id").agg(F.sum(F.octet_length("body")).alias("size"))  # at most ``limit`` rows
    within = sizes.withColumn("upto", F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("upto") <= limit_bytes)
    sample = sample.join(F.broadcast(within.select("doc_id")), "doc_id")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1000))
    rows = sample.select("doc_id", "body", "toxic", ((F.col("toxic") == 1) | (turn < THINNED)).cast("int").alias("trains"))

    def codes(batches):
        import pyarrow as pa

        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), batch.column("trains"), pa.array([encode(x).astype(np.uint16).tobytes() for x in batch.column("body").to_pylist()], pa.binary())], names=["doc_id", "toxic", "trains", "codes"])

    got = sorted((r["doc_id"], r["toxic"], bytes(r["codes"]), r["trains"]) for r in rows.select("doc_id", "body", "toxic", "trains").repartition(FIT_TASKS).mapInArrow(codes, "doc_id long, toxic int, trains int, codes binary").collect())
    y = np.array([r[1] for r in got], float)
    docs_codes = [np.frombuffer(r[2], np.uint16).astype(np.int32).reshape(-1, 2) for r in got]
    if not len(y) or y.min() == y.max():
        dim = FILTERS * len(WIDTHS)
        return ToxicityModel(np.zeros((BUCKETS, EMBEDDING), np.float32), np.zeros((BUCKETS, EMBEDDING), np.float32), [np.zeros((w, EMBEDDING, FILTERS), np.float32) for w in WIDTHS], np.zeros(dim, np.float32), np.zeros(dim, np.float32), 4.0 if len(y) and y.min() == 1 else -4.0)
    turns = np.random.default_rng(3).permutation(len(y))
    calibrating = np.zeros(len(y), bool)
    calibrating[turns[: len(y) // 4]] = True
    fitting, negatives = [], 0
    for i in turns[len(y) // 4 :]:
        if y[i] or got[i][3] and negatives < NEGATIVES * y.sum():
            fitting.append(i)
            negatives += not y[i]
    model = train([docs_codes[i] for i in fitting], y[fitting])
    table = language_table()
    p = np.array([model.chance(model.taps(docs_codes[i])) for i in np.flatnonzero(calibrating)])
    tongue = np.array([language(docs_codes[i], table) for i in np.flatnonzero(calibrating)])
    own = y[calibrating]
    common = best_threshold(p, own) if len({*own}) == 2 else 0.5
    for k in range(len(COMMON) + 1):
        here = tongue == k
        both = len({*own[here]}) == 2 and own[here].sum() >= 8
        model.thresholds[k] = best_threshold(p[here], own[here]) if both else common
    return model


def score(docs: DataFrame, model: ToxicityModel, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The whole text is the only input of the score; a null text is empty, and an empty text gets
    the score of no filter firing. A null doc_id is kept and counts as not held out.
    """
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == held, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    out = rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Document fingerprints: a digest of bucket quartiles, and a bounded difference of two digests.

Six byte triplets of every five-byte window are hashed to buckets and counted. A digest holds
a length code and, for each bucket, which quartile of the bucket counts it is in (two bits).
Two digests differ by the steps between their quartiles, with an extra charge for opposite
ends, and by their length codes up to a bound; likeness is one minus the share of the largest
possible difference.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import lean, partitions
from citeloom.llm.order import cut_points, range_of

BUCKETS = 256
#: The triplets of a window, by their places in it.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Difference of two quartiles, by how many steps they are apart.
STEPS = np.array([0, 1, 2, 6])
#: The length codes count at most this much.
LENGTH_BOUND = 48
LARGEST = 6 * BUCKETS + LENGTH_BOUND


def digest(data: bytes) -> np.ndarray:
    """Length code and quartile (0 to 3) of each bucket. Texts under three bytes have empty buckets."""
    n = len(data)
    counts = np.zeros(BUCKETS, np.int64)
    if n >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        first, second, third = b * np.uint32(0x9E3779B1), b * np.uint32(0x85EBCA77), b * np.uint32(0xC2B2AE3D)
        for k, (i, j, l) in enumerate(TRIPLETS):
            if n > l:
                h = first[i : n - l + i] + second[j : n - l + j] + third[l:]
                h += np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.empty(BUCKETS + 1, np.uint8)
    out[0] = min(255, round(12 * math.log2(n + 1)))
    out[1:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return out


def encode(d: np.ndarray) -> str:
    q = d[1:].reshape(-1, 4)
    return bytes([d[0]]).hex() + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for the largest difference."""
    apart = STEPS[np.abs(a[1:].astype(np.int8) - b[1:].astype(np.int8))].sum() + min(LENGTH_BOUND, abs(int(a[0]) - int(b[0])))
    return float(1 - apart / LARGEST)


def half_replaced(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of another text."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None

    def row(a: tuple, b: tuple) -> tuple:
        edited = half_replaced(a[2], b[2]).encode()
        d = digest(edited)
        return a[1], len(a[2]), hashlib.sha256(edited).hexdigest(), encode(a[3]), encode(d), likeness(a[3], d), likeness(a[3], b[3])

    for batch in lean(batches):
        out = []
        for at, doc_id, text, halo in zip(*(batch.column(c).to_pylist() for c in ("at", "doc_id", "body", "halo")), strict=True):
            if halo and (before is None or before[0] != at):
                continue  # a second row of a repeated first identifier
            now = (at, doc_id, text, digest(text.encode()))
            if before is not None and before[0] == at:
                out.append(row(before, now))
            before = None if halo else now
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(OUT), OUT, strict=True)], schema=OUT)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next document's.

    Next is by ascending doc_id, after the last comes the first; a single document is its own
    next. A null text is empty. Null identifiers come first; rows with one identifier are
    ordered by text. Ranges of identifiers go to one task each, together with a copy of the
    first row of the range after them, so every text moves once.
    """
    n_parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = rows.withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ranks = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("rank"), "text")
    low = ranks.agg(F.min("rank")).first()[0]
    points = cut_points(ranks, "rank", n_parts, F.coalesce(F.octet_length("text"), F.lit(0)) + 64) if low is not None else []
    at = range_of(F.col("rank"), points)
    firsts = F.split(F.lit(",".join(map(str, [low or 0, *points]))), ",").cast("array<bigint>")
    own = F.struct(F.col("at"), F.lit(False).alias("halo"))
    before = F.struct(F.when(F.col("at") > 0, F.col("at") - 1).otherwise(len(points)).alias("at"), F.lit(True).alias("halo"))
    placed = rows.withColumn("at", at).withColumn("places", F.when(F.get(firsts, F.col("at")) == F.col("rank"), F.array(own, before)).otherwise(F.array(own)))
    placed = placed.select("doc_id", "rank", "body", F.explode("places").alias("place")).select("place.at", "place.halo", "rank", "doc_id", "body")
    dealt = placed.repartition(n_parts, "at").sortWithinPartitions("at", "halo", "rank", "body")
    return dealt.select("at", "halo", "doc_id", "body").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

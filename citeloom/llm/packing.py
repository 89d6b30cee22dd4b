"""Packing documents into token sequences along a space-filling curve.

Documents are tokenised once; their hashed token counts are projected to four dimensions, and
the Hilbert index of the projection orders them, so neighbours on the curve are alike. The
order is cut into ranges at sampled keys; the token totals of the ranges give each its start,
and every range is cut into sequences on its own, continuing where the range before ends. Only
the very last sequence can be short, so padding is below one sequence for the whole corpus.
"""

from __future__ import annotations

import binascii
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Staged, lean, partitions, plain_text
from citeloom.llm.order import cut_points, range_of

SEQUENCE = 1024
END_ID = 0
DIMENSIONS, BITS = 4, 10
#: Bits of the order key below the Hilbert index; they spread documents with equal indexes.
SPREAD_BITS = 22


@functools.cache
def tokenizer(vocabulary: str, ranks: str | None):
    """encode(text) -> ids of ``tokenizers`` for the vocabulary, without special tokens.

    Ranks of the same vocabulary, where given, give the same ids at a third of the time: 133
    against 464 CPU seconds a GB here, with equal ids for all texts of the given tables up to sf0.1; tests compare those of
    sf0.01 and random texts. Texts with the string of a special token go to ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):  # those strings are tokens of their own to the tokenizer
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


@functools.cache
def projection(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) with ``bits`` bits in each dimension."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo excess work of the Gray code, from the highest bit down
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def curve_key(vectors: np.ndarray) -> np.ndarray:
    cells = np.clip((np.arctan(vectors / 2) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells)


TOKENS = pa.schema([("doc_id", pa.int64()), ("order_key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _tokenise(vocabulary: str, ranks: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = tokenizer(vocabulary, ranks), projection()
        for batch in lean(batches):
            bodies, spread = batch.column("body"), batch.column("spread").to_numpy(zero_copy_only=False)
            ids, sums = [], np.zeros((batch.num_rows, DIMENSIONS), np.float32)
            for k in range(batch.num_rows):
                own = encode(bodies[k].as_py())
                sums[k] = table[own & 0xFFFF].sum(0) / max(1.0, len(own)) ** 0.5
                ids.append(np.append(own, np.uint32(end_id)).astype("<u4" if own.size and own.max() > 0xFFFF else "<u2"))
            # two bytes an id where the vocabulary allows it; the length tells which
            key = curve_key(sums) << SPREAD_BITS | spread
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=TOKENS)

    return run


PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _cut(starts: list[int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for batch in lean(batches):
            out = []
            for r, doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("at", "doc_id", "n", "ids")), strict=True):
                if r != at:
                    at, place = r, starts[r]
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, size - place % size)
                    out.append((doc_id, start, length, binascii.crc32(ids[start : start + length]), n, place // size, place % size))
                    start, place = start + length, place + length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(PIECES))], schema=PIECES)

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document gives its ids and one ``end_id``; an empty or null text gives that id alone.
    Sequences are numbered from 0 along the curve and are full but for the last. Repeated rows
    are packed as often as they occur; null identifiers are kept. No rows in, no rows out.
    """
    spark, n_parts = docs.sparkSession, partitions(docs.sparkSession)
    stage = Staged(spark, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text(F.col("text")).alias("body"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << SPREAD_BITS)).alias("spread"))
    tokens = stage.write(rows.mapInArrow(_tokenise(vocabulary, ranks, end_id), "doc_id long, order_key long, n long, ids binary"))
    points = cut_points(tokens, "order_key", n_parts)
    placed = tokens.withColumn("at", range_of(F.col("order_key"), points))
    held = {r["at"]: r["n"] for r in placed.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    starts = np.cumsum([0, *(held.get(k, 0) for k in range(len(points)))]).tolist()
    dealt = placed.repartition(n_parts, "at").sortWithinPartitions("at", "order_key", "doc_id", "ids")
    return dealt.select("at", "doc_id", "n", "ids").mapInArrow(_cut(starts, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

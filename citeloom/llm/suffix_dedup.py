"""Repeated passages by column-wise construction over the strings of minimizer fragments.

A passage of ``LENGTH`` bytes is judged by all strings of that length. Every such string has a
minimizer, the smallest hash of its ``K``-byte substrings; equal strings have equal minimizers.
So each document is cut into fragments, runs of strings with one minimizer, and fragments are
dealt to tasks by it: what can be equal meets, and each task holds a collection of short texts.

1. Copies of a whole text keep their first document only; the others are removed as they are.
2. Fragments without a key that another document has are found and left out. A key is a minimizer
   with the 15 bytes before or after it, of which every string has one or the other whole. (Short minimizers
   alone are shared by chance, the more the larger the table.) Tasks send each of theirs once, so a key
   of all documents costs one entry a task.
3. Equal fragments become one, with the smallest identifier they occur in: first in each batch,
   so a fragment of all documents travels once a batch, then in the task of their minimizer.
4. Minimizers with several different fragments get a collection whose texts are the strings of
   those fragments. It is built column by column, from the right: round j inserts one symbol of
   every text and so orders its suffixes of length j by the BWT column of round j - 1, and
   updates the common-prefix column, which marks neighbours that are equal so far. The columns
   are read and written in sequence, one file each. After the last round, runs of equal
   neighbours are the equal strings, and take the smallest identifier.
5. Minimizers with very many different fragments would make one task grow; the strings of those
   are compared one by one through an ordinary grouped aggregation. So a collection has at most
   COLLECTION strings and those of the minimizer that fills it, CROWD * WINDOWS at most: its columns
   are read as a whole and take 13 bytes a string, its letters some more, under 40 MB together.
6. Each occurrence of a fragment learns which of its strings start in a smaller document, and
   each document removes the bytes that those strings cover.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Staged, partitions, plain_text

LENGTH, K = 50, 20
#: Places of a minimizer in a string, and the bytes that a key has beside it: half of what a string has beside its minimizer.
WIDTH, SIDE = LENGTH - K + 1, (LENGTH - K) // 2
#: Strings of one fragment; longer runs (periodic texts) are cut, which changes no result.
WINDOWS = 32
#: Strings of one collection (more where one minimizer has more), and fragments of one minimizer before its strings are compared one by one.
COLLECTION, CROWD = 250_000, 4_096
#: Texts with copies up to this number are broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000

_T = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte substring, by doubling."""
    power, size, out, have, left = _T[data], 1, None, 0, k
    while True:
        if left & 1:
            n = len(data) - have - size + 1
            out = power[:n] if out is None else _mix(out[:n] * _M + power[have : have + n])
            have += size
        left >>= 1
        if not left:
            return out
        power = _mix(power[:-size] * _M + power[size:])
        size *= 2


def minima(values: np.ndarray, width: int) -> np.ndarray:
    size, now = 1, values
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(now[:n], now[width - size : width - size + n])


def fragments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first string and number of strings of each fragment of a document; its keys, and the first and last string that each stands for."""
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none, none
    h = hashes(np.frombuffer(data, np.uint8), K)
    m = minima(h, WIDTH)
    keyed = _keys(h, m)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(np.append(first, len(m)))
    if count.max() > WINDOWS:
        pieces = -(-count // WINDOWS)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + inner * WINDOWS, np.minimum(np.repeat(count, pieces) - inner * WINDOWS, WINDOWS)
    return m[first], first, count, *keyed


def _keys(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of ``K + SIDE`` bytes around the minimizers: every string has one that lies in it whole, at the same place in equal strings."""
    around = np.concatenate([np.zeros(WIDTH - 1, np.uint64), m, np.zeros(WIDTH - 1, np.uint64)])
    at = np.flatnonzero(~minima(~around, WIDTH) == h)  # a substring is a minimizer where the largest minimum of the strings around it is its own hash
    # in order of place, those of one run of strings follow each other, and neighbouring runs have different minimizers
    turn = np.flatnonzero(np.concatenate([[True], h[at[1:]] != h[at[:-1]]]))
    run = np.repeat(np.arange(len(turn)), np.diff(np.append(turn, len(at))))
    begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    low, high = begin[run], np.append(begin[1:], len(m))[run] - 1
    # a string that has SIDE bytes before the minimizer has the left key whole; any other has SIDE bytes after it
    left_low, left_high = np.maximum(low, at - WIDTH + 1), np.minimum(high, at - SIDE)
    right_low, right_high = np.maximum(low, at - SIDE + 1), np.minimum(high, at)
    left, right = left_low <= left_high, right_low <= right_high
    keys = np.concatenate([_mix(h[at[left] - SIDE] * _M + h[at[left]]), _mix(h[at[right]] * _M + h[at[right] + SIDE])])
    return keys, np.concatenate([left_low[left], right_low[right]]), np.concatenate([left_high[left], right_high[right]])


PACKED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("rows", pa.binary()), ("minimizers", pa.binary())])
#: Keys of minimizers travel as their low five bytes; one taken for another only brings a fragment that is compared in vain.
LOW = np.uint64((1 << 40) - 1)


def _packed(bucket: np.ndarray, rows: np.ndarray, minimizers: np.ndarray, known: bool) -> Iterator[tuple]:
    """Entries by bucket, in order of their rows, which then compress well."""
    if not len(bucket):
        return
    order = np.lexsort((rows, bucket))
    bucket, rows, minimizers = bucket[order], rows[order], minimizers[order]
    low = np.ascontiguousarray(minimizers.view(np.uint8).reshape(-1, 8)[:, :5])
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for lo, hi in zip(starts, [*starts[1:], len(bucket)], strict=True):
        yield int(bucket[lo]), known, rows[lo:hi].tobytes(), low[lo:hi].tobytes()


def _unpacked(held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(x[0] for x in held), np.int64)
    low = np.zeros((len(rows), 8), np.uint8)
    low[:, :5] = np.frombuffer(b"".join(x[1] for x in held), np.uint8).reshape(-1, 5)
    return rows, low.view(np.uint64).ravel()


def _as_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def _collect(buckets: int):
    """Each batch sends a key once: with its row where one row has it (to be settled), without where several do; those rows know already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = batch.column("row").to_numpy(zero_copy_only=False), [np.unique(fragments(t.as_py().encode())[3]) for t in batch.column("body")]
            rows, all_m = np.repeat(keys, list(map(len, own))), np.concatenate([np.empty(0, np.uint64), *own])
            order = np.argsort(all_m, kind="stable")
            rows, all_m = rows[order], all_m[order]
            start = np.flatnonzero(np.concatenate([[True], all_m[1:] != all_m[:-1]])) if len(all_m) else np.empty(0, int)
            size = np.diff(np.append(start, len(all_m)))
            several = np.repeat(size > 1, size)
            lone = rows[start].copy()
            lone[size > 1] = 0
            m = all_m[start]
            found = [*_packed((m >> np.uint64(40)).astype(np.int64) % buckets, lone, m, False)]
            found += _packed(rows[several] % buckets, rows[several], all_m[several], True)
            yield _as_batch(found)

    return run


def _settle(buckets: int):
    """Keys that several batches sent go back to the rows that have them, dealt by row."""

    def settled(held: list[tuple[bytes, bytes]]) -> list[tuple]:
        rows, m = _unpacked(held)
        order = np.argsort(m, kind="stable")
        rows, m = rows[order], m[order]
        same = m[1:] == m[:-1]
        repeated = (np.concatenate([same, [False]]) | np.concatenate([[False], same])) & (rows != 0)
        return [*_packed(rows[repeated] % buckets, rows[repeated], m[repeated], True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for bucket, known, rows, m in zip(*(batch.column(c).to_pylist() for c in PACKED.names), strict=True):
                if known:
                    out.append((bucket, True, rows, m))
                    continue
                if bucket != at and held:
                    out += settled(held)
                    held = []
                at = bucket
                held.append((rows, m))
            yield _as_batch(out)
        if held:
            yield _as_batch(settled(held))

    return run


#: A fragment's name: hashes of its first and last string, which cover it, and its number of strings.
NAME = ("ha", "hb", "n")
CUT = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("n", pa.int32()), ("minimizer", pa.int64()), ("fragment", pa.binary()), ("rank", pa.int64()), ("row", pa.int64()), ("first", pa.int32())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of each document with keys that other documents have; a bucket's known keys come before its documents."""
    at, held, rows, minimizers = None, [], None, None
    for batch in batches:
        out: list[tuple] = []
        for bucket, row, rank, body, known, m in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "rank", "body", "rows", "minimizers")), strict=True):
            if bucket != at:
                at, held, rows = bucket, [], None
            if known is not None:
                held.append((known, m))
                continue
            if rows is None:
                rows, minimizers = _unpacked(held)
                order = np.argsort(rows, kind="stable")
                rows, minimizers = rows[order], minimizers[order]
            lo, hi = np.searchsorted(rows, [row, row + 1])
            if lo == hi:
                continue
            data = body.encode()
            own, first, count, keys, low, high = fragments(data)
            told = np.isin(keys & LOW, minimizers[lo:hi])
            edge = np.zeros(first[-1] + count[-1] + 1, np.int32)
            np.add.at(edge, low[told], 1)
            np.add.at(edge, high[told] + 1, -1)
            shared = np.logical_or.reduceat(np.cumsum(edge[:-1]) > 0, first)
            own, first, count = own[shared], first[shared], count[shared]
            if not len(own):
                continue
            letters = np.frombuffer(data, np.uint8)
            strings = np.lib.stride_tricks.sliding_window_view(letters, LENGTH)
            size = count + LENGTH - 1
            ends = np.cumsum(size)
            picked = letters[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]
            out.append((_named(strings[first]), _named(strings[first + count - 1]), count, own.view(np.int64), size, picked, np.full(len(first), rank), np.full(len(first), row), first))
        if not out:
            continue
        ha, hb, n, minimizer, size, picked, rank, row, first = (np.concatenate([x[i] for x in out]) for i in range(9))
        order = np.lexsort((rank, n, hb, ha))
        fresh = np.zeros(len(ha), bool)
        fresh[order] = np.concatenate([[True], (np.diff(ha[order]) != 0) | (np.diff(hb[order]) != 0) | (np.diff(n[order]) != 0)])
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())])
        pieces = pc.if_else(pa.array(fresh), pieces, pa.scalar(None, pa.binary()))  # once a batch, with its smallest identifier
        yield pa.RecordBatch.from_arrays([pa.array(ha), pa.array(hb), pa.array(n.astype(np.int32)), pa.array(minimizer), pieces, pa.array(rank), pa.array(row), pa.array(first.astype(np.int32))], schema=CUT)


_POWERS = np.random.default_rng(51).integers(0, 1 << 63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _named(strings: np.ndarray) -> np.ndarray:
    return _mix((_T[strings] * _POWERS).sum(1, dtype=np.uint64)).view(np.int64)


class Column:
    """An array in a file of its own that is read and written from front to back; the file goes with the process."""

    def __init__(self, values: np.ndarray):
        self.file, self.dtype = tempfile.TemporaryFile(), values.dtype
        self.write(values)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        values.tofile(self.file)
        self.file.flush()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype)


def equal_strings(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, class) of every string of ``LENGTH`` bytes of some texts, by text and place; equal strings, and no others, share a class.

    ``letters`` has the texts one after the other, ``sizes`` the numbers of their strings.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.arange(sizes.sum()) + owner * (LENGTH - 1)
    count = len(owner)
    order, bwt, common = Column(np.arange(count, dtype=np.int32)), Column(letters[begin + LENGTH - 1]), Column(np.ones(count, np.uint8))
    for j in range(1, LENGTH + 1):
        # the BWT column has, in the order of the suffixes of length j - 1, the symbol before each: sorted stably, it orders those of length j
        symbols, names, alike = bwt.read(), order.read(), common.read()
        turn = np.argsort(symbols, kind="stable")
        names, symbols = names[turn], symbols[turn]
        kind = np.cumsum(alike == 0, dtype=np.int32)[turn]
        shared = np.empty(count, np.uint8)
        shared[:1] = 0
        shared[1:] = (kind[1:] == kind[:-1]) & (symbols[1:] == symbols[:-1])
        order.write(names)
        common.write(shared)
        if j < LENGTH:
            bwt.write(letters[begin[names] + LENGTH - 1 - j])
    names, out = order.read(), np.empty(count, np.int64)
    out[names] = np.cumsum(common.read() == 0)
    return owner, out


ANSWER = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("n", pa.int32()), ("least", pa.int64()), ("smallest", pa.list_(pa.int64())), ("fragment", pa.binary())])


def _answers(names: list[np.ndarray], least: np.ndarray, smallest: pa.Array | None = None, fragment: pa.Array | None = None) -> pa.RecordBatch:
    none = [pa.nulls(len(least), f.type) for f in (ANSWER.field("smallest"), ANSWER.field("fragment"))]
    arrays = [*(pa.array(x, f.type) for x, f in zip(names, ANSWER, strict=False)), pa.array(least, pa.int64()), smallest if smallest is not None else none[0], fragment if fragment is not None else none[1]]
    return pa.RecordBatch.from_arrays(arrays, schema=ANSWER)


def _smallest(crowd_size: int):
    """For each fragment its smallest identifier and, where others share its minimizer, that of each of its strings.

    Rows come ordered by minimizer, name and identifier. They are taken in hand when a
    collection is full, up to the last minimizer, which may go on. Fragments of crowded
    minimizers are given back with their bytes instead.
    """

    def solved(table: pa.Table, crowded: int | None) -> Iterator[pa.RecordBatch]:
        """``crowded``: a minimizer whose earlier fragments were given back already."""
        columns = [table.column(c).to_numpy() for c in ("minimizer", *NAME, "rank")]
        fresh = np.zeros(len(columns[0]), bool)
        fresh[:1] = True
        for c in columns[:4]:
            fresh[1:] |= c[1:] != c[:-1]  # the same fragment from another batch has a larger identifier
        m, ha, hb, n, least = (c[fresh] for c in columns)
        fragments_ = table.column("fragment").combine_chunks().filter(pa.array(fresh))
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        size = np.diff(np.append(start, len(m)))
        size = np.repeat(np.where(m[start] == crowded, crowd_size + 1, size) if crowded is not None else size, size)
        alone, crowd = size == 1, size > crowd_size
        if alone.any():
            yield _answers([ha[alone], hb[alone], n[alone]], least[alone])
        if crowd.any():
            yield _answers([ha[crowd], hb[crowd], n[crowd]], least[crowd], fragment=fragments_.filter(pa.array(crowd)))
        several = ~alone & ~crowd
        if several.any():
            letters = np.frombuffer(b"".join(fragments_.filter(pa.array(several)).to_pylist()), np.uint8)
            count = n[several].astype(np.int64)
            owner, kind = equal_strings(letters, count)
            low = np.full(kind.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, kind, least[several][owner])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(low[kind]))
            yield _answers([ha[several], hb[several], n[several]], least[several], smallest=lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, crowded = 0, None
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows * 16 < COLLECTION and rows <= crowd_size:
                continue
            table = pa.Table.from_batches(held)
            m = table.column("minimizer").to_numpy()
            cut = int(np.searchsorted(m, m[-1]))  # where the last minimizer begins
            if cut == 0 and rows > crowd_size * 2 or crowded is not None and m[-1] == crowded:
                crowded, cut = int(m[-1]), rows  # one minimizer fills all: it is crowded, now and in what follows
            if cut:
                yield from solved(table.slice(0, cut), crowded)
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from solved(pa.Table.from_batches(held), crowded)

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remaining(data: bytes, starts: np.ndarray) -> tuple[bytes, int, int]:
    """What is left without the strings that begin at ``starts``, the bytes removed and their maximal runs."""
    if not len(starts):
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, body, copy, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "copy", "hits")), strict=True):
            data = body.encode()
            if copy:  # every string of it starts in the first document with this text
                out.append((doc_id, len(data), len(data), 1, hashlib.sha256(b"").hexdigest()))
                continue
            starts = [h["first"] + k for h in hits or () for k in range(WINDOWS) if h["mask"] >> k & 1]
            kept, removed, runs = remaining(data, np.unique(np.array(starts, np.int64)))
            out.append((doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(KEPT), KEPT, strict=True)], schema=KEPT)


def _fragments(rows: DataFrame, stage: Staged) -> DataFrame:
    n_parts = partitions(rows.sparkSession)
    packed = "bucket int, known boolean, rows binary, minimizers binary"
    sent = rows.select("row", "body").mapInArrow(_collect(n_parts), packed)
    known = stage.write(sent.repartition(n_parts, "bucket", "known").sortWithinPartitions("bucket", "known").mapInArrow(_settle(n_parts), packed))
    none = F.lit(None)
    told = known.select("bucket", F.lit(-1).cast("long").alias("row"), none.cast("long").alias("rank"), none.cast("string").alias("body"), "rows", "minimizers")
    docs = rows.select(F.pmod("row", F.lit(n_parts)).cast("int").alias("bucket"), "row", "rank", "body", none.cast("binary").alias("rows"), none.cast("binary").alias("minimizers"))
    both = told.unionByName(docs).repartition(n_parts, "bucket").sortWithinPartitions("bucket", "row")
    cut = stage.write(both.mapInArrow(_cut, "ha long, hb long, n int, minimizer long, fragment binary, rank long, row long, first int"))
    stage.drop(known)
    return cut


def _marked(rows: DataFrame, stage: Staged) -> DataFrame:
    """Rows with ``copy``: whether a smaller document has the same text of ``LENGTH`` bytes or more."""
    keyed = rows.withColumn("ka", F.xxhash64("body")).withColumn("kb", F.hash("body", F.octet_length("body")))
    several = keyed.filter(F.octet_length("body") >= LENGTH).groupBy("ka", "kb").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("ka", "kb", "least")
    several = stage.write(several)
    few = several.count() <= BROADCAST_TEXTS
    return keyed.join(F.broadcast(several) if few else several, ["ka", "kb"], "left").withColumn("copy", F.coalesce(F.col("least") < F.col("rank"), F.lit(False))).drop("ka", "kb", "least")


def repeated_passages(docs: DataFrame, crowd_size: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed where a string of 50 bytes that covers it also starts in a document with
    a smaller doc_id; strings are judged on the input. A null text is empty. A null doc_id is
    smaller than any other; rows that share a doc_id remove nothing from each other. Texts
    under 50 bytes stay whole. No rows in, no rows out; further columns are ignored.
    """
    spark = docs.sparkSession
    n_parts, stage = partitions(spark), Staged(spark, "suffix-dedup")
    doc_id, body = F.col("doc_id").cast("long"), plain_text(F.col("text"))
    rows = docs.select(doc_id.alias("doc_id"), body.alias("body")).withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # names a row by its identifier and text, positive and below 2^62
    rows = rows.withColumn("row", F.shiftrightunsigned(F.xxhash64("doc_id", "body"), 2)).withColumn("row", F.greatest("row", F.lit(1)))
    rows = _marked(rows, stage)
    cut = _fragments(rows.filter(~F.col("copy") & (F.octet_length("body") >= LENGTH)), stage)

    name = list(NAME)
    dealt = cut.filter("fragment is not null").select("minimizer", *name, "rank", "fragment").repartition(n_parts, "minimizer").sortWithinPartitions("minimizer", *name, "rank")
    every = answers = stage.write(dealt.mapInArrow(_smallest(crowd_size), "ha long, hb long, n int, least long, smallest array<long>, fragment binary"))

    crowded = every.filter("fragment is not null")
    if crowded.take(1):
        crowded = crowded.groupBy(*name).agg(F.min("least").alias("least"), F.first("fragment").alias("fragment"))  # a name can come back from two slices
        strings = crowded.select(*name, "least", "fragment", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        strings = strings.select(*name, "k", "least", F.substring("fragment", F.col("k") + 1, F.lit(LENGTH)).alias("string"))
        low = strings.groupBy("string").agg(F.min("least").alias("low"))
        alone = strings.join(low, "string").groupBy(*name).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "low"))), lambda x: x["low"]).alias("smallest"), F.min("least").alias("least"))
        every = every.filter("fragment is null").select(*name, "least", "smallest").unionByName(alone.select(*name, "least", "smallest"))
    seen = cut.select(*name, "rank", "row", "first").join(every.select(*name, "least", "smallest"), name)
    # bit k: string k of the fragment starts in a smaller document
    whole = F.expr("if(least < rank, shiftleft(1L, n) - 1, 0L)")
    each = F.expr("aggregate(sequence(0, n - 1), 0L, (acc, k) -> acc | if(get(smallest, k) < rank, shiftleft(1L, k), 0L))")
    # written before the documents are dealt once more, so that fragments and texts are never on disk together
    found = stage.write(seen.select("row", "first", F.when(F.col("smallest").isNull(), whole).otherwise(each).alias("mask")).filter("mask <> 0"))
    stage.drop(cut, answers)
    hits = found.groupBy("row").agg(F.collect_set(F.struct("first", "mask")).alias("hits"))
    return rows.select("doc_id", "row", "body", "copy").join(hits, "row", "left").select("doc_id", "body", "copy", "hits").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""Near duplicates by MinHash with sequential Bayesian verification.

1. Every text becomes a set of word shingles; texts with equal sets form one class, and classes
   are compared through one representative, the smallest identifier.
2. Signatures of a class are cut into bands; classes with an equal band meet in a bucket. Each
   bucket pairs its members with its hub, the one that meets most others in all its buckets, so
   a bucket gives as many pairs as rows.
3. Pairs are verified in batches of hashes: the posterior of the similarity under a uniform
   prior after m of n agreements is Beta(m + 1, n - m + 1), and a pair is dropped as soon as
   the similarity is above the bound with less than the chosen miss probability.
4. Survivors are compared on their full sets.
5. Where the members of a bucket are still in several components, those outside its largest one
   are compared with all by signature, and the ones with a likely partner in another component
   again on their full sets. Both go in pairs of blocks of bounded size and return members and
   joining links, not pairs; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import LOWER, UPPER, Staged, lean, partitions, plain_text
from citeloom.llm.components import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Members of a bucket in a block, two of which are compared in one group: by signature, by full set.
BLOCK, FULL_BLOCK = 4096, 128
#: Up to so many identifiers are broadcast; more are joined by shuffle.
BROADCAST_IDS = 300_000
#: Members from which on a bucket can be hot.
LEAST_HOT = 256

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_rng = np.random.default_rng(2024)
_A = _rng.integers(1, 1 << 62, HASHES, dtype=np.uint64) * 2 + 1
_B = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)


class Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; one for all words where they are fewer; none without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest value of each hash function."""
    out = np.empty(HASHES, np.uint16)
    for lo in range(0, HASHES, 16):
        with np.errstate(over="ignore"):
            mixed = hashes[None, :] * _A[lo : lo + 16, None] + _B[lo : lo + 16, None]
        low = mixed.min(1)
        out[lo : lo + 16] = ((low ^ low >> np.uint64(23)) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(bound: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n hashes a pair needs m agreements, else P(similarity >= bound) is below ``miss``."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * bound**m * (1 - bound) ** (n + 1 - m)
        out.append((n, m))
    return out


def _sets(width: int):
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            n, keys, sigs = [], [], []
            for text in batch.column("body"):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _set_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column("body")], pa.binary())], names=["rep", "members"])

    return run


def _likely(bound: float):
    needed = least_matches(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive = np.arange(len(x))
            same = np.zeros(len(x), np.int64)
            for n, m in needed:
                same[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(1)
                alive = alive[same[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, from products of their incidence matrices, some thousand elements at a time."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for lo in range(0, len(shared), 4096):
        x, y = (np.zeros((len(sets), 4096), np.float32) for sets in (left, right))
        for m, (at, owner) in zip((x, y), places, strict=True):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m[owner[a:b], at[a:b] - lo] = 1
        out += x @ y.T
    return out


def _block_links(percent: int):
    """Links between members of two blocks of a bucket, as many as join their components."""

    def group(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = ([r for r in rows if r[3] == side] for side in (0, 1))
        if not left or not right or len({r[5] for r in rows}) < 2:
            return []
        x, y = ([np.frombuffer(r[6], np.uint64) for r in side] for side in (left, right))
        common = common_counts(x, y)
        union = np.array(list(map(len, x)))[:, None] + np.array(list(map(len, y)))[None, :] - common
        cx, cy = (np.array([r[5] for r in side]) for side in (left, right))
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        out = []
        for a, b in np.argwhere((100 * common >= percent * union) & (cx[:, None] != cy[None, :])).tolist():
            u, v = top(left[a][5]), top(right[b][5])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((min(left[a][4], right[b][4]), max(left[a][4], right[b][4])))
        return out

    return _by_group(group, ("members",), ("a", "b"))


def _open_members(bound: float):
    """Members (bucket, rep, c) with a likely partner in another component, in one pair of blocks."""
    _, least = least_matches(bound)[-1]

    def group(rows: list[tuple]) -> list[tuple[int, int, int]]:
        sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, HASHES)
        c, side = np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
        right = np.flatnonzero(side == 1)
        others, names = sig[right], c[right]
        found = np.zeros(len(rows), bool)
        for k in np.flatnonzero(side == 0):
            hits = (names != c[k]) & ((others == sig[k]).sum(1) >= least)
            if hits.any():
                found[right[hits]] = True
                found[k] = True
        return [(rows[k][0], rows[k][4], rows[k][5]) for k in np.flatnonzero(found)]

    return _by_group(group, ("sig",), ("bucket", "rep", "c"))


def _by_group(group, payload: tuple[str, ...], out_names: tuple[str, ...]):
    """mapInArrow function over rows ordered by (bucket, i, j): ``group`` of each run of rows."""
    columns = ("bucket", "i", "j", "side", "rep", "c", *payload)

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(out_names))], names=list(out_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in lean(batches):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += group(held)
                    held = []
                held.append(row)
            yield made(out)
        if held:
            yield made(group(held))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are the runs of other characters than space and \\t to \\r, after lower-casing A-Z.
    Documents are linked where 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id that links reach, and its row is kept. A text without
    words (or null) is linked with nothing. Rows that share a doc_id are one node of the graph.
    A null doc_id is never a representative: such a row takes the component of its equal texts
    and is not kept, and without any it has none and is kept. No rows in, no rows out.
    """
    spark, bound = docs.sparkSession, percent / 100
    n_parts, stage = partitions(spark), Staged(spark, "near-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text(F.col("text")).alias("body"))
    sets = stage.write(rows.mapInArrow(_sets(width), "doc_id long, n_shingles long, set_key binary, sig binary"))
    classes = stage.write(sets.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    reps = classes.filter("rep is not null").groupBy("rep").agg(F.min("sig").alias("sig"))  # rows of one identifier with several texts

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr(F.col("sig"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    members = classes.filter("rep is not null").select("rep", F.explode(bands).alias("bucket"))
    buckets = stage.write(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("bucket", "n"))
    # at most 4 * n_parts buckets can have more than that share of all members
    often = max(LEAST_HOT, BANDS * classes.count() // (4 * n_parts))
    hot = stage.write(buckets.filter(F.col("n") > often).select("bucket"))

    def with_bucket(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
        """Rows with what a table of one row for each bucket says; rows of hot buckets stay where they are."""
        cold = rows.join(F.broadcast(hot), "bucket", "left_anti").join(per_bucket, "bucket")
        return cold.unionByName(rows.join(F.broadcast(per_bucket.join(F.broadcast(hot), "bucket", "left_semi")), "bucket"))

    met = stage.write(with_bucket(members, buckets).select("bucket", "rep", "n"))
    meets = met.groupBy("rep").agg(F.sum("n").alias("meets"))
    hubs = met.join(meets, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("hub"))
    star = with_bucket(met, hubs).filter("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()

    def sets_of(asked: DataFrame) -> DataFrame:
        """(rep, members): the full sets of some classes, from the texts of their representatives."""
        few = asked.count() <= BROADCAST_IDS
        texts = rows.select(F.col("doc_id").alias("rep"), "body").join(F.broadcast(asked) if few else asked, "rep", "left_semi")
        return stage.write(texts.mapInArrow(_set_bytes(width), "rep long, members binary"))

    both = star.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    likely = stage.write(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(bound), "a long, b long"))
    full = sets_of(likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct())
    both = likely.join(full.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a").join(full.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
    links = stage.write(both.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long").distinct())
    stage.drop(full)
    labels = components(links, stage)

    open_ = met.filter("n > 2").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))

    def weighed(rows: DataFrame) -> DataFrame:
        """(bucket, rep, c, m, minor, few): of buckets in several components, members, their number, whether outside the largest component, and how many are."""
        parts = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("size"))
        sizes = parts.groupBy("bucket").agg(F.sum("size").alias("m"), F.max("size").alias("most"), F.max_by("c", F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        return with_bucket(rows, sizes).select("bucket", "rep", "c", "m", (F.col("c") != F.col("main")).alias("minor"), (F.col("m") - F.col("most")).alias("few"))

    def in_blocks(rows: DataFrame, block: int) -> DataFrame:
        """Members outside the largest component (side 0) with every block of all members (side 1), cut into blocks themselves."""
        own = F.xxhash64("rep")
        i_blocks, j_blocks = F.ceil(F.col("few") / block), F.ceil(F.col("m") / block)
        i, j = F.pmod(own, i_blocks).cast("int"), F.pmod(own, j_blocks).cast("int")

        def every(count):
            return F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))

        zero, minor = F.lit(0), rows.filter("minor")
        left = minor.filter(F.col("m") <= block).select("bucket", i.alias("i"), zero.alias("j"), zero.alias("side"), "rep", "c")
        left = left.unionByName(minor.filter(F.col("m") > block).select("bucket", i.alias("i"), every(j_blocks).alias("j"), zero.alias("side"), "rep", "c"))
        right = rows.filter(F.col("few") <= block).select("bucket", zero.alias("i"), j.alias("j"), F.lit(1).alias("side"), "rep", "c")
        right = right.unionByName(rows.filter(F.col("few") > block).select("bucket", every(i_blocks).alias("i"), j.alias("j"), F.lit(1).alias("side"), "rep", "c"))
        return left.unionByName(right)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "rep")

    rest = stage.write(weighed(open_.select("bucket", "rep", "c")))
    near = dealt(in_blocks(rest, BLOCK).join(reps, "rep")).select("bucket", "i", "j", "side", "rep", "c", "sig").mapInArrow(_open_members(bound), "bucket long, rep long, c long")
    near = stage.write(near.distinct())
    full = sets_of(near.select("rep").distinct())
    pairs = dealt(in_blocks(weighed(near), FULL_BLOCK).join(full, "rep"))
    more = stage.write(pairs.select("bucket", "i", "j", "side", "rep", "c", "members").mapInArrow(_block_links(percent), "a long, b long").distinct())
    stage.drop(full)
    if more.take(1):
        labels = components(links.unionByName(more), stage)

    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("set_key", F.coalesce("c", "rep").alias("c"))
    out = sets.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))

"""Citation graph measures: edges, degrees, matrices, PageRank, components, ego networks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.work import Kept, dealt

#: Edges that one task can label by itself (16 bytes each).
ONE_TASK = 2_000_000


def collapsed(edges: DataFrame) -> DataFrame:
    """(src, tgt, weight): occurrences of each pair."""
    return edges.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_occurrences, out_occurrences): distinct neighbours and edges, all nodes."""
    pairs = collapsed(edges)
    into = pairs.groupBy(F.col("tgt").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum("weight").alias("in_occurrences"))
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("out_occurrences"))
    return into.join(out, "node", "full_outer").na.fill(0).select("node", "in_degree", "out_degree", "in_occurrences", "out_occurrences")


def matrix(edges: DataFrame, nodes: DataFrame, group: str, tasks: int | None = None) -> DataFrame:
    """Occurrences between the groups of both ends: (src_group, tgt_group, count).

    ``tasks``: into how many tasks the joins are dealt (the session's number where it is not given).
    Edges of one source group meet their target once for each target, with their number.
    """
    a = nodes.select(F.col("node").alias("src"), F.col(group).alias("src_group"))
    b = nodes.select(F.col("node").alias("tgt"), F.col(group).alias("tgt_group"))
    into = dealt(edges, "src", tasks).join(dealt(a, "src", tasks), "src").groupBy("tgt", "src_group").agg(F.count(F.lit(1)).alias("n"))
    return dealt(into, "tgt", tasks).join(dealt(b, "tgt", tasks), "tgt").groupBy("src_group", "tgt_group").agg(F.sum("n").alias("count"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tolerance: float | None = 1e-8, tasks: int | None = None) -> DataFrame:
    """(node, rank): weighted PageRank; self-loops do not count, ranks of sinks are dealt evenly, ranks add up to 1.

    Stops after ``rounds`` or when the ranks move less than ``tolerance`` in sum. Only sums
    reach the driver; each round is kept in the checkpoint folder. ``tasks``: into how many tasks
    the joins are dealt (the session's number where it is not given).
    """
    kept = Kept(edges.sparkSession)
    nodes = kept.write(edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    files = max(1, n // ROWS_A_FILE)
    pairs = collapsed(dealt(edges.filter("src <> tgt"), "src", tasks))
    shares = kept.write(pairs.join(pairs.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "tgt", (F.col("weight") / F.col("total")).alias("share")))
    sources = shares.select(F.col("src").alias("node")).distinct().withColumn("flows", F.lit(True))
    ranks = kept.write(nodes.join(sources, "node", "left").select("node", F.lit(1.0 / n).alias("rank"), F.coalesce("flows", F.lit(False)).alias("flows")), files)
    total = {"lost": F.coalesce(F.sum(F.when(~F.col("flows"), F.col("rank"))), F.lit(0.0)), "moved": F.lit(0.0), "all": F.sum("rank")}
    state = ranks.agg(*[c.alias(k) for k, c in total.items()]).first()
    total["moved"] = F.sum(F.abs(F.col("rank") - F.col("old")))
    for _ in range(rounds):
        flow = dealt(shares, "src", tasks).join(dealt(ranks.select(F.col("node").alias("src"), "rank"), "src", tasks), "src").groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(flow, "node", "left").select("node", F.col("rank").alias("old"), (F.lit((1 - alpha) / n + alpha * state["lost"] / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), "flows")
        old, ranks = ranks, kept.write(new, files)
        state = ranks.agg(*[c.alias(k) for k, c in total.items()]).first()
        kept.drop(old)
        if tolerance is not None and state["moved"] < tolerance:
            break
    return ranks.select("node", (F.col("rank") / state["all"]).alias("rank"))


#: Rows of a file of a small table in a loop.
ROWS_A_FILE = 50_000


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) of all ends of the edges (v, u) of one task: the smallest end each reaches."""
    ends = [np.empty((0, 2), np.int64)] + [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("v", "u")], 1) for b in batches]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    at, label = at.reshape(-1, 2), np.arange(len(nodes))
    while True:
        low = label.copy()
        smaller = np.minimum(label[at[:, 0]], label[at[:, 1]])
        for side in (0, 1):
            np.minimum.at(low, at[:, side], smaller)
            np.minimum.at(low, label[at[:, side]], smaller)
        low = low[low]
        if (low == label).all():
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["v", "c"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable without regard to direction; nodes without edges stand alone. Nodes are integers.

    Each round every node goes to the first of itself and its neighbours in an order that a hash
    deals anew, and edges go along, so a fixed share of the nodes is expected to go, in chains and
    stars alike. When the edges left fit one task, it labels them, and the labels are handed back
    round by round.
    """
    kept = Kept(edges.sparkSession)
    v, u = F.col("src").cast("long"), F.col("tgt").cast("long")
    now = kept.write(edges.select(F.least(v, u).alias("v"), F.greatest(v, u).alias("u")).filter("v <> u").distinct())
    moves: list[DataFrame] = []
    while now.count() > ONE_TASK:
        ends = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        order = F.struct(F.xxhash64("u", F.lit(len(moves))), "u")
        move = kept.write(ends.unionByName(ends.select("v", F.col("v").alias("u"))).groupBy("v").agg(F.min_by("u", order).alias("c")))
        a, b = move.select("v", F.col("c").alias("a")), move.select(F.col("v").alias("u"), F.col("c").alias("b"))
        new = kept.write(now.join(a, "v").join(b, "u").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("v <> u").distinct())
        kept.drop(now)
        now = new
        moves.append(move)
    labels = now.repartition(1).mapInArrow(_labelled, "v long, c long")
    for move in reversed(moves):
        labels = kept.write(move.join(labels.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c")))
    if moves:  # the node that stands for a component is its first by the hashes, not the smallest
        smallest = labels.groupBy("c").agg(F.min("v").alias("least"))
        labels = labels.join(smallest, "c").select("v", F.col("least").alias("c"))
    kind = dict(nodes.dtypes)["node"]
    named = nodes.select("node").distinct().join(labels.withColumnRenamed("v", "node"), "node", "left")
    return named.select("node", F.coalesce("c", "node").cast(kind).alias("component"))


def ego(edges: DataFrame, sources: int = 10, targets: int = 4) -> DataFrame:
    """(side, node, weight) around the node with most different citing nodes: its heaviest neighbours in and out (a top-k report)."""
    pairs = collapsed(edges)
    hub = pairs.groupBy(F.col("tgt").alias("hub")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hub").limit(1)
    into = pairs.join(F.broadcast(hub), F.col("tgt") == F.col("hub")).select(F.lit("in").alias("side"), F.col("src").alias("node"), "weight").orderBy(F.desc("weight"), "node").limit(sources)
    out = pairs.join(F.broadcast(hub), F.col("src") == F.col("hub")).select(F.lit("out").alias("side"), F.col("tgt").alias("node"), "weight").orderBy(F.desc("weight"), "node").limit(targets)
    return into.unionByName(out)


def edges_of(spark: SparkSession, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Edge table: links (source_document, target_document, target_scope) with the dates of both ends and a flag for proceedings."""
    a = documents.select(F.col("document_id").alias("source_document"), F.col("date").alias("source_date"))
    b = documents.select(F.col("document_id").alias("target_document"), F.col("date").alias("target_date"))
    return links.join(a, "source_document", "left").join(b, "target_document", "left").withColumn("is_same_proceeding", F.col("target_scope") == "same_proceeding")



def scope_summary(links: DataFrame, source: str) -> DataFrame:
    """(scope, total, citing, cited) of links that touch a source: all, those from it and those to it, by scope."""
    citing, cited = F.col("source_source") == source, F.col("target_source") == source
    return links.filter(citing | cited).groupBy(F.col("target_scope").alias("scope")).agg(F.count(F.lit(1)).alias("total"), F.count_if(citing).alias("citing"), F.count_if(cited).alias("cited"))

"""Evaluation reports: citations, references and links against gold, each as a one-row or small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.evaluation import outcomes, rates


def anchor_report(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of rows matched one to one by their keys."""
    counts = outcomes(gold, predicted, keys).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN")])
    return counts.select("*", *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def attribute_report(gold: DataFrame, predicted: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """(attribute, compared, equal, share): attributes of matched rows, over those whose gold value is there."""
    both = gold.select(*keys, *[F.col(a).alias(f"g_{a}") for a in attributes]).join(predicted.select(*keys, *[F.col(a).alias(f"p_{a}") for a in attributes]), keys)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"g_{a}").isNotNull().alias("there"), F.col(f"g_{a}").eqNullSafe(F.col(f"p_{a}")).alias("same")) for a in attributes]))
    rows = both.select(each.alias("x")).select("x.*").filter("there")
    counts = rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("compared"), F.count_if("same").alias("equal"))
    return counts.withColumn("share", F.try_divide(F.col("equal"), F.col("compared")))


def link_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Links (document, start, target) over the occurrences that gold has: counts, precision, recall, f1, wrong and missing occurrences."""
    g = gold.groupBy("document", "start").agg(F.array_sort(F.collect_set("target")).alias("g"))
    p = predicted.groupBy("document", "start").agg(F.array_sort(F.collect_set("target")).alias("p"))
    both = g.join(p, ["document", "start"], "left")
    empty = F.array().cast(dict(both.dtypes)["g"])
    right = F.size(F.array_intersect("g", F.coalesce("p", empty)))
    one = both.agg(
        F.sum(F.size("g")).alias("gold"), F.sum(F.size(F.coalesce("p", empty))).alias("predicted"), F.sum(right).alias("tp"), F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("p").isNotNull() & (F.col("p") != F.col("g"))).alias("wrong"),
    )
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("gold") - F.col("tp")
    return one.select("*", *[c.alias(n) for n, c in rates(tp, fp, fn).items()])


def routed(before: DataFrame, after: DataFrame, keys: DataFrame, key: str, right: str) -> DataFrame:
    """Accuracy before and after on the routed keys only."""
    a = before.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("before"))
    b = after.join(keys, key, "left_semi").agg(F.count_if(right).alias("after"))
    return a.crossJoin(b)  # one row each

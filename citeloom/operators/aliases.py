"""Alias dictionaries as tables (alias, law_ids, match_mode): voting, titles, derived names, layers, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.work import spread


def majority_vote(rows: DataFrame, least: int = 2, share: float = 0.85) -> DataFrame:
    """(alias, law_id, votes, total, layer) from (alias, law_id, document): one vote a document.

    The law with most votes, the one seen first on a tie, is global where its share is above
    ``share`` and else in conflict; aliases with fewer than ``least`` votes are left out.
    """
    votes = rows.groupBy("alias", "law_id").agg(F.count_distinct("document").alias("votes"), F.min("document").alias("first_seen"))
    whole = votes.groupBy("alias").agg(F.sum("votes").alias("total"), F.max_by(F.struct("law_id", "votes"), F.struct("votes", -F.col("first_seen"))).alias("best"))
    layer = F.when(F.col("best.votes") / F.col("total") > share, "global").otherwise("conflict")
    return whole.filter(F.col("total") >= least).select("alias", "best.law_id", "best.votes", "total", layer.alias("layer"))


# --- names harvested from titles ---

# Beginnings of titles of base laws and of others, what a name must or must not have, and shortcuts of titles.
BASE_TITLES = ("zákon o ", "vyhláška o ", "nařízení o ", "úmluva o ", "občanský soudní řád", "trestní zákon", "trestní řád", "občanský zákoník", "obchodní zákoník")
OTHER_TITLES = (
    "zákon, kterým se", "vyhláška, kterou se", "nařízení, kterým se", "sdělení ", "oznámení ", "redakční sdělení", "nález ", "usnesení ",
    "úplné znění", "vyhláška o počátku platnosti", "vyhláška o publikaci", "oprava ",
)
LOWERED_HEADS = ("Zákon o ", "Vyhláška o ", "Nařízení o ", "Úmluva o ")
BAD_PHRASES = ("ve znění", "pozdějších předpisů", "úplné znění", "jak vyplývá", "přijatému parlamentem", "vrácenému prezidentem")
BAD_WORDS = ("nález", "usnesení")
KEYWORDS = ("zákon", "řád", "zákoník", "pravidla", "tarif", "listina", "ústava", "rozhodč")
SHORTCUTS = (
    (r"^(?:zákoník práce|zákon zákoník práce)$", ("zák. práce",)),
    (r"^zákon o pobytu cizinců na území", ("cizinecký zákon", "cizineckého zákona")),
    (r"^(?:zákon o|zákon české národní rady o) ochraně zemědělského půdního fondu$", ("zákon o ochraně ZPF",)),
    (r"posuzování pracovní schopnosti pro účely invalidity", ("vyhláška o posuzování invalidity",)),
)
LENGTHS, MOST_LAWS = (4, 120), 4
LAW_NUMBER, BRACKETS = r"(?i)\d{1,4}/(?:\d{2}|\d{4})\s*Sb\.", r"\(([^()]{2,120})\)"


def _any(text: Column, test, values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (test(text, v) for v in values))


def _plain_name(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"(?U)^[.,;:\s]+|[.,;:\s]+$", ""), "^[ \"„“]+|[ \"„“]+$", "")
    lower = F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.when(_any(bare, lambda t, v: t.startswith(v), LOWERED_HEADS), lower).otherwise(bare)


def _usable(name: Column) -> Column:
    """Says of a harvested name whether it can name a law."""
    low, (least, most) = F.lower(name), LENGTHS
    bad = _any(low, lambda t, v: F.contains(t, F.lit(v)), BAD_PHRASES) | low.rlike("(?<![A-Za-zÁ-ž])(?:" + "|".join(BAD_WORDS) + ")(?![A-Za-zÁ-ž])") | low.rlike(r"(?U)\bč\.\b|\bč\.\s*\d|sb\.")
    commas = F.length(name) - F.length(F.replace(name, F.lit(","), F.lit("")))
    capitals = (F.upper(name) == name) & (F.lower(name) != name) & F.length(name).between(2, 8)
    return F.length(name).between(least, most) & ~bad & (commas <= 1) & (_any(low, lambda t, v: F.contains(t, F.lit(v)), KEYWORDS) | capitals)


def harvest_titles(titles: DataFrame, most: int = MOST_LAWS) -> DataFrame:
    """(alias, law_ids, match_mode) from titles (law_id, title) of laws.

    A base law's title and the name in its last brackets are the law's own; a name in brackets
    is that of the law number before it, too. Some titles have shortcuts, which inflect. Names of more
    than ``most`` laws say nothing and go.
    """
    title = F.regexp_replace(F.trim("title"), r"^[. ]+|[. ]+$", "")
    rows = spread(titles.select("law_id", "title")).select("law_id", title.alias("title"), F.lower(title).alias("low"))
    base = ~_any(F.trim("low"), lambda t, v: t.startswith(v), OTHER_TITLES) & _any(F.trim("low"), lambda t, v: t.startswith(v), BASE_TITLES)
    held, between = F.regexp_extract_all("title", F.lit(BRACKETS), F.lit(1)), F.split("title", BRACKETS, -1)
    rows = rows.withColumn("base", base).withColumn("between", between).withColumn("held", held)
    rows = rows.withColumn("own", _plain_name(F.col("title"))).withColumn("names", F.transform("held", _plain_name))
    rows = rows.withColumn("usable", F.transform("names", _usable)).withColumn("base", F.col("base") & (_usable(F.col("own")) | (F.size("held") > 0)))

    def before(i: Column) -> Column:
        """The title up to its i-th brackets."""
        pieces = F.transform(F.slice("between", F.lit(1), i + 1), lambda p, j: F.concat(p, F.when(j < i, F.concat(F.lit("("), F.get("held", j), F.lit(")"))).otherwise("")))
        return F.array_join(pieces, "")

    def named(alias: Column, law: Column, mode: str | None = None) -> Column:
        return F.struct(alias.alias("alias"), law.alias("law_id"), F.lit(mode).cast("string").alias("match_mode"))

    mine = F.when(F.col("base") & _usable(F.col("own")), named(F.col("own"), F.col("law_id")))
    last = F.when(F.col("base") & F.element_at("usable", -1), named(F.element_at("names", -1), F.col("law_id")))
    shortcuts = [F.when(F.col("low").rlike("(?iu)" + pattern), named(F.lit(name), F.col("law_id"), "inflect")) for pattern, names in SHORTCUTS for name in names]
    numbered = F.transform("names", lambda name, i: F.when(F.get("usable", i), named(name, F.try_element_at(F.regexp_extract_all(before(i), F.lit(LAW_NUMBER), F.lit(0)), F.lit(-1)))))
    every = F.concat(F.array(mine, *shortcuts, F.when(F.size("held") > 0, last)), numbered)
    found = rows.select(F.explode(F.filter(every, lambda x: x.isNotNull() & x["law_id"].isNotNull())).alias("x")).select("x.*")
    laws = found.groupBy("alias", "law_id").agg(F.max("match_mode").alias("match_mode"))
    few = laws.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return laws.join(few.select("alias"), "alias").groupBy("alias").agg(F.array_sort(F.collect_list("law_id")).alias("law_ids"), F.max("match_mode").alias("match_mode"))


# --- derived names ---

# Short forms of first words, a title worth its misspelling, and the arbitration law.
SHORT_HEADS = {"občanský": "obč.", "obchodní": "obch.", "trestní": "tr.", "správní": "spr."}
NOISY_TITLES = {"občanský soudní řád": ("občanského soudu řádu",)}
ARBITRATION_TITLE, ARBITRATION_NAMES = "zákon o rozhodčím řízení a o výkonu rozhodčích nálezů", ("RozŘ", "zákon o rozhodčím řízení")


def derived(aliases: DataFrame) -> DataFrame:
    """(alias, law_ids, match_mode) that follow from aliases: short first words, titles up to ' a o ', arbitration names, a misspelling. All inflect.

    Where several aliases give one name, that of the last one in alphabetical order counts.
    """
    rows = aliases.filter(F.size("law_ids") > 0).select(F.col("alias").alias("__from"), "law_ids", F.trim(F.lower("alias")).alias("low"))
    words = F.filter(F.split("low", r"(?U)\s+"), lambda w: w != "")
    short = F.element_at(F.create_map(*[F.lit(x) for pair in SHORT_HEADS.items() for x in pair]), F.get(words, F.lit(0)))
    noisy = F.element_at(F.create_map(*[x for k, v in NOISY_TITLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("low"))
    head = F.trim(F.substring_index("low", " a o ", 1))
    arbitration = F.when(F.col("low").startswith(ARBITRATION_TITLE), F.array(*map(F.lit, ARBITRATION_NAMES)))
    names = F.concat(
        F.array(F.when(F.size(words) >= 2, F.concat_ws(" ", short, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")))),
        F.array(F.when(F.col("low").startswith("zákon o ") & F.contains("low", F.lit(" a o ")) & (F.length(head) >= len(ARBITRATION_NAMES[1])), head)),
        F.coalesce(arbitration, F.array().cast("array<string>")), F.coalesce(noisy, F.array().cast("array<string>")),
    )
    names = F.when(short.isNull(), F.slice(names, F.lit(2), F.size(names))).otherwise(names)
    made = rows.select("__from", "law_ids", F.explode(F.array_compact(names)).alias("alias"))
    return made.groupBy("alias").agg(F.max_by("law_ids", "__from").alias("law_ids"), F.lit("inflect").alias("match_mode"))


# --- layers ---

#: How a layer meets what is there: "over" takes its place field by field, "absent" counts only where nothing is there.
OVER, ABSENT = "over", "absent"


def merged(layers: list[tuple[DataFrame, str]]) -> DataFrame:
    """(alias, law_ids, match_mode) of layers in order, each with how it meets those before it (OVER or ABSENT).

    Rows may have ``whole``: such a row, a plain law or list, replaces the entry; any other one
    replaces the fields it has. One row of an alias in each layer.
    """
    every = None
    for i, (df, way) in enumerate(layers):
        whole = F.coalesce(F.col("whole"), F.lit(False)) if "whole" in df.columns else F.lit(False)
        rows = df.select("alias", F.struct(F.lit(i).alias("layer"), F.lit(way).alias("way"), whole.alias("whole"), F.col("law_ids").cast("array<string>").alias("law_ids"), F.col("match_mode").cast("string").alias("match_mode")).alias("r"))
        every = rows if every is None else every.unionByName(rows)
    nothing = F.struct(F.lit(False).alias("there"), F.lit(None).cast("array<string>").alias("law_ids"), F.lit(None).cast("string").alias("match_mode"))

    def meet(now: Column, r: Column) -> Column:
        kept = now["there"] & (r["way"] == ABSENT)
        fields = [F.when(kept, now[f]).when(r["whole"] | ~now["there"], r[f]).otherwise(F.coalesce(r[f], now[f])).alias(f) for f in ("law_ids", "match_mode")]
        return F.struct(F.lit(True).alias("there"), *fields)

    entries = every.groupBy("alias").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # at most one row of each layer
    return entries.select("alias", F.aggregate("rows", nothing, meet).alias("e")).select("alias", "e.law_ids", "e.match_mode").filter("law_ids is not null")


def runtime_aliases(base: DataFrame, seeds: DataFrame | None = None, titles: DataFrame | None = None, ambiguous: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The dictionary the resolver uses: audited or global aliases, seeds over them, harvested and derived names where absent, ambiguous ones and overrides over all."""
    layers = [(base, OVER)] + ([(seeds, OVER)] if seeds is not None else []) + ([(harvest_titles(titles), ABSENT)] if titles is not None else [])
    known = merged(layers)
    more = [(df, OVER) for df in (ambiguous, overrides) if df is not None]
    return merged([(known, OVER), (derived(known), ABSENT), *more])


def entries(aliases: DataFrame) -> list[tuple[str, list[str], str | None]]:
    """A dictionary's rows in the driver, for the miners: dictionaries are small, as people keep them."""
    return [(r["alias"], list(r["law_ids"]), r["match_mode"]) for r in aliases.select("alias", "law_ids", "match_mode").orderBy("alias").collect()]


def merge_layers(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first layer that has their key, with the number of that layer from 1."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("layer", F.lit(i + 1)) for i, df in enumerate(layers)])
    return every.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("layer"))).filter("__r = 1").drop("__r")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change): added, removed, changed or unchanged."""
    a, b = old.select(key, F.col(value).alias("old"), F.lit(1).alias("__a")), new.select(key, F.col(value).alias("new"), F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old", "new", change.alias("change"))


def from_json(raw: DataFrame, layer: str) -> DataFrame:
    """(alias, law_ids, match_mode, whole, layer) from rows (alias, payload JSON): a law, a list, or an object with either; the first one replaces entries whole."""
    one = F.get_json_object("payload", "$.law_id")
    many = F.from_json(F.coalesce(F.get_json_object("payload", "$.law_ids"), F.when(F.col("payload").startswith("["), F.col("payload"))), "array<string>")
    whole = ~F.col("payload").rlike(r"^\s*[\[{]")
    plain = F.when(whole, F.array(F.regexp_replace("payload", '^"|"$', "")))
    laws = F.coalesce(F.when(one.isNotNull(), F.array(one)), many, plain)
    return raw.select("alias", laws.alias("law_ids"), F.get_json_object("payload", "$.match_mode").alias("match_mode"), (whole | F.col("payload").rlike(r"^\s*\[")).alias("whole"), F.lit(layer).alias("layer"))


def audited(raw: DataFrame) -> DataFrame:
    """(alias, law_ids, match_mode) of audit rows (alias, is_valid, law_id) that were found valid."""
    return raw.filter(F.col("is_valid") & F.col("law_id").isNotNull()).select("alias", F.array("law_id").alias("law_ids"), F.lit(None).cast("string").alias("match_mode"))

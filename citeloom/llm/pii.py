"""Personal data: fixed patterns plus bootstrapped contextual extraction (DataFrame functions only).

The base patterns give seed entities. Every seed is an instance, and so is every run of
identifier-like tokens outside seeds (with digits, or with a symbol between letters), however
long or short, and every token of a run; the words around the whole instance are lexical patterns. On the graph of patterns and
instances, scores go back and forth a fixed number of rounds: a pattern scores as the share of
its instances' scores, an instance as its best pattern. Instances in the context of a pattern that
is confident and supported by several different seeds become further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import BLANK, Staged, plain_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns in forms that give the same matches without recursion, and with the
#: bounds on digits inside, so that long runs of digits cost linear time.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9,14}+(?![\x20().-]*+[0-9])",
}
#: What makes a token identifier-like: a digit, or a symbol (no apostrophe) between letters.
MARK = r"(?:[0-9]|\p{L}[\x21-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]++\p{L})"
TOKEN = rf"(?<![^{BLANK}])[^{BLANK}]*{MARK}[^{BLANK}]*+"
#: A run's tokens are at most so many blanks apart; any other word between would take more.
GAP = 2
INSTANCE = "struct<start:int,end:int,value:string,left:string,around:string,kind:int,run:int,whole:boolean>"
ROUNDS = 3
#: A pattern needs so many different seeds, and a score, to discover.
SUPPORT, CONFIDENCE = 3, 0.6


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches, in code points: the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["before"]
        return F.struct((begin + F.length(x["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + F.length(x["found"])).alias("end"), x["found"].alias("found")))).alias("out"))

    both = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(p.alias("before"), m.alias("found")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _luhn(found: Column) -> Column:
    digits = F.regexp_replace(found, r"[\x20-]", "")

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _bytes(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substr(F.regexp_replace(p, "^0+(?=.)", ""), F.lit(1), F.lit(4)).cast("int") <= 255))


def _tested(holds):
    return lambda m: holds(m["found"])


def _span(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed patterns, by start, then kind (its place in KINDS)."""
    numeric = text.rlike(r"[0-9][0-9.\x20-]{6}")
    ready = {"email": F.contains(text, F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains(text, F.lit("+"))}
    holds = {"ip": _bytes, "card": _luhn}
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for k, kind in enumerate(KINDS):
        found = matches(text, PATTERNS[kind])
        if kind in holds:
            found = F.filter(found, _tested(holds[kind]))
        spans = F.transform(found, _span(k))
        parts.append(F.when(ready[kind], spans).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _bound(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Characters around an instance in which its neighbouring words are looked for first; where a word reaches
#: the edge, the next size is taken, and at last all of the text.
WINDOWS = (48, 1024)
BEFORE = rf"(?:[^{BLANK}]++[{BLANK}]++)?[^{BLANK}]++[{BLANK}]*+$"
AFTER = rf"^\p{{Punct}}*+[{BLANK}]++[^{BLANK}]++"


def _widening(found, sizes: tuple[int, ...]) -> Column:
    """``found(size)`` gives (value, whether the text goes on beyond the edge it touches); the first size where it does not counts."""
    value, cut = found(sizes[0])
    return value if len(sizes) == 1 else F.when(~cut, value).otherwise(_widening(found, sizes[1:]))


def _contexts(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The two words before the place, and the word before and the one after it, whole; punctuation at the place is skipped."""

    def before(size: int | None) -> tuple[Column, Column]:
        low = F.lit(1) if size is None else F.greatest(F.lit(1), start - (size - 1))
        window = F.regexp_replace(F.substr(text, low, start - low + 1), rf"(?<=^|[{BLANK}])\p{{Punct}}+$", "")
        value = F.regexp_extract(window, BEFORE, 0)
        return value, (low > 1) & (F.length(value) == F.length(window))

    def after(size: int | None) -> tuple[Column, Column]:
        window = F.substr(text, end + 1) if size is None else F.substr(text, end + 1, F.lit(size))
        value = F.regexp_extract(window, AFTER, 0)
        return value, (F.length(window) == (size or -1)) & (F.length(value) == F.length(window)) | window.rlike(rf"^\p{{Punct}}*+[{BLANK}]*+$") & (F.length(window) == (size or -1))

    words = F.lower(F.trim(F.regexp_replace(_widening(before, (*WINDOWS, None)), rf"[{BLANK}]+", " ")))
    following = F.regexp_extract(F.lower(_widening(after, (*WINDOWS, None))), rf"[{BLANK}]([^{BLANK}]++)$", 1)
    return words, F.concat_ws("_", F.element_at(F.split(words, " "), -1), following)


def _instances(text: Column, base: Column) -> Column:
    """array<INSTANCE>: the base spans with their kind, and runs of tokens outside them and the runs' tokens without one."""

    def instance(start: Column, end: Column, value: Column, kind: Column, run: Column, whole: Column) -> Column:
        left, around = _contexts(text, start, end)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), left.alias("left"), around.alias("around"), kind.alias("kind"), run.alias("run"), whole.alias("whole")).cast(INSTANCE)

    def candidate(place: Column) -> Column:
        found = F.substr(text, place["start"] + 1, place["end"] - place["start"])
        # an opening bracket stays where its closing one is inside the value
        lead = F.length(F.regexp_extract(found, r"^(?:[\p{Punct}&&[^+(]]|\((?![^)]*\)[^)]*[\p{L}0-9]))*+", 0))
        value = F.regexp_replace(F.substr(found, lead + 1), r"\p{Punct}+$", "")
        start = place["start"] + lead
        return instance(start, start + F.length(value), value, F.lit(None), place["run"], place["whole"])

    def place(start: Column, end: Column, run: Column, whole: bool) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), run.alias("run"), F.lit(whole).alias("whole"))

    def places(tokens: Column) -> Column:
        """The runs, and the tokens of runs of several."""
        numbered = F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("i")))
        first = F.filter(numbered, lambda t: (t["i"] == 0) | (t["start"] - F.get(tokens, t["i"] - 1)["end"] > GAP))
        last = F.filter(numbered, lambda t: (t["i"] == F.size(tokens) - 1) | (F.get(tokens, t["i"] + 1)["start"] - t["end"] > GAP))

        def parts(f: Column, e: Column) -> Column:
            whole = F.array(place(f["start"], e["end"], f["start"], True))
            own = F.transform(F.slice(tokens, f["i"] + 1, e["i"] - f["i"] + 1), lambda t: place(t["start"], t["end"], f["start"], False))
            return F.when(f["i"] == e["i"], whole).otherwise(F.concat(whole, own))

        return F.flatten(F.zip_with(first, last, parts))

    def free(m: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))

    seeds = F.transform(base, lambda b: instance(b["start"], b["end"], F.substr(text, b["start"] + 1, b["end"] - b["start"]), b["kind"], F.lit(None), F.lit(True)))
    tokens = F.filter(F.transform(matches(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))), free)
    return F.concat(seeds, F.transform(_bound(tokens, places), candidate))


def discover(seen: DataFrame, stage: Staged) -> DataFrame:
    """(doc_id, text_key, start, kind, end) of instances that confident patterns find outside the base spans.

    ``seen`` has doc_id, text_key and instances. A run that is found takes the place of its tokens.
    """
    flat = seen.filter(F.size("instances") > 0).select("doc_id", "text_key", F.explode("instances").alias("i")).select("doc_id", "text_key", "i.*")
    flat = stage.write(flat.filter("length(value) > 0"))
    occurs = flat.select("doc_id", "text_key", "start", "end", "value", "kind", "run", "whole", F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("A "), "around"))).alias("pattern")).filter("length(pattern) > 4")
    edges = occurs.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    known = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    edges = stage.write(edges.join(known.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "value", F.log1p("n").alias("w"), "kind"))
    # scores of values that are not seeds; seeds keep 1 for their kind
    kinds = F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)))
    guess = None
    for _ in range(ROUNDS):
        mass = edges.filter("kind is not null").select("pattern", "kind", F.col("w").alias("m"))
        if guess is not None:
            mass = mass.unionByName(edges.filter("kind is null").drop("kind").join(guess, "value").select("pattern", "kind", (F.col("w") * F.col("score")).alias("m")))
        total = edges.groupBy("pattern").agg(F.sum("w").alias("total"))
        scored = stage.write(mass.groupBy("pattern", "kind").agg(F.sum("m").alias("m")).join(total, "pattern").select("pattern", "kind", (F.col("m") / F.col("total")).alias("score")))
        guess = edges.filter("kind is null").drop("kind").join(scored, "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
    trusted = scored.join(known, ["pattern", "kind"]).filter(F.col("score") >= CONFIDENCE).select("pattern", F.col("kind").alias("found_kind"), "score")
    hits = occurs.filter("kind is null").join(trusted, "pattern").groupBy("doc_id", "text_key", "run", "whole", "start", "end").agg(F.max_by("found_kind", F.struct("score", "found_kind")).alias("kind"))
    runs = hits.groupBy("doc_id", "text_key", "run").agg(F.max("whole").alias("any"), F.collect_list(F.struct("whole", "start", "kind", "end")).alias("hits"))
    hits = runs.select("doc_id", "text_key", "any", F.explode("hits").alias("h")).filter("h.whole or not any").select("doc_id", "text_key", "h.*")
    return hits.select("doc_id", "text_key", "start", "kind", "end")


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and hash are of the base spans, ``spans`` has them and the discovered ones. Offsets
    are code points, ends exclusive. A null text is empty and has no spans (the hash is that of
    the empty string). Rows may repeat and doc_id may be null: a row is matched to what was
    discovered by its doc_id and a hash of its text. No rows in, no rows out.
    """
    stage = Staged(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text(F.col("text")).alias("body"))
    found = rows.select("doc_id", "body", base_spans(F.col("body")).alias("base"))
    instances = F.when((F.size("base") > 0) | F.col("body").rlike(MARK), _instances(F.col("body"), F.col("base"))).otherwise(F.array().cast(f"array<{INSTANCE}>"))
    seen = stage.write(found.select("doc_id", F.xxhash64("body").alias("text_key"), "base", instances.alias("instances")))
    more = discover(seen, stage).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    more = more.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "added")
    out = seen.drop("instances").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))

"""Main text of web pages by template deduction from equivalence classes.

Pages of one host with one skeleton (their block elements outside parts set apart) are rendered
from one layout. The tokens of a page are its block elements and its text blocks, each with its
path. Over the different contents of a layout (copies of a page count once), tokens with the
same occurrence vector (as often on the same contents) form an equivalence class. A class of text is the
template's where enough contents have it and the text around it differs from content to content.

Valid classes nest by path: their elements are the frame of the layout, and the text that no
class covers lies in the slots between them. The slot that varies most, the deepest element of
the frame with most of the layout's own text, is the main one. On pages with an article or main element that
one bounds the main text, unless the main slot lies elsewhere. What is left of the main slot
without the template's text, and without elements that are other parts by kind, or by a name
that the host's pages repeat, is the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Staged, lean

#: A class is valid from so many contents and this share of its layout's contents.
PAGES, SHARE = 3, 0.3
#: The same inside the article or main element, where removal needs more evidence.
INSIDE_PAGES, INSIDE_SHARE = 8, 0.5
#: Of the text of a class's pages, such a share at least is in no candidate class; near copies of one page stay below.
REST = 0.2
#: The main slot has more than this share of a layout's own text that is no link.
MOST = 0.5
#: Of several article or main elements, those with this share of the largest one's text count.
LARGEST = 1 / 3
#: A name of another part counts from so many contents of a host; hosts of fewer contents than PAGES tell nothing, there it counts at once.
REPEATED = 2
#: Templates of up to so many layouts are broadcast where their tokens are few, and candidates of up to so many tokens; more are joined by shuffle.
BROADCAST_LAYOUTS, BROADCAST_TOKENS = 20_000, 100_000

#: Elements by kind, and names in class, id and role that mark parts that are not main text: fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
APART = set("head nav footer aside form button select option iframe object canvas audio video dialog menu noscript template svg fieldset".split())
NAMES = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead topbar footer sidebar aside "
    "breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended comment comments disqus reply replies respond toolbar widget copyright login search complementary contentinfo dialog alert".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROOTS = {"article", "main"}
#: Elements of running text, which come and go from page to page; without a class or id they are not part of a skeleton.
FLOW = set("address blockquote dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li ol p pre summary table tbody td tfoot th thead tr ul".split())

#: Elements that hold parts of a page, and so may be other parts by their name; a paragraph or heading is none.
HOLDERS = (BLOCK - FLOW) | set("ul ol dl table".split())
#: A text block is a link from this share of its characters in anchors on.
LINKED = 0.6

SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(script|style|textarea|xmp)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b", re.I)


def _key(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\n".join(map(str, parts)).encode()) - (1 << 63)


class Element:
    """An open element: its path as a hash, its place (the path with numbers among siblings), and what it lies in."""

    __slots__ = ("tag", "path", "chain", "root", "apart", "named", "counts")

    def __init__(self, tag: str, path: int, chain: tuple[int, ...], root: int, apart: bool, named: tuple[int, ...]):
        self.tag, self.path, self.chain, self.root, self.apart, self.named = tag, path, chain, root, apart, named
        self.counts: dict[str, int] = {}


def other_part(token: str) -> bool:
    """Whether a class, id or role, as a whole or in all its pieces, names another part than the main text."""
    return token in NAMES or all(w in NAMES for w in re.split(r"[-_]+", token))


def parts(page: str) -> Iterator[tuple[Element, str, bool]]:
    """(element, text, link) of text blocks in page order, and (element, "", False) where a block element opens.

    What lies apart by its kind is counted from the article or main element on where there is
    one, so an unclosed menu before it does no harm.
    """
    bottom = Element("", 0, (), 0, False, ())
    stack: list[Element] = []
    held: list[tuple[str, bool]] = []
    at, anchor = 0, False

    def flush():
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        size, linked = sum(len(t.strip()) for t, _ in held), sum(len(t.strip()) for t, inside in held if inside)
        held.clear()
        if text:
            yield (stack[-1] if stack else bottom), text, linked >= LINKED * size

    for m in SCAN.finditer(page):
        held.append((page[at : m.start()], anchor))
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append((html.escape(m[0][9:].removesuffix("]]>")), anchor))
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        inline = tag not in BLOCK and tag not in APART
        if tag == "a":
            anchor = not closing
        if tag == "br":
            held.append((" ", anchor))
        if inline and (tag in VOID or not attributes):
            continue
        if closing:
            if any(x.tag == tag for x in stack):
                if not inline:
                    yield from flush()
                while stack:
                    x = stack[-1]
                    if inline and (x.apart or x.named):
                        yield from flush()
                    stack.pop()
                    if x.tag == tag:
                        break
            elif not inline:
                yield from flush()
            continue
        tokens = {w for a in ATTRIBUTE.finditer(attributes) for w in (a[2] or a[3] or a[4] or "").lower().split()} if attributes else set()
        if not inline:
            yield from flush()
            while stack and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()) or stack[-1].tag not in BLOCK and stack[-1].tag not in APART):
                stack.pop()
        up = stack[-1] if stack else bottom
        names = tuple(_key("name", tag, w) for w in sorted(tokens) if other_part(w)) if inline or tag in HOLDERS else ()
        kind = tag in APART or tag == "header" and not up.root
        if inline and not names:
            continue  # inline elements matter only where they set text apart
        if inline:
            yield from flush()
        root = (tag in ROOTS or bool(attributes) and MAIN.search(attributes) is not None) and not up.root and not kind and not (names and tag not in ROOTS)
        alike = tag + "".join("." + w for w in sorted(tokens) if w.replace("-", "").replace("_", "").isalpha())  # tokens with digits number pages, not layouts
        path, chain = _key(up.path, alike), up.chain
        if not inline and alike not in FLOW:
            up.counts[alike] = up.counts.get(alike, 0) + 1
            chain = (*chain, _key(chain[-1] if chain else 0, alike, up.counts[alike]))
        if tag in VOID:
            continue
        now = Element(tag, path, chain, chain[-1] if root and chain else up.root, not root and (up.apart or kind), () if root else up.named + names)
        stack.append(now)
        if not inline and alike not in FLOW:
            yield now, "", False
    held.append((page[at:], anchor))
    yield from flush()


#: A text block: hash of path and text, text, places of the elements it lies in, its article or main element (0: none), names of other parts it lies in.
Block = tuple[int, str, tuple[int, ...], int, tuple[int, ...], bool]


def frame(page: str) -> tuple[int, list[Block]]:
    """(layout, text blocks): the skeleton's hash, and the blocks outside parts that are apart by kind."""
    skeleton, blocks = set(), []
    for element, text, link in parts(page):
        if element.apart:
            continue
        if text:
            blocks.append((_key(element.path, text), text, element.chain, element.root, element.named, link))
        elif not element.named:
            skeleton.add(element.path)
    return _key(sorted(skeleton)), blocks


TOKENS = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("content", pa.int64()), ("kind", pa.int32()), ("token", pa.int64()), ("times", pa.int64()), ("chars", pa.int64()), ("inside", pa.bool_()), ("own", pa.bool_()), ("chain", pa.list_(pa.int64()))])
TOKEN_COLUMNS = "host string, layout long, content long, kind int, token long, times long, chars long, inside boolean, own boolean, chain array<long>"
#: Tokens are text blocks, or names of other parts.
TEXT, NAME = 0, 1
BLOCKS = pa.list_(pa.struct([("key", pa.int64()), ("text", pa.string()), ("chain", pa.list_(pa.int64())), ("root", pa.int64()), ("named", pa.list_(pa.int64()))]))
BLOCK_COLUMNS = "array<struct<key:long,text:string,chain:array<long>,root:long,named:array<long>>>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        rows: dict[tuple, list] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), strict=True):
            layout, blocks = frame(page)
            content = _key(*(b[1] for b in blocks))
            counts: dict[tuple[int, int], list] = {}
            for key, text, chain, root, named, link in blocks:
                counts.setdefault((TEXT, key), [0, len(text), root != 0, not link, chain])[0] += 1
                for name in named:
                    counts.setdefault((NAME, name), [0, 0, False, False, ()])[0] += 1
            for (kind, token), values in counts.items():
                rows[host, layout, content, kind, token] = values
        keys = [*zip(*rows)] or [()] * 5
        values = [*zip(*rows.values())] or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*keys, *values), TOKENS, strict=True)], schema=TOKENS)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        made = [frame(page) for page in batch.column("page").to_pylist()]
        blocks = pa.array([[{"key": b[0], "text": b[1], "chain": b[2], "root": b[3], "named": b[4]} for b in m[1]] for m in made], BLOCKS)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array([m[0] for m in made], pa.int64()), blocks], names=["page_id", "url", "host", "layout", "blocks"])


def templates(pages: DataFrame, stage: Staged) -> DataFrame:
    """(host, layout, template, slot, names): text tokens of the valid classes, the place of the main slot, and names of other parts that the host's pages repeat.

    Layouts of too few contents have no template and no slot, and ``names`` is null where the host has too few.
    Occurrence vectors are compared by sums of content hashes. Tokens on a fixed share of a
    layout's contents are at most a fixed multiple of the tokens of an average page, so a
    template is small however many pages its host has.
    """
    at = ["host", "layout"]
    tokens = pages.select("host", "page").mapInArrow(_tokens, TOKEN_COLUMNS)
    tokens = stage.write(tokens.groupBy(*at, "content", "kind", "token").agg(*[F.max(c).alias(c) for c in ("times", "chars", "inside", "own", "chain")]))
    contents = tokens.select(*at, "content").distinct()
    layouts = stage.write(contents.groupBy(*at).agg(F.count(F.lit(1)).alias("contents")))
    hosts = contents.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_contents")).filter(F.col("host_contents") >= PAGES)
    texts, names = tokens.filter(F.col("kind") == TEXT), tokens.filter(F.col("kind") == NAME)

    vector = F.sum(F.shiftrightunsigned(F.xxhash64("content", "times"), 31)).alias("vector")
    each = texts.groupBy(*at, "inside", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum("times").alias("n"), vector).filter(F.col("pages") >= F.when(F.col("inside"), INSIDE_PAGES).otherwise(PAGES))
    enough = F.col("pages") >= F.when(F.col("inside"), INSIDE_SHARE).otherwise(SHARE) * F.col("contents")
    candidates = stage.write(each.join(layouts, at).filter(enough).select(*at, "token", F.xxhash64("pages", "n", "vector").alias("class")))
    # classes whose pages have little other text are pages copied with small changes, not a template
    near = F.broadcast(candidates) if candidates.count() <= BROADCAST_TOKENS else candidates
    marked = texts.join(near, [*at, "token"], "left")
    text = F.col("times") * F.col("chars")
    covered = marked.groupBy(*at, "content").agg((F.sum(F.when(F.col("class").isNull(), text).otherwise(0)) / F.sum(text)).alias("rest"), F.collect_set("class").alias("classes"))
    valid = covered.select(*at, "rest", F.explode("classes").alias("class")).groupBy(*at, "class").agg(F.avg("rest").alias("rest")).filter(F.col("rest") >= REST)
    kept = candidates.join(valid.drop("rest"), [*at, "class"]).groupBy(*at).agg(F.collect_list("token").alias("template"))

    # the frame: elements around own text; the deepest one with most of it is the main slot
    own = marked.filter("class is null and own").select(*at, text.alias("chars"), "chain")
    under = own.select(*at, "chars", F.posexplode("chain").alias("depth", "place")).groupBy(*at, "depth", "place").agg(F.sum("chars").alias("chars"))
    whole = own.groupBy(*at).agg(F.sum("chars").alias("all"))
    slot = under.join(whole, at).filter(F.col("chars") > MOST * F.col("all")).groupBy(*at).agg(F.max_by("place", "depth").alias("slot"))

    repeated = names.groupBy("host", "token").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= REPEATED).groupBy("host").agg(F.collect_list("token").alias("names"))
    told = hosts.join(repeated, "host", "left").select("host", F.coalesce("names", F.array().cast("array<long>")).alias("names"))
    rows = layouts.join(kept, at, "left").join(slot, at, "left").join(told, "host", "left")
    return rows.select(*at, "template", F.when(F.col("contents") >= PAGES, F.col("slot")).alias("slot"), "names").filter("template is not null or slot is not null or names is not null")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null html is empty and gives an empty text. Pages without a url share the host "". Rows
    may repeat. Broken markup (unclosed or stray tags, cut pages) is read as far as it goes. No
    rows in, no rows out.
    """
    stage = Staged(pages.sparkSession, "htmltext")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("page"))
    made = stage.write(templates(rows, stage))
    size = made.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce(F.size("template"), F.lit(0)) + F.coalesce(F.size("names"), F.lit(0))), F.lit(0)).alias("tokens")).first()
    few = size["n"] <= BROADCAST_LAYOUTS and size["tokens"] <= BROADCAST_TOKENS * 10
    framed = rows.mapInArrow(_frames, f"page_id long, url string, host string, layout long, blocks {BLOCK_COLUMNS}")
    joined = framed.join(F.broadcast(made) if few else made, ["host", "layout"], "left")

    nothing = F.array().cast("array<long>")
    template, slot, names = F.coalesce("template", nothing), F.coalesce("slot", F.lit(0)), F.col("names")
    # names of other parts count where the host repeats them, and where it tells nothing
    free = F.filter("blocks", lambda b: (F.size(b["named"]) == 0) | names.isNotNull() & ~F.arrays_overlap(b["named"], F.coalesce(names, nothing)))
    joined = joined.withColumn("free", F.filter(free, lambda b: ~F.array_contains(template, b["key"])))
    roots = F.map_from_entries(F.transform(F.array_distinct(F.transform("free", lambda b: b["root"])), lambda r: F.struct(r, F.aggregate(F.filter("free", lambda b: b["root"] == r), F.lit(0), lambda n, b: n + F.length(b["text"])))))
    sizes = F.map_filter(roots, lambda r, n: r != 0)
    joined = joined.withColumn("sizes", sizes).withColumn("in_slot", F.filter("free", lambda b: F.array_contains(b["chain"], slot)))
    large = F.map_keys(F.map_filter("sizes", lambda r, n: n >= F.array_max(F.map_values("sizes")) * LARGEST))
    elsewhere = (F.size("in_slot") > 0) & ~F.exists("in_slot", lambda b: b["root"] != 0)
    chosen = (
        F.when((F.size("sizes") > 0) & ~elsewhere, F.filter("free", lambda b: F.array_contains(large, b["root"])))
        .when(F.size("in_slot") > 0, F.col("in_slot")).otherwise(F.col("free"))
    )
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

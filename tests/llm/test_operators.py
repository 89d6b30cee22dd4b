"""The operators against brute force: on hand-made rows with every odd case, and on the smallest tables."""

from __future__ import annotations

import binascii
import hashlib
import pathlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from citeloom import ship
from citeloom.llm import common, exact_dedup, fingerprint, mixing, near_dedup, packing, pii, quality, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, row long, rank long, norm string, fold string, bucket int, c long, rep long, page string, at int"


def lines(seed: int, n: int, words: int = 12) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéñ", k=rng.randint(1, 8))) for _ in range(n * words))


def odd_rows() -> list[tuple]:
    base = lines(1, 30)
    near = base.replace(base.split()[7], "other", 1)
    passage = lines(2, 6)
    texts = [
        base, base, base.upper(), near, None, "", "   \n\t", "one", "two words", "Two Words", lines(3, 4) + passage, lines(4, 5) + " " + passage + lines(5, 3),
        "a" * 500, "ab " * 400, "a" * 120, "x" * 49, "y" * 50, "y" * 50, passage[:60], "0 " * 3000, "1.2.3.4 " * 50, lines(6, 2500), "😀 " * 60 + base[:200], "mail a.b@c.de, +1 (234) 567-8901 4556 7375 8689 9855",
    ]
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s0"), (None, base, None, None), (None, None, None, None), (-5, passage, "de", "s1"), (10**12, lines(7, 20), "fr", "zz")]
    return [(*r, 0, "clash", 1, 2, "clash", "clash", 3, 4, 5, "clash", 6) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def rows_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def below(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


# --- 1: personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple]:
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(kind, m[0]))


TRICKY = [
    "a@b.c_d@e.f", "x@y..z a@b.c.", "..a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "001.002.003.0255 1.2.3.256", "5  4111111111111111", "4111-1111-1111-1111 4111 1111 1111 1111", "41111111111111111111111",
    "+1234567890 +12 345 678 9 +1(2)3.4-5 67890123456789", "+1+1234567890", "é@b.cz ümail@host.de 😀a@b.co", "4" * 5000, "1 2 " * 3000, "a." * 3000 + "@b.c" + ".d" * 3000, "+1" + "." * 3000 + "2", "4111 1111  1111 1111", "-4111111111111111-", "a@b.c@d.e", None, "",
]


def test_pii_base_spans(spark, odd, empty, docs):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for table in (tricky, odd, docs):
        got = sorted(collected(pii.find(table).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")), key=str)
        expected = []
        for doc_id, text in rows_of(table):
            spans = base_spans(text or "")
            expected.append((doc_id, *(sum(s[3] == k for s in spans) for k in BASE), hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()))
        assert got == sorted(expected, key=str)
    assert pii.find(empty).count() == 0


def test_pii_contexts_discover_unseen(spark):
    ship(spark)
    seeds = [(i, f"Please write to agent number {i} and send mail to user{i + 10}@mail.example.org today, {lines(i, 1)}") for i in range(12)]
    hidden = [(100, "Please answer and send mail to user77(at)mail77.example.org today"), (101, "nothing 12345678 here")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    start = hidden[0][1].index("user77")
    assert got[100] == f"email:{start}:{start + len('user77(at)mail77.example.org')}"
    assert got[101] == ""


def test_pii_identifiers_of_any_length_and_without_digits(spark):
    ship(spark)
    word = "w" * 60
    seeds = [(i, f"You may {word} write to{'.' * (i % 2)} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}@mail.example.org {word} then") for i in range(30)]
    long = "x7" * 100
    hidden = {100: long, 101: "a.b", 102: "7", 103: "jane.doe(at)mail"}
    rows = seeds + [(k, f"You may {word} write to {v} {word} then") for k, v in hidden.items()]
    rows += [(200, f"You may {word[:-1]}v write to 12345 and"), (201, f"You may v{word} and to 12345 v{word} then")]  # words that differ beyond 48 characters are other words
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, v in hidden.items():
        text = dict(rows)[k]
        assert got[k] == f"email:{text.index(' ' + v + ' ') + 1}:{text.index(' ' + v + ' ') + 1 + len(v)}", v
    assert got[201] == ""


def test_pii_contexts_around_whole_seeds(spark):
    phones = [(i, f"You can please call +1 (212) 555-{1000 + i} today. Thanks.") for i in range(30)]
    mails = [(100 + i, f"You may always write {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}.doe@mail.example.org now. Thanks.") for i in range(30)]
    cards = [(200 + i, f"She paid by card {c} yesterday.") for i, c in enumerate(("4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "5105 1051 0510 5100", "4222 2222 2222 2220"))]
    hidden = {300: ("phone", "(212) 555-0199"), 301: ("phone", "212 555 0199"), 302: ("email", "jane.doe(at)mail.example.org"), 303: ("card", "4111 1111 1111 1112")}
    around = {"phone": "You can please call {} today. Thanks.", "email": "You may always write {} now. Thanks.", "card": "She paid by card {} yesterday."}
    rows = [(i, around[kind].format(x)) for i, (kind, x) in hidden.items()]
    rows += [(400, "See sections 12 34 and 56.7.8 of e.g. the manual")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(phones + mails + cards + rows, "doc_id long, text string")).collect()}
    for (i, text), (kind, x) in zip(rows, hidden.values(), strict=False):
        assert got[i] == f"{kind}:{text.index(x)}:{text.index(x) + len(x)}"
    assert got[400] == "" and got[7] == "phone:20:37"


# --- 2: exact duplicates ---


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, odd, empty, docs, keep):
    best = max if keep == "largest" else min
    many = spark.createDataFrame([(i, "Same Text" if i % 3 else "same text") for i in range(400)] + [(1000, "other")], "doc_id long, text string")
    for table in (odd, docs, many):
        groups: dict[str, list] = {}
        rows = rows_of(table)
        for doc_id, text in rows:
            groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
        expected = []
        for text, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep_id = best(known) if known else None
            expected += [(i, keep_id, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        got = exact_dedup.content_sort(table, keep=keep)
        assert sorted(collected(got.select("doc_id", "keep_id", "group_size", "text_sha256")), key=str) == sorted(expected, key=str)
        kept = got.filter("kept").collect()
        assert len(kept) == len(groups) and {r["text_sha256"] for r in kept} == {e[3] for e in expected}
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.content_sort(empty).count() == 0


# --- 3: repeated passages ---


def removed(rows: list[tuple]) -> list[tuple]:
    first: dict[bytes, int] = {}
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    for doc_id, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 63), below(doc_id))
    out = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < below(doc_id):
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_repeated_passages(spark, odd, empty, docs, crowd):
    for table in (odd, docs):
        assert sorted(collected(suffix_dedup.repeated_passages(table, crowd_size=crowd)), key=str) == removed(rows_of(table))
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_repeated_passages_disk(spark, docs):
    """Fragments are gone before the documents are dealt for the last time."""
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("suffix-dedup-*/*"))
    got = suffix_dedup.repeated_passages(docs)
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("suffix-dedup-*/*")) - before]
    assert left and not any({"fragment", "minimizer", "minimizers"} & set(columns) for columns in left)
    assert sorted(collected(got), key=str) == removed(rows_of(docs))


def test_repeated_passages_chance(spark):
    """Texts that share some 30 bytes and no more cost no fragments; equal strings of 50 bytes have a key in common."""
    ship(spark)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh", k=60)) + "thirty bytes that all of us say" + "".join(rng.choices("abcdefgh", k=60)) for _ in range(40)]
    rows = spark.createDataFrame([(i + 1, i, t) for i, t in enumerate(texts)], "row long, rank long, body string")
    assert suffix_dedup._fragments(rows, common.Staged(spark, "test")).count() == 0
    texts += ["a" * 300, "ab " * 90, "".join(rng.choices("ab", k=2000)), texts[0][20:120] + "z" + texts[1][3:60], ("a" * 90 + "b") * 4]
    keys: dict[bytes, list[set]] = {}
    for data in map(str.encode, texts):
        of = [set() for _ in range(len(data) - 49)]
        for key, low, high in zip(*(x.tolist() for x in suffix_dedup.fragments(data)[3:]), strict=True):
            for k in range(low, high + 1):
                of[k].add(key)
        for k, found in enumerate(of):
            keys.setdefault(data[k : k + 50], []).append(found)
    assert all(set.intersection(*found) for found in keys.values())


# --- 4: mixing ---


def test_mixing(spark, odd, empty, docs):
    for table in (odd, docs):
        got = mixing.mix(table)
        again = mixing.mix(table.repartition(5))
        assert sorted(collected(got), key=str) == sorted(collected(again), key=str)
        rows = got.collect()
        assert len(rows) == table.count()
        sources: dict = {}
        for r in rows:
            assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
            s = sources.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 0])
            s[0], s[1], s[4] = s[0] + r["size"], s[1] + r["taken"], max(s[4], r["size"])
        assert all(s[0] == s[3] for s in sources.values())
        # a source of a few documents cannot come nearer than the size of one allows
        assert all(abs(s[1] - s[2]) <= 0.05 * s[2] + (25 if table is docs else s[4]) for s in sources.values())
    assert mixing.mix(empty).count() == 0


def slow_mix(units: list[tuple[int, int, int]], ratio: float) -> dict[tuple[int, int], int]:
    """(doc_id, size) -> times for the (doc_id, size, turn) of one source of one block: the flight with vectors, the landing by trying all choices."""
    units = sorted(units, key=lambda u: (-u[1], u[2], u[0]))
    sure, rest = int(ratio // 1), ratio - ratio // 1
    p = [rest if 1e-9 < rest < 1 - 1e-9 else float(round(rest))] * len(units)
    undecided = [i for i in range(len(units)) if 0 < p[i] < 1 and units[i][1] > 0]
    aside = {undecided[int(k)] for k in np.linspace(0, len(undecided) - 1, mixing.LANDING)} if undecided else set()
    flying = [i for i in range(len(units)) if i not in aside]
    place = {i: k for k, i in enumerate(flying)}
    held: list[int] = []
    for i in flying:
        if not 1e-9 < p[i] < 1 - 1e-9:
            continue
        held.append(i)
        while len(held) == 3:
            u = -np.cross([1.0, 1.0, 1.0], [float(units[k][1]) for k in held])  # the null-space of the two constraints
            u = u if u.any() else np.array([1.0, -1.0, 0.0])
            up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(held, u) if v)
            down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(held, u) if v)
            a, b, c = (place[k] for k in held)
            coin = ((a * 2654435761 + b * 40503 + c * 97) & 0xFFFF) / 65536
            step = up if coin < down / (up + down) else -down
            for k, v in zip(held, u):
                p[k] = min(1.0, max(0.0, p[k] + step * v))
                p[k] = p[k] if 1e-9 < p[k] < 1 - 1e-9 else float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    number, owed = sum(p[i] for i in left), sum(p[i] * units[i][1] for i in left)
    best = None
    for choice in range(1 << len(left)):
        taken = [k for j, k in enumerate(left) if choice >> j & 1]
        apart, units_apart = abs(sum(units[k][1] for k in taken) - owed), abs(len(taken) - number)
        if best is None or (apart + units_apart * 0.5, units_apart) < best[0]:
            best = ((apart + units_apart * 0.5, units_apart), taken)
    chosen = set(best[1]) if best else set()
    return {(u[0], u[1]): sure + int(round(p[i]) if i not in left else i in chosen) for i, u in enumerate(units)}


def test_mixing_equals_a_plain_flight(spark):
    """All documents a source has are one block here, so the plain flight tells how often each is taken."""
    from pyspark.sql import functions as F

    ship(spark)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 7, 20, 50, 51, 200])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table)
    turns = {(r["doc_id"], r["size"]): r["t"] for r in got.select("doc_id", "size", F.xxhash64("doc_id", "size").alias("t")).collect()}
    sources: dict = {}
    for r in got.collect():
        sources.setdefault((r["source"], r["target"], r["source_size"]), {})[r["doc_id"], r["size"]] = r["taken"]
    for (_, target, size), taken in sources.items():
        times = slow_mix([(i, n, turns[i, n]) for i, n in taken], target / size)
        assert taken == {k: n * k[1] for k, n in times.items()}


def test_mixing_sizes_and_targets(odd):
    sizes = sorted((r["doc_id"], r["size"]) for r in mixing.mix(odd.filter("doc_id is not null")).collect())
    assert sizes == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows_of(odd) if i is not None)
    target = mixing.targets([("a", 10), ("b", 1000), ("c", 1000), (None, 2000)])
    assert target["a"] == 30 and abs(sum(target.values()) - 4010) < 1e-6
    left = 4010 - 30
    assert target["b"] == pytest.approx(left * 2 / 8) and target["c"] == pytest.approx(left / 8) and target[None] == pytest.approx(left * 5 / 8)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, x = rng.uniform(0, 1, 500), rng.integers(0, 2000, 500).astype(float)
    out = mixing.fly(p, x)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())


# --- 5: near duplicates ---


def components(rows: list[tuple], width: int) -> dict:
    sets: dict = {}
    for doc_id, text in rows:
        words = (text or "").translate(LOWER).encode().split()
        w = min(width, len(words))
        s = frozenset(tuple(words[k : k + w]) for k in range(len(words) - w + 1)) if words else frozenset()
        sets.setdefault(doc_id, []).append(s)
    nodes = [(i, s) for i, v in sets.items() if i is not None for s in v if s]
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(nodes[a][0]), find(nodes[b][0])))
                top[v] = u
    return {i: find(i) for i in sets if i is not None}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, odd, empty, docs, width):
    rng = random.Random(9)
    base = lines(20, 20).split()
    chain = [(5000 + i, " ".join(w if rng.random() > 0.04 else f"new{rng.random()}" for w in base)) for i in range(60)]
    copies = spark.createDataFrame(chain, "doc_id long, text string")
    for table in (odd, docs, copies):
        expected = components(rows_of(table), width)
        got = near_dedup.near_duplicates(table, width=width).collect()
        assert len(got) == table.count()
        for r in got:
            if r["doc_id"] is not None:
                assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(3)
    needed = dict(near_dedup.least_matches(0.8))
    agree = rng.random((20_000, near_dedup.HASHES)) < 0.8
    for n, m in needed.items():
        assert (agree[:, :n].sum(1) < m).mean() < 1e-3
        assert m > 0


# --- 6: fingerprints ---


def test_fingerprints(odd, empty, docs):
    for table in (odd, docs):
        rows = sorted(rows_of(table), key=lambda r: (below(r[0]), r[1] or ""))
        expected = []
        for k, (doc_id, text) in enumerate(rows):
            edited = fingerprint.half_replaced(text or "", rows[(k + 1) % len(rows)][1] or "")
            expected.append((doc_id, len(text or ""), hashlib.sha256(edited.encode()).hexdigest()))
        got = fingerprint.compare_with_next(table)
        assert sorted(collected(got.select("doc_id", "n_chars", "edited_sha256")), key=str) == sorted(expected, key=str)
        for r in got.collect():
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprint.compare_with_next(empty).count() == 0
    a, b = fingerprint.digest(lines(1, 30).encode()), fingerprint.digest(lines(2, 30).encode())
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) == fingerprint.likeness(b, a) < 0.97


def slow_digest(data: bytes) -> tuple[int, list[int]]:
    """The digest, a triplet at a time."""
    import math

    counts = [0] * 256
    for k, (i, j, l) in enumerate(fingerprint.TRIPLETS if len(data) >= 3 else ()):
        for at in range(len(data) - l):
            h = data[at + i] * 0x9E3779B1 + data[at + j] * 0x85EBCA77 + data[at + l] * 0xC2B2AE3D + 0x27D4EB2F * (k + 1) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            counts[h >> 24] += 1
    low, middle, high = (sorted(counts)[k] for k in (63, 127, 191))
    return min(255, round(12 * math.log2(len(data) + 1))), [(c > low) + (c > middle) + (c > high) for c in counts]


def slow_likeness(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> float:
    apart = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1], b[1])) + min(48, abs(a[0] - b[0]))
    return 1 - apart / (6 * 256 + 48)


def test_digests_and_likeness_equal_plain_ones(docs):
    rows = sorted((r for r in rows_of(docs)), key=lambda r: r[0])
    short = [(k, rows[k], rows[(k + 1) % len(rows)]) for k in range(len(rows)) if len(rows[k][1] or "") < 2500 and len(rows[(k + 1) % len(rows)][1] or "") < 2500]
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs).collect()}
    assert len(short) > 40
    for _, (doc_id, text), (_, other) in short[:60]:
        edited = fingerprint.half_replaced(text or "", other or "")
        own, changed, following = (slow_digest((t or "").encode()) for t in (text, edited, other))
        text_form = lambda d: f"{d[0]:02x}" + bytes(sum(d[1][4 * k + q] << 2 * q for q in range(4)) for k in range(64)).hex()
        r = got[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_form(own), text_form(changed))
        assert r["near_edited"] == pytest.approx(slow_likeness(own, changed)) and r["near_next"] == pytest.approx(slow_likeness(own, following))


# --- 7: packing ---


def test_ids_are_those_of_tokenizers():
    import public_tokenizers
    import pyarrow.parquet as pq

    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast, plain = packing.tokenizer(vocabulary, ranks), packing.tokenizer(vocabulary, None)
    rng = random.Random(4)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    alphabet = "ab ZŽ'’\n\t\u00a0\u2003éñß漢字한😀\u0301\u200d0123456789.,!?<|>endoftext_"
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(3000)] + ["<|endoftext|> x", "don't we'LL I'm", " \n \n  x"]
    assert all(np.array_equal(fast(t), plain(t)) for t in texts)


def test_packing(odd, empty, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = Tokenizer.from_file(vocabulary)
    for table, fast in ((odd, ranks), (docs, ranks), (docs.limit(20), None)):
        rows = rows_of(table)
        pieces = packing.pack(table, vocabulary, fast).collect()
        ids: dict = {}
        for doc_id, text in rows:
            ids.setdefault(doc_id, []).append([*plain.encode(text or "", add_special_tokens=False).ids, 0])
        place: dict = {}
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == place.get(r["sequence_id"], 0)
            place[r["sequence_id"]] = r["offset"] + r["length"]
            assert any(len(x) == r["doc_tokens"] and binascii.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert sorted(place) == list(range(len(place)))
        assert all(n == 1024 for k, n in place.items() if k != max(place))
        assert sum(r["length"] for r in pieces) == sum(len(x) for v in ids.values() for x in v)
    assert packing.pack(empty, vocabulary).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    grid = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    walk = grid[np.argsort(packing.hilbert(grid, bits=4))]
    assert len(set(packing.hilbert(grid, bits=4).tolist())) == 256
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# --- 8 and 9: classifiers ---


def held_out(doc_id: int, folds: int, held: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == held


def auc(pairs: list[tuple[float, int]]) -> float:
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("module,label,folds,held,least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.8)])
def test_classifiers_on_held_out_rows(spark, odd, empty, module, label, folds, held, least):
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = module.fit(table, labels)
    got = {r["doc_id"]: r for r in module.score(table, model).collect()}
    assert len(got) == table.count()
    assert all(r["held_out"] == held_out(i, folds, held) and 0 <= r["score"] <= 1 for i, r in got.items())
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert auc([(got[i]["score"], y) for i, y in truth.items() if held_out(i, folds, held)]) >= least
    strange = module.score(odd, model).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert module.score(empty, model).count() == 0
    bare = module.fit(table, labels.limit(0))
    assert len({r["score"] for r in module.score(table, bare).collect()}) == 1


def test_toxicity_calibrates_on_all_sampled_documents(spark, monkeypatch):
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    calibrated, find, trained, train = [], toxicity.best_threshold, [], toxicity.train
    monkeypatch.setattr(toxicity, "best_threshold", lambda p, y: calibrated.append(y) or find(p, y))
    monkeypatch.setattr(toxicity, "train", lambda docs, y: trained.append(y) or train(docs, y))
    toxicity.fit(table, labels)
    sampled = [r["toxic"] for r in toxicity.labelled(table, labels, "toxic", 3, 1, toxicity.LABELLED).collect()]
    assert len(calibrated[0]) == len(sampled) // 4
    assert (1 - trained[0]).sum() < 0.5 * sampled.count(0)


def test_quality_scores_from_the_stored_model(spark, docs):
    """Each feature of each text by the formula of the model, one at a time."""
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for doc_id, text in rows_of(docs):
        z = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(quality.statistics(text or ""), model.mean, model.scale, strict=True)]
        raw = sum(w * np.cos(sum(a * b for a, b in zip(z, wave)) + phase) * (2 / quality.FEATURES) ** 0.5 for w, wave, phase in zip(model.weights, model.waves.T, model.phases, strict=False)) + model.weights[-1]
        k = int(np.searchsorted(model.edges, raw))
        if k == 0 or k == len(model.edges):
            expected = model.means[min(k, len(model.edges) - 1)]
        else:
            share = (raw - model.edges[k - 1]) / (model.edges[k] - model.edges[k - 1])
            expected = model.means[k - 1] + share * (model.means[k] - model.means[k - 1])
        assert got[doc_id] == pytest.approx(expected, abs=1e-6)


def test_toxicity_scores_from_the_stored_model(spark, docs):
    """Embeddings, convolutions of each width and their maxima word by word."""
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    common = toxicity.language_table()
    for doc_id, text in rows_of(docs):
        codes = toxicity.encode(text or "")
        x = model.words[codes[:, 0]].astype(float) + model.heads[codes[:, 1]]
        pooled = []
        for j, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
            for c in range(toxicity.FILTERS):
                places = [sum(x[at + k] @ f[k, :, c] for k in range(width)) for at in range(len(x) - width + 1)]
                pooled.append(max(0.0, max(places) + model.biases[j * toxicity.FILTERS + c]) if places else 0.0)
        p = 1 / (1 + np.exp(-np.clip(np.array(pooled) @ model.out + model.shift, -30, 30)))
        t = model.thresholds[toxicity.language(codes, common)]
        expected = 0.7 * p / t if p < t else 0.7 + 0.3 * (p - t) / max(1 - t, 1e-9)
        assert got[doc_id] == pytest.approx(expected, abs=1e-4)


def test_toxicity_sample_is_bounded_by_bytes(spark):
    ship(spark)
    table = spark.createDataFrame([(i, "word " * 100 + ("bad " if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    few, none = toxicity.fit(table, labels, limit_bytes=5_000), toxicity.fit(table, labels, limit_bytes=10)
    assert len({*np.round(none.score(["bad", "word"]), 9)}) == 1 and few.score(["x"]).shape == (1,)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    edges, means = quality.isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(means) > 0).all() and (np.diff(edges) > 0).all()

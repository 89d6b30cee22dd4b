"""Normalized text with a map back to the raw text, and clean-up of text blocks read from pages."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Characters that are dropped, fixed values.
ZERO_WIDTH = "​‌‍⁠﻿­"
STEP = re.compile(
    rf"(?P<gone>[{ZERO_WIDTH}]+)|(?P<hyphen>(?<=[^\W\d_])-[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*(?=[^\W\d_]))|(?P<space>\s(?:[\s{ZERO_WIDTH}])*)"
)


class Normalized:
    """``text`` for matching and ``raw_span`` to raw offsets.

    Only the places where the texts differ are kept: runs that were dropped or squeezed. A
    span's end is the end of its last character, so a squeezed run counts as a whole.
    """

    def __init__(self, raw: str):
        parts, length = [], 0
        self.at, self.raw_at = [0], [0]  # starts of runs that map one to one: normalized, raw
        self.squeezed: dict[int, int] = {}  # normalized place of a single space: raw end of its run
        last, visible = 0, len(raw)
        while visible and (raw[visible - 1].isspace() or raw[visible - 1] in ZERO_WIDTH):
            visible -= 1
        for m in STEP.finditer(raw):
            parts.append(raw[last : m.start()])
            length += m.start() - last
            last = m.end()
            if m["space"] and length and last < visible:
                parts.append(" ")
                self.at.append(length)
                self.raw_at.append(m.start())
                self.squeezed[length] = last
                length += 1
            self.at.append(length)
            self.raw_at.append(last)
        parts.append(raw[last:])
        self.text = "".join(parts)

    def _raw(self, place: int) -> int:
        k = bisect_right(self.at, place) - 1
        return self.raw_at[k] + place - self.at[k]

    def raw_span(self, start: int, end: int) -> tuple[int, int]:
        """Raw [start, end) of a normalized one; clamped, (0, 0) for an empty text."""
        n = len(self.text)
        if not n:
            return 0, 0
        start = max(0, min(start, n))
        end = max(start, min(end, n))

        def stop(place: int) -> int:
            return self.squeezed.get(place) or self._raw(place) + 1

        if start >= n:
            return stop(n - 1), stop(n - 1)
        low = self._raw(start)
        return low, stop(end - 1) if end > start else low


#: Limits of blocks that belong together, in points; fixed values.
COLUMN, GAP = 28, 22


def joined_lines(block: str) -> str:
    """Lines of a block as running text: hyphenated words joined, a line that ends a sentence kept apart."""
    out: list[str] = []
    for line in filter(None, (" ".join(x.split()) for x in block.splitlines())):
        if out and not re.search(r"[.!?:]$", out[-1]):
            glue = len(out[-1]) > 1 and out[-1].endswith("-") and out[-1][-2].islower() and line[:1].islower()
            out[-1] = out[-1][:-1] + line if glue else out[-1] + ("" if out[-1].endswith("-") else " ") + line
        else:
            out.append(line)
    return "\n".join(out)


def page_text(blocks: list[tuple[float, float, float, float, str]]) -> str:
    """Text of a page's blocks (x0, y0, x1, y1, text) in reading order: neighbours in one column are one paragraph."""
    clusters: list[list] = []
    for x0, y0, _, y1, text in blocks:
        plain = " ".join(text.split())
        if not plain:
            continue
        marker = re.compile(r"(?:[IVXLC]+\.?|\d+\.?|\[\d+\])")
        before = clusters[-1] if clusters else None
        apart = before is None or marker.fullmatch(plain) or marker.fullmatch(before[2]) or re.search(r"[.!?:;]$", before[2])
        if apart or abs(x0 - before[0]) > COLUMN or y0 - before[1] > GAP:
            clusters.append([x0, y1, plain, [plain]])
        else:
            before[0], before[1], before[2] = x0, y1, plain
            before[3].append(plain)
    return "\n".join(joined_lines("\n".join(c[3])) for c in clusters)

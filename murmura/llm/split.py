"""Splitting oversized items at natural boundaries, with balanced pieces and a fixed overlap.

Only oversized rows leave the JVM: the length test runs as a filter before the Arrow step, so a table of mostly small
items costs a scan. Splitting one item needs no other row, so there is no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.functions.text import utrim

#: Characters at which a text may be cut besides white space (fixed values).
BREAKS = ".,;:!?…" + "。！？；：，、．।؟،؛"
#: Pieces that are placed anew where one is added.
BACK = 8
SENTENCE = ".!?…。！？．।؟"
CLAUSE = ";:；：؛"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in ascending order and their strengths, 1 (beside a comma) to 6 (blank line).

    A position p cuts between text[p - 1] and text[p]; both sides of white space and of a break character qualify.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    uniq, back = np.unique(cp, return_inverse=True)
    kind = np.array([4 if chr(c) in "\n\r\u2028\u2029" else 3 if chr(c).isspace() else 2 if chr(c) in SENTENCE else 1 if chr(c) in BREAKS else 0 for c in uniq], np.int8)[back]
    clause = np.array([chr(c) in CLAUSE for c in uniq])[back]
    n = len(cp)
    score = np.zeros(n + 1, np.int8)
    at = np.flatnonzero(kind)
    np.maximum.at(score, at, 1)
    after = at + 1
    np.maximum.at(score, after, 1)
    space = np.flatnonzero(kind >= 3) + 1
    np.maximum.at(score, space, 2)
    np.maximum.at(score, np.flatnonzero(clause) + 1, 3)
    # a sentence mark counts after the white space (if any) that follows it; so do line breaks
    wide = kind >= 3
    prev = np.arange(n)
    prev[wide] = -1
    prev = np.maximum.accumulate(prev)  # last character that is no white space
    ends = space[(space == n) | ~np.append(wide, False)[space]]  # where white space ends
    if len(ends):
        last = prev[ends - 1]
        good = last >= 0
        marks = np.zeros(len(ends), bool)
        marks[good] = kind[last[good]] == 2
        np.maximum.at(score, ends[marks], 4)
        breaks = np.concatenate([[0], np.cumsum(kind == 4)])
        lines = breaks[ends] - breaks[last + 1]
        np.maximum.at(score, ends[lines == 1], 5)
        np.maximum.at(score, ends[lines > 1], 6)
    full = np.flatnonzero(np.isin(cp, np.array([ord(c) for c in "。！？．।؟"], np.uint32))) + 1
    np.maximum.at(score, full, 4)
    score[0] = score[n] = 0
    pos = np.flatnonzero(score)
    return pos, score[pos]


def longest_stretch(pos: np.ndarray, n: int) -> int:
    """Longest stretch of an item of length ``n`` without any cut position inside."""
    return int(np.diff(np.concatenate([[0], pos, [n]])).max()) if n else 0


def _forced(text: str, p: int, least: int) -> int:
    """``p``, moved left off combining marks and joiners so that no grapheme is torn, but not below ``least``."""
    q = p
    while q > least and q < len(text) and (unicodedata.combining(text[q]) or text[q] in "\u200d\ufe0f" or text[q - 1] == "\u200d" or unicodedata.category(text[q]) in ("Mn", "Mc")):
        q -= 1
    return q if q > least else p


def pieces(text: str, limit: int = 512, overlap: int = 64) -> tuple[list[tuple[int, int, bool]], bool]:
    """Pieces (start, end, end is natural) of a trimmed text, and whether a stretch longer than ``limit`` forces cuts.

    The least number of pieces comes first, with equal-length targets; each target moves to the strongest boundary near
    it. Where a limit fails (what is left needs more pieces than are left), a piece is added and the last ``BACK`` pieces
    are placed anew, with equal-length targets for the rest of the text. So a hard passage of a long text adds pieces
    where it is, and every text ends after a number of steps in proportion to its length.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, True)], False
    pos, score = boundaries(text)
    need = lambda chars: 1 + max(0, -(-(chars - limit) // (limit - overlap)))
    near = max(8, int(limit * 0.15))
    out: list[tuple[int, int, bool]] = []
    starts, base, count = [0], 0, need(n)  # ``count`` pieces are planned from piece ``base`` on
    while True:
        i = len(out)
        start, end, left = starts[i], out[-1][1] if out else 0, count - (i - base)
        if n - start <= limit and left == 1:
            out.append((start, n, True))
            break
        if need(n - start) > left:
            back = max(base, i - BACK)
            base, count = back, count - (back - base) + 1
            del out[base:], starts[base + 1 :]
            continue
        most = min(start + limit, n - 1)
        least = max(end, start + overlap) + 1
        if least > most:
            out.append((start, n, True))
            break
        length = (n - starts[base] + (count - 1) * overlap) / count
        due = starts[base] + int(round(length * (i - base + 1) - (i - base) * overlap))
        target = max(least, min(due, most))
        # behind the targets, nearer boundaries are taken, so that the pieces catch up
        wide = max(8, near - max(0, due - target))
        lo, hi = np.searchsorted(pos, [max(least, target - wide), min(target + wide, most) + 1])
        if lo < hi:  # the strongest nearby, then the nearest
            p, s = pos[lo:hi], score[lo:hi]
            cut = int(p[np.lexsort((np.abs(p - target), -s.astype(int)))[0]])
        else:
            lo, hi = np.searchsorted(pos, [least, most + 1])
            cut = int(pos[lo:hi][np.argmin(np.abs(pos[lo:hi] - target))]) if lo < hi else 0
            if lo == hi and out and out[-1][2]:
                # a stretch that fits a piece by itself: less overlap rather than a torn stretch
                nxt = int(pos[hi]) if hi < len(pos) else n
                x, y = np.searchsorted(pos, [nxt - limit, end + 1])
                if x < y:
                    start = int(pos[x])
                    if nxt == n:
                        out.append((start, n, True))
                        break
                    cut = nxt
        natural = cut > 0
        if not natural:
            cut = _forced(text, target, least)
        out.append((start, cut, natural))
        lo, hi = np.searchsorted(pos, [cut - overlap, cut - overlap + overlap // 3 + 1])
        start = int(pos[lo]) if lo < hi else cut - overlap
        while lo == hi and start < cut - overlap + overlap // 3 and unicodedata.category(text[start]) in ("Mn", "Mc"):
            start += 1
        while start < cut and text[start].isspace() and start < cut - overlap + overlap // 3:
            start += 1
        starts.append(max(start, out[-1][0] + 1))
    return out, longest_stretch(pos, n) > limit


def split_oversized(df: DataFrame, keys: dict[str, Column], text: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """Pieces of every row whose trimmed ``text`` has more than ``limit`` code points.

    Result: the ``keys`` (name to expression), ``piece`` from 0, ``start_char``/``end_char`` in the stored text,
    ``text``, ``natural`` (the piece ends at a boundary or at the item's end) and ``cut`` of the whole item: 'forced' if
    a stretch longer than ``limit`` has no boundary, else 'natural'. Each piece repeats the last ``overlap`` characters
    of the piece before, or up to a third fewer to begin at a boundary (fewer still only where that keeps a stretch
    whole). Null, blank and short texts give no rows; repeated rows are split each; other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    d = df.select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("__text"))
    d = d.filter(F.char_length("__text") > limit).filter(F.char_length(utrim(F.col("__text"))) > limit)
    schema = T.StructType(
        [f for f in d.schema.fields if f.name != "__text"]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start_char", T.LongType()), ("end_char", T.LongType()), ("text", T.StringType()), ("natural", T.BooleanType()), ("cut", T.StringType()))]
    )
    names, used = [f.name for f in schema.fields], [*keys, "__text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, t in b[used].itertuples(index=False, name=None):
                off = len(t) - len(t.lstrip())
                body = t.strip()
                parts, forced = pieces(body, limit, overlap)
                rows += [(*key, i, off + s, off + e, body[s:e], nat, "forced" if forced else "natural") for i, (s, e, nat) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=names)

    return d.mapInPandas(run, schema)

"""Splitting oversized Markdown at natural boundaries.

Dynamic programming over boundary positions: each boundary has a penalty by its kind, each piece a penalty for how far
its length is from the limit's even share; the cheapest chain of cuts under the limit wins. The next piece
begins at most `overlap` characters before the cut, at the best boundary there is in that stretch.

Defined results: lengths are code points, white space included; null and empty content gives one empty piece (number 0,
content as it is); content within the limit is one piece; nothing is dropped: pieces without their overlaps are the
content; CRLF and grapheme clusters are only cut where a cluster alone is longer than the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.sources.tables import current_rows, table

LIMIT, OVERLAP = 768, 64
#: Penalties of cuts: before a heading, between blocks, between lines, after sentences, between words, between characters.
HEADING, BLOCK, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 0.0, 1.0, 3.0, 4.0, 8.0, 20.0, 60.0
#: Added inside code fences, frontmatter and tables.
INSIDE = 12.0
#: Places between characters, all alike, are taken this far apart.
GRID = 16
#: Weight of the squared share by which a piece differs from the mean piece.
BALANCE = 6.0

_HEADING = regex.compile(r" {0,3}#{1,6}(?:[ \t]|\r?$)")
_FENCE = regex.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_ROW = regex.compile(r"\s*\|.*\|\s*$")
_SENTENCE = regex.compile(r"[.!?…][\"'”’»)\]]*\s+(?=\S)|[。！？](?=\S)")
_CLAUSE = regex.compile(r"[,;:]\s+(?=\S)|[，；：、]\s*(?=\S)")
_WORD = regex.compile(r"\s+(?=\S)")
_CLUSTER = regex.compile(r"\X")


def boundaries(text: str, limit: int) -> dict[int, float]:
    return dict(zip(*(x.tolist() for x in marks(text, limit))))


def marks(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties of each place where text may be cut: every line, sentence, clause and word, and places between characters where those lie far apart."""
    at: dict[int, float] = {}
    inside: list[tuple[int, int]] = []
    pos, fence, opened, blank, table_start = 0, None, 0, False, None
    lines = regex.findall(r"[^\n]*\n|[^\n]+", text)
    front = bool(lines) and lines[0].lstrip("﻿").rstrip() == "---" and any(x.rstrip() == "---" for x in lines[1:])
    for i, line in enumerate(lines):
        bare = line.rstrip()
        row = fence is None and bool(_ROW.match(bare))
        if pos:
            if fence is None and _HEADING.match(line):
                at[pos] = HEADING
            else:
                at[pos] = BLOCK if blank else LINE
        if table_start is None and row:
            table_start = pos
        elif table_start is not None and not row:
            inside.append((table_start, pos))
            table_start = None
        if front:
            if i and bare == "---":
                inside.append((0, pos + len(line)))
                front = False
        elif m := _FENCE.match(bare):
            if fence is None and not (m[1][0] == "`" and "`" in m[2]):
                fence, opened = m[1], pos
            elif fence and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                inside.append((opened, pos + len(line)))
                fence = None
        blank = not bare
        pos += len(line)
    if fence:
        inside.append((opened, pos))
    if table_start is not None:
        inside.append((table_start, pos))
    found = [list(at)] + [[m.end() for m in p.finditer(text)] for p in (_SENTENCE, _CLAUSE, _WORD)]
    kinds = np.repeat([0.0, SENTENCE, CLAUSE, WORD], list(map(len, found)))
    kinds[: len(at)] = list(at.values())
    places, first = np.unique(np.array([p for f in found for p in f], np.int64), return_index=True)  # the first kind of a place counts
    penalty = kinds[first]
    for a, b in inside:
        penalty[np.searchsorted(places, a, "right") : np.searchsorted(places, b)] += INSIDE
    edges = np.concatenate([[0], places, [len(text)]])
    more: dict[int, float] = {}
    for k in np.flatnonzero(np.diff(edges) > GRID).tolist():  # a long run without any boundary
        a, b = int(edges[k]), int(edges[k + 1])
        last = a
        for m in _CLUSTER.finditer(text, a, b):
            if last < m.end() < b and m.end() - last >= GRID:
                last = m.end()
                more[last] = CHARACTER
    if more:
        places, penalty = _with(places, penalty, more)
    edges = np.concatenate([[0], places, [len(text)]])
    wide = np.flatnonzero(np.diff(edges) > limit - limit // 4)
    if len(wide):  # a cluster longer than the limit
        places, penalty = _with(places, penalty, {p: 10 * CHARACTER for k in wide.tolist() for p in range(int(edges[k]) + limit // 2, int(edges[k + 1]), limit // 2)})
    within = (places > 0) & (places < len(text))
    return places[within], penalty[within]


def _with(places: np.ndarray, penalty: np.ndarray, more: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    out, first = np.unique(np.concatenate([places, np.array(list(more), np.int64)]), return_index=True)
    return out, np.concatenate([penalty, list(more.values())])[first]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    places, penalty = marks(text, limit)
    places, penalty = np.concatenate([[0], places, [len(text)]]), np.concatenate([[0.0], penalty, [0.0]])
    n = len(places)
    mean = len(text) / -(-(len(text)) // (limit - overlap))
    begin = overlap_starts(text, places, penalty, overlap)  # never decreases, so the window of pieces within the limit only moves on
    lows = np.searchsorted(begin, places - limit).tolist()
    # a piece from begin[j] to end costs cost[j] + BALANCE ((end - begin[j] - mean) / mean)^2; without what is alike for all j:
    scale, ends, pay = BALANCE / mean**2, places.tolist(), penalty.tolist()
    away = begin + mean
    base, back = np.full(n, np.inf), [0] * n
    base[0] = scale * away[0] ** 2
    own = (scale * away**2).tolist()
    for i in range(1, n):
        low, end = lows[i], ends[i]
        if low < i:
            x = base[low:i] - (2 * scale * end) * away[low:i]
            j = int(x.argmin())
            base[i] = x[j] + scale * end * end + pay[i] + own[i]
            back[i] = low + j
    start, places = begin.tolist(), ends
    out, i = [], n - 1
    while i:
        j = back[i]
        out.append((start[j], places[i]))
        i = j
    return out[::-1]


def overlap_starts(text: str, places: np.ndarray, penalty: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after a cut at each place begins: a line or sentence that leaves at least half of the overlap, else the earliest
    word within the overlap, else the earliest cluster; the cut itself if a cluster fills the overlap."""
    out = places.copy()
    out[0] = 0
    strong = np.flatnonzero(penalty[1:-1] < WORD) + 1
    theirs, costs = places[strong], penalty[strong]
    low, high = np.searchsorted(theirs, places - overlap), np.searchsorted(theirs, places - overlap // 2, "right")
    best = np.full(len(places), np.inf)
    for k in range(int((high - low).max(initial=0))):
        of = np.flatnonzero(low + k < high)
        cost = costs[low[of] + k]
        better = cost < best[of]
        best[of[better]], out[of[better]] = cost[better], theirs[low[of[better]] + k]
    words = np.array([m.end() for m in _WORD.finditer(text)], np.int64)
    none = np.isinf(best)
    first = np.searchsorted(words, np.maximum(1, places - overlap))
    word = np.append(words, len(text) + 1)[first]
    found = none & (word < places)
    out[found] = word[found]
    bare = none & ~found
    bare[[0, -1]] = False
    if overlap and bare.any():
        a, b = int(places[bare].min()), int(places[bare].max())
        clusters = np.array([m.start() for m in _CLUSTER.finditer(text, max(0, a - 2 * overlap), b)], np.int64)
        start = np.append(clusters, len(text) + 1)[np.searchsorted(clusters, np.maximum(1, places - overlap))]
        inner = bare & (start < places)
        out[inner] = start[inner]
    out[0] = 0
    return np.maximum.accumulate(out)


_PIECES = "array<struct<piece:int,start_char:int,end_char:int,overlap_chars:int,content:string>>"


def pieces_of(limit: int, overlap: int):
    def run(contents: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            got, prev = [], 0
            for k, (a, b) in enumerate(cuts(text, limit, overlap)):
                got.append({"piece": k, "start_char": a, "end_char": b, "overlap_chars": prev - a if k else 0, "content": text[a:b]})
                prev = b
            return got

        return contents.map(one)

    return F.pandas_udf(run, _PIECES)


def split(rows: DataFrame, key: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_pieces, piece, start_char, end_char, overlap_chars, content). Only oversized rows go through Python."""
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be between 0 and a quarter of the limit")
    rows = rows.select(F.col(key), F.col(content).alias("_c"))
    size = F.coalesce(F.length("_c"), F.lit(0))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("start_char"), size.alias("end_char"), F.lit(0).alias("overlap_chars"), F.col("_c").alias("content")))
    small = rows.filter(size <= limit).select(key, whole.alias("_p"))
    large = rows.filter(size > limit).select(key, pieces_of(limit, overlap)("_c").alias("_p"))
    out = small.unionByName(large)
    return out.select(key, F.size("_p").alias("n_pieces"), F.explode("_p").alias("_x")).select(key, "n_pieces", "_x.*")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every live chunk."""
    now = current_rows(table(spark, folder, "chunks"), "content").withColumnRenamed("id", "chunk_id")
    return split(now, "chunk_id", "content")


def lossless(spark: SparkSession, folder: str) -> DataFrame:
    """Of each live chunk: the text that its pieces give without their overlaps, whether they keep the limit and the overlap, and whether there are several."""
    p = pieces(spark, folder)
    part = F.coalesce(F.substring("content", F.col("overlap_chars") + 1, F.lit(2**31 - 1)), F.lit(""))
    per = p.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", part.alias("part")))).alias("ps"), F.max(F.length("content")).alias("longest"), F.max("overlap_chars").alias("most"), F.count("*").alias("n"))
    text = F.array_join(F.transform("ps", lambda x: x["part"]), "")
    return per.select("chunk_id", F.md5(F.encode(text, "UTF-8")).alias("rebuilt"), (F.coalesce("longest", F.lit(0)) <= LIMIT).alias("within_limit"), F.col("most").between(0, OVERLAP).alias("within_overlap"), (F.col("n") > 1).alias("cut"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, folder).filter("piece = 0 and n_pieces > 1").select("chunk_id")

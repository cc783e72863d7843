"""Markdown chunks: cut at every heading, then split what exceeds the token budget.

No expression language can track fences and quotes, so a line scanner runs in an Arrow-batched UDF; one file is one row,
so files are chunked independently and in parallel.

A cascade applies to a section over floor(margin * budget) tokens: paragraphs (after each blank-line pair outside of
code and tables), each a chunk of its own; a paragraph over budget that touches code or a table stays whole
(status 'protected'); else sentences; a sentence over budget is cut after budget * CHARS_PER_TOKEN characters.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmill.schemas import BUDGET_MARGIN, CHARS_PER_TOKEN

_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_CONTAINER = re.compile(r"(?: {0,3}>[ ]?| {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]{1,4}|$))")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def scan(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Offsets of headings (ATX and setext, also in quotes and lists) and spans of code blocks and tables."""
    headings: list[int] = []
    spans: list[tuple[int, int]] = []
    fence, opened = None, 0
    para: int | None = None  # where the open paragraph begins
    indented: int | None = None
    table: int | None = None
    prev, pos = "", 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare, end = line.rstrip("\r\n"), pos + len(line)
        body, at = bare, pos
        if fence is None:
            while (m := _CONTAINER.match(body)) and not _BREAK.match(body):
                body, at = body[m.end() :], at + m.end()
        stripped = body.strip()
        if table is not None and (not stripped or "|" not in body):
            spans.append((table, pos))
            table = None
        if fence is not None:
            m = _FENCE.match(bare.lstrip("> "))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                spans.append((opened, end))
                fence = None
        elif (m := _FENCE.match(body)) and not (m[1][0] == "`" and "`" in m[2]):
            fence, opened, para = m[1], pos, None
        elif (body.startswith("    ") or body.startswith("\t")) and stripped and para is None and table is None:
            indented = pos if indented is None else indented
        else:
            if indented is not None and stripped:
                spans.append((indented, pos))
                indented = None
            if _ATX.match(body):
                headings.append(at)
                para = None
            elif para is not None and _SETEXT.match(body) and stripped:
                headings.append(para)
                para = None
            elif not stripped or _BREAK.match(body):
                para = None
            elif table is None and "|" in prev and "-" in body and _DELIMITER.match(body) and body.count("|") and para is not None:
                table, para = prev_at, None
            elif table is None and para is None:
                para = at
        prev, prev_at, pos = body, pos, end
    for start in (opened if fence is not None else None, indented, table):
        if start is not None:
            spans.append((start, len(text)))
    return headings, sorted(spans)


def tokens(text: str) -> int:
    return -(-len(text) // CHARS_PER_TOKEN)


def sections(text: str) -> list[tuple[int, int]]:
    headings, _ = scan(text)
    cuts = sorted({0, len(text), *headings})
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]


def budgeted(text: str, budget: int, margin: float = BUDGET_MARGIN) -> list[tuple[str, str]]:
    """(content, how) of each chunk of one section."""
    most = math.floor(budget * margin)
    if tokens(text) <= most:
        return [(text, "section")]
    _, spans = scan(text)
    cuts = {0, len(text)}
    cuts |= {i + 2 for i in (m.start() for m in re.finditer(r"(?=\n\n)", text)) if not any(a < i + 2 < b for a, b in spans)}
    out: list[tuple[str, str]] = []
    order = sorted(cuts)
    for a, b in zip(order, order[1:]):
        part = text[a:b]
        if not part.strip():
            continue
        if tokens(part) <= most:
            out.append((part, "paragraph"))
        elif any(s < b and a < e for s, e in spans):
            out.append((part, "protected"))
        else:
            for sentence in re.split(r"(?<=[.!?])(?=[ \t\n\r\f])", part):
                if not sentence.strip():
                    continue
                if tokens(sentence) <= most:
                    out.append((sentence, "sentence"))
                else:
                    size = max(1, most * CHARS_PER_TOKEN)
                    out += [(sentence[i : i + size], "hard cut") for i in range(0, len(sentence), size) if sentence[i : i + size].strip()]
    return out


_CHUNKS = "array<struct<ordinal:int,content:string,how:string>>"


def chunker(budget: int | None, margin: float = BUDGET_MARGIN):
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            if not text:
                return []
            parts = [text[a:b] for a, b in sections(text)]
            cut = [x for p in parts for x in (budgeted(p, budget, margin) if budget else [(p, "section")])]
            return [{"ordinal": i, "content": c, "how": h} for i, (c, h) in enumerate(cut)]

        return texts.map(one)

    return F.pandas_udf(run, _CHUNKS)


def chunk(files: DataFrame, key: str, text: str, budget: int | None = None, margin: float = BUDGET_MARGIN) -> DataFrame:
    """(key, ordinal, content, how, tokens). Null, empty and blank files give no chunk; blank sections are dropped."""
    out = files.select(F.col(key), F.explode(chunker(budget, margin)(F.col(text))).alias("c")).select(key, "c.*")
    return out.withColumn("tokens", F.ceil(F.char_length("content") / CHARS_PER_TOKEN))

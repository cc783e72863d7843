"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is cut at single spaces into stretches, those into words by the vocabulary's pattern; each distinct stretch and
word of a worker is encoded once. New words are
encoded together: rows of padded numpy matrices, bucketed by length; in every round each row merges its leftmost pair
of least rank, found in a hash table of all pairs whose concatenation is a token; finished rows leave the matrix.

Defined results: null and empty texts give an empty list; special-token strings in a text are ordinary text; repeated
rows are each encoded; texts may be of any length (words above LONG bytes are merged with a heap, with the same result).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words longer than this many bytes are merged with a heap, as a matrix would cost the square of their length.
LONG = 256
#: Stands for spaces in longer runs of white space while a text is cut; a text that contains it is one stretch.
HOLD = "\U000F0001"
_RUN = regex.compile(r"\s{2,}")
#: Distinct stretches that a worker remembers; beyond that it starts afresh. Only speed depends on it.
REMEMBERED = 1_000_000
NEVER = np.int32(2**31 - 1)
_BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id (= rank) of their concatenation."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.plain = pairs
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(4, int(len(pairs)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << bits, NEVER, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.values[at[todo]] == NEVER]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self.MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER where there is none (or an id is negative, as in padding)."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NEVER)
        left = np.flatnonzero((out == NEVER) & (self.values[at] != NEVER))
        for _ in range(self.probes):
            if not len(left):
                break
            slot = (at[left] + 1) & self.mask
            at[left] = slot
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (self.values[slot] != NEVER)]
        out[(a < 0) | (b < 0)] = NEVER
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.token_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pairs = PairTable(self.token_of)
        self.byte = np.array([self.token_of[bytes([i])] for i in range(256)], np.int32)
        self.words = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.word_ids: dict[str, np.ndarray] = {}
        self.known: dict[str, int] = {}
        self.first: dict[str | tuple[str], int] = {}
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Encodes words of at most width bytes in one padded matrix."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        m = np.full((n, width), -1, np.int32)
        m[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        r = self.pairs.ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.empty((n, 0), np.int32)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        rows = np.arange(n)
        while len(rows):
            col = r.argmin(axis=1) if r.shape[1] else np.zeros(len(rows), np.int64)
            best = r[np.arange(len(rows)), col] if r.shape[1] else np.full(len(rows), NEVER, np.int32)
            over = best == NEVER
            if over.any():  # compaction: finished rows leave
                for i in np.flatnonzero(over):
                    row = m[i]
                    out[rows[i]] = row[row >= 0].copy()
                keep = ~over
                rows, m, r, col, best = rows[keep], m[keep], r[keep], col[keep], best[keep]
                if not len(rows):
                    break
                live = int((m >= 0).sum(axis=1).max())
                if live < m.shape[1]:
                    m, r = m[:, :live], r[:, : live - 1]
            k = np.arange(len(rows))
            cols = np.arange(m.shape[1])
            take = cols + (cols > col[:, None])  # the right half of the pair goes, what follows moves up
            padded = np.concatenate([m, np.full((len(rows), 1), -1, np.int32)], axis=1)
            m = np.take_along_axis(padded, take, axis=1)
            m[k, col] = best
            rcols = np.arange(r.shape[1])
            rpad = np.concatenate([r, np.full((len(rows), 1), NEVER, np.int32)], axis=1)
            r = np.take_along_axis(rpad, rcols + (rcols >= col[:, None]), axis=1)
            has = col < r.shape[1]
            nxt = np.where(has, m[k, np.minimum(col + 1, m.shape[1] - 1)], -1)
            r[k[has], col[has]] = self.pairs.ranks(m[k, col], nxt)[has]
            left = col > 0
            r[k[left], col[left] - 1] = self.pairs.ranks(m[k[left], col[left] - 1], m[k[left], col[left]])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(ids), self.pairs.plain.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (x := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (x, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, stretches: list[str]) -> None:
        """Encodes new stretches, their new words together, and remembers both."""
        cut = [self.words.findall(x) for x in stretches]
        new = list({w: None for words in cut for w in words if w not in self.word_ids})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            whole = self.token_of.get(w)
            if whole is not None:
                self.word_ids[new[i]] = np.array([whole], np.int32)
            elif len(w) > LONG:
                self.word_ids[new[i]] = self.merge_long(w)
            else:
                buckets.setdefault(next(b for b in _BUCKETS if b >= len(w)), []).append(i)
        for width, members in buckets.items():
            step = max(1, 4_000_000 // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                for i, ids in zip(part, self.merge_rows([raw[i] for i in part], width)):
                    self.word_ids[new[i]] = ids
        pieces = [self.word_ids[w] for words in cut for w in words]
        flat = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
        word_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        ends = word_ends[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.ids = np.concatenate([self.ids, flat])

    def stretches(self, text: str) -> list[str]:
        """A text cut before every single space between other characters than white space. The pattern never joins
        words across such a space, and gives it to the word that follows; so stretches can be encoded one by one."""
        if HOLD in text:
            return [text]
        return _RUN.sub(lambda m: m[0].replace(" ", HOLD), text).split(" ")

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each)."""
        if len(self.known) + len(self.first) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self._forget()
        numbers, counts, pending = [], [], []
        known, first = self.known, self.first
        base = len(self.ends) - 1
        for text in texts:
            parts = self.stretches(text) if text else []
            counts.append(len(parts))
            if not parts:
                continue
            head = parts[0] if HOLD not in text else (text,)
            if head not in first:
                first[head] = base + len(pending)
                pending.append(text if HOLD in text else head.replace(HOLD, " "))
            numbers.append(np.array([first[head]], np.int64))
            rest = parts[1:]
            try:
                got = np.fromiter(map(known.__getitem__, rest), np.int64, len(rest))
            except KeyError:
                for p in rest:
                    if p not in known:
                        known[p] = base + len(pending)
                        pending.append(" " + p.replace(HOLD, " "))
                got = np.fromiter(map(known.__getitem__, rest), np.int64, len(rest))
            numbers.append(got)
        if pending:
            self.learn(pending)
        at = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        lengths = self.ends[at + 1] - self.ends[at]
        total = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        ids = self.ids[np.repeat(self.ends[at] - starts, lengths) + np.arange(total)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        return ids, ends

    def sizes(self, texts: Iterable[str | None]) -> np.ndarray:
        _, ends = self.encode(texts)
        return np.diff(ends)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


#: Texts are encoded in steps of about so many characters, which bounds a worker's memory.
STEP_CHARS = 4_000_000


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= STEP_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row of df; other columns aren't read."""
    default = default_vocabulary() if path is None or pattern is None else ("", "")
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in _steps(texts):
                ids, ends = enc.encode(texts[s:e])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), lists], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")

"""Garbled text from a wrong character encoding: found and restored by expectation-maximisation over encoding chains.

A chain says how text was garbled: bytes of one encoding read as another, once or several times. Evidence lies in tokens,
runs without ASCII white space that hold other than ASCII characters, outside of inline code (which may cite garbled text).

1. One pass over the documents gives each distinct token and which documents hold it; what any chain makes of a token is
   found once, as no model enters it.
2. A character model (bigrams of characters, case changes, frequencies of ideographs) is counted over all tokens into
   tables of fixed size, which bounds what is sent to workers. All restorations are weighed anew under the model of each round.
3. E-step: a document is clean or garbled by one latent chain, with the prior that its source has for each chain. Under
   a chain, a token is garbled with probability e^-TOKEN_COST, so its evidence is log(1 - p + p e^gain): weak evidence counts
   a little, and a source's many records with little evidence each add up in the prior. The posterior runs
   over all chains and `clean` together. Replacement characters are a chain of their own (bytes were lost), with fixed evidence.
4. M-step: priors of chains by source, shrunk to those of all sources; the character model is counted with each token moved
   to what it was, by its posterior. Rounds end when the expected number of affected documents moves by less than TOLERANCE.
5. A document is affected if `clean` has less than half of its posterior. Repair is a mixture within the document: every
   token chooses among all chains and `as it is`, weights of chains being fitted to the document's tokens.

Defined results: null, empty and ASCII texts are not affected; texts are processed whole; repeated texts are each
judged by their own source; null sources form one source, null languages one language; restored text is null if none of it could be restored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.session import Scratch
from cairnmill.sources.tables import table

#: Garbling hits about one token in e^3 of an affected text.
TOKEN_COST = 3.0
#: Prior probability that a document is affected by a given chain, before anything is known, and weight of the pooled estimate in documents.
START, SHRINK = 1e-4, 50.0
#: Rounds end when the expected number of affected documents moves by less than this share (or half a document); MOST_ROUNDS only guards against endless rounds.
TOLERANCE, MOST_ROUNDS = 0.002, 30
#: Evidence added where UTF-8 restores a byte-order mark: only an encoding puts one there; and of a replacement character, which only decoders write.
MARK, LOSS = 8.0, 20.0
#: Restorations less likely than this log-ratio before languages are weighed aren't listed; each would count for between 0 and -0.05.
LEAST = -4.0
#: Parts of hot tokens in joins; restorations that are sent to all workers, at most (about 100 bytes each).
SALTS, SENT = 8, 300_000
BITS = 20

_TOKEN = regex.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*")
_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)[^`\n]+\1(?!`)")
_EDGE = "“”‘’«»„…–—·()[]{}.,;:!?*_#|\"'<>/（）。、，：；"

#: Encodings that text is written in and wrongly read in (fixed names of Python's codecs).
SINGLE = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "mac_cyrillic")
READ_AS = ("latin_1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "iso8859_2")
DOUBLE = ("gbk", "cp932", "euc_jp", "big5", "euc_kr")
ALSO = (("utf_8", "gbk"), ("utf_8", "cp932"), ("utf_8", "big5"), ("utf_8", "euc_kr"), ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "big5"), ("big5", "gbk"))


def _byte_of(name: str) -> dict[int, int]:
    """Code point -> byte of a single-byte encoding; bytes that it leaves undefined pass as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


class Chain:
    """Undoes one way of garbling."""

    def __init__(self, true: str, read: str, times: int = 1):
        self.name, self.true, self.read, self.times = f"{true} as {read}" + (f" x{times}" if times > 1 else ""), true, read, times
        self.bytes = _byte_of(read) if read not in DOUBLE else None
        self.lead = self.table = None
        if self.bytes is not None:
            chars = "".join(map(chr, self.bytes))
            if true == "utf_8":
                by = {lo: "".join(regex.escape(c) for c in chars if lo <= self.bytes[ord(c)] <= hi) for lo, hi in ((0x80, 0xBF), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))}
                more = f"[{by[0x80]}]"
                self.lead = regex.compile(f"[{by[0xC2]}]{more}|[{by[0xE0]}]{more}{{2}}|[{by[0xF0]}]{more}{{3}}")
            elif true not in DOUBLE:
                self.table = {}
                for cp, b in self.bytes.items():
                    try:
                        self.table[cp] = bytes([b]).decode(true)
                    except UnicodeDecodeError:
                        self.table[cp] = None
            self.plain = {cp: chr(b) for cp, b in self.bytes.items()}
            self.chars = frozenset(c for c in chars if self.table is None or self.table[ord(c)])

    def undo(self, token: str) -> str | None:
        """What the token was before, None if it can't have been garbled this way."""
        if self.bytes is not None and self.lead is None and not all(c in self.chars for c in token if c > "\x7f"):
            return None
        out = token
        for _ in range(self.times):
            new = self._once(out)
            if new is None or new == out:
                return None
            out = new
        return out

    def _once(self, token: str) -> str | None:
        if self.lead is not None:  # valid sequences anywhere in the token
            def whole(m: regex.Match) -> str:
                try:
                    return m[0].translate(self.plain).encode("latin_1").decode("utf_8")
                except UnicodeError:
                    return m[0]

            return self.lead.sub(whole, token)
        if self.bytes is not None:
            if self.table is not None:
                return token.translate(self.table)
            try:
                return token.translate(self.plain).encode("latin_1").decode(self.true)
            except UnicodeError:
                return None
        try:
            return token.encode(self.read).decode(self.true)
        except UnicodeError:
            return None


_chains: list[Chain] = []


def chains() -> list[Chain]:
    """All chains, made once in each process; a chain's number is its place."""
    if not _chains:
        made = [Chain("utf_8", r) for r in READ_AS] + [Chain("utf_8", r, n) for r in ("latin_1", "cp1252") for n in (2, 3)]
        made += [Chain(t, r) for t in SINGLE for r in READ_AS if t != r]
        made += [Chain(t, r) for t in DOUBLE for r in ("latin_1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman")]
        made += [Chain(t, r) for t, r in ALSO]
        _chains.extend(made)
    return _chains


# ---- the character model


def _symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its symbol (lower case; ideographs and syllables by class, rare scripts by block), case, and class size of pooled symbols."""
    cp = np.arange(0x110000)
    sym = np.where(cp < 0x2E80, cp, 0x4000 + (cp >> 8))
    size = np.where(cp < 0x2E80, 1, 256)
    case = np.zeros(len(cp), np.int64)
    for c in range(0x2E80):
        ch = chr(c)
        low = ch.lower()
        if len(low) == 1:
            sym[c] = ord(low)
        case[c] = 1 if ch.isupper() else 2 if ch.islower() else 0
    for lo, hi, s in ((0x3041, 0x3097, 0x3F01), (0x30A0, 0x3100, 0x3F02), (0x3400, 0x4DC0, 0x3F03), (0x4E00, 0xA000, 0x3F03), (0xAC00, 0xD7A4, 0x3F04)):
        sym[lo:hi], size[lo:hi] = s, hi - lo
    for lo, hi in ((0x3000, 0x3041), (0xFE00, 0xFF60)):
        sym[lo:hi], size[lo:hi] = np.arange(lo, hi) & 0x3FFF | 0x8000, 1
    return sym.astype(np.int64), case, size.astype(np.float64)


_sym: list = []


def symbols():
    if not _sym:
        _sym.extend(_symbols())
    return _sym


def _flat(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all tokens, each between spaces, and where each begins."""
    cp = np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    return cp, np.concatenate([[0], np.cumsum(lengths)])


_MASK = (1 << BITS) - 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1_000_003 + b) * 2_654_435_761 >> 7) & _MASK


#: Kinds of counts: pairs of symbols, symbols, pooled characters, changes of case.
PAIRS, ONES, POOLED, CASES = 0, 1, 2, 3


def count(tokens: list[str], weights: np.ndarray) -> dict[int, np.ndarray]:
    """Weighted counts of tokens, in arrays of fixed size."""
    out = {PAIRS: np.zeros(1 << BITS), ONES: np.zeros(1 << 16), POOLED: np.zeros(1 << BITS), CASES: np.zeros(9)}
    if not tokens:
        return out
    sym, case, size = symbols()
    cp, starts = _flat(tokens)
    w = np.repeat(weights, np.diff(starts))
    s, k = sym[cp], case[cp]
    out[PAIRS] += np.bincount(_pair(s[:-1], s[1:]), w, 1 << BITS)
    out[ONES] += np.bincount(s[1:], w, 1 << 16)
    pooled = size[cp[1:]] > 1
    out[POOLED] += np.bincount((cp[1:] * 2_654_435_761 >> 5 & _MASK)[pooled], w[pooled], 1 << BITS)
    out[CASES] += np.bincount(k[:-1] * 3 + k[1:], w, 9)
    return out


def _sparse(counts: dict[int, np.ndarray]) -> dict:
    return {k: (len(x), (i := np.flatnonzero(x)).astype(np.int32), x[i]) for k, x in counts.items()}


_models: dict = {}


def model_of(sent) -> Model:
    """The model of a broadcast, built once in each worker from the counts that aren't zero."""
    if sent.value is not _models.get("counts"):
        counts = {}
        for k, (n, i, x) in sent.value.items():
            counts[k] = np.zeros(n)
            counts[k][i] = x
        _models.update(counts=sent.value, model=Model(counts))
    return _models["model"]


class Masks:
    """For each character, the chains (as bits) that it allows: rules out nearly all chains for a token by a few lookups."""

    def __init__(self):
        made = chains()
        self.single: dict[str, int] = {}
        self.lead: dict[str, int] = {}
        self.more: dict[str, int] = {}
        self.reads: dict[str, int] = {}  # encodings that text was read in without a table
        for z, c in enumerate(made):
            if c.bytes is None:
                self.reads[c.read] = self.reads.get(c.read, 0) | 1 << z
            elif c.lead is not None:
                for cp, b in c.bytes.items():
                    side = self.more if b <= 0xBF else self.lead if 0xC2 <= b <= 0xF4 else None
                    if side is not None:
                        side[chr(cp)] = side.get(chr(cp), 0) | 1 << z
            else:
                for ch in c.chars:
                    self.single[ch] = self.single.get(ch, 0) | 1 << z
        self.encodes: dict[str, int] = {}

    def _encodable(self, ch: str) -> int:
        out = 0
        for name, bits in self.reads.items():
            try:
                ch.encode(name)
                out |= bits
            except UnicodeError:
                pass
        self.encodes[ch] = out
        return out

    def of(self, token: str) -> int:
        """Chains that may undo the token."""
        all_single = all_read = -1
        pairs = before = 0
        single, lead, more, encodes = self.single.get, self.lead.get, self.more.get, self.encodes.get
        for ch in token:
            if ch < "\x80":
                before = 0
                continue
            all_single &= single(ch, 0)
            got = encodes(ch)
            all_read &= self._encodable(ch) if got is None else got
            if before:
                pairs |= before & more(ch, 0)
            before = lead(ch, 0)
        return all_single | all_read | pairs if all_single != -1 else 0


_masks: list[Masks] = []


def undone(tokens: list[str]) -> tuple[list[int], list[int], list[str]]:
    """(token number, chain number, restored token) wherever a chain can undo a token, or what stands between its quotes."""
    if not _masks:
        _masks.append(Masks())
    masks, made = _masks[0], chains()
    at, which, restored = [], [], []
    for i, t in enumerate(tokens):
        if "�" in t:
            at.append(i)
            which.append(len(made))
            restored.append(t)
            continue
        core = t.strip(_EDGE)
        for part in (t, core) if core and len(core) < len(t) else (t,):  # garbled between proper quotes
            left = masks.of(part)
            while left:
                low = left & -left
                left ^= low
                z = low.bit_length() - 1
                if (o := made[z].undo(part)) is not None and o != part:
                    at.append(i)
                    which.append(z)
                    restored.append(o if part is t else t.replace(core, o, 1))
    return at, which, restored


class Model:
    def __init__(self, counts: dict[int, np.ndarray]):
        self.pairs, self.ones, self.pooled, cases = (counts[k] for k in (PAIRS, ONES, POOLED, CASES))
        self.total = self.ones.sum()
        cases = cases.reshape(3, 3)
        self.cases = np.log((cases + 1) / (cases.sum(axis=1, keepdims=True) + 3)).ravel()

    def parts(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each character after the one before, and where tokens begin."""
        sym, case, size = symbols()
        cp, starts = _flat(tokens)
        s, k, n = sym[cp], case[cp], size[cp[1:]]
        base = (self.ones[s[1:]] + 0.05) / (self.total + 1000)
        p = np.log((self.pairs[_pair(s[:-1], s[1:])] + 2 * base) / (self.ones[s[:-1]] + 2))
        pooled = n > 1
        if pooled.any():
            p[pooled] += np.log((self.pooled[cp[1:][pooled] * 2_654_435_761 >> 5 & _MASK] + 0.1) / (self.ones[s[1:][pooled]] + 0.1 * n[pooled]))
        return p + self.cases[k[:-1] * 3 + k[1:]], starts[:-1]

    def scores(self, tokens: list[str]) -> np.ndarray:
        return np.add.reduceat(*self.parts(tokens)) if tokens else np.empty(0)

    def gains(self, tokens: list[str], at: np.ndarray, which: np.ndarray, restored: list[str], least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(token number, chain number, log-likelihood ratio, restored token): the best restoration of each token and chain, if its ratio exceeds `least`."""
        place = {o: k for k, o in enumerate(dict.fromkeys(restored))}  # chains often agree
        gain = self.scores(list(place))[[place[o] for o in restored]] - self.scores(tokens)[at] if len(at) else np.empty(0)
        for k, (z, o) in enumerate(zip(which, restored)):
            if o[0] == "\ufeff" and z < len(chains()) and chains()[z].true == "utf_8":
                gain[k] += MARK
        gain[which == len(chains())] = LOSS
        order = np.lexsort((-gain, which, at))
        first = np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(which[order]) != 0)]) if len(at) else np.empty(0, bool)
        keep = order[first & (gain[order] > least)] if len(at) else order
        return at[keep], which[keep], gain[keep], [restored[i] for i in keep]


# ---- over documents


def token_number(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: Scripts that tokens are told apart by (fixed names of Unicode scripts); others and mere symbols have numbers of their own.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")
_SCRIPT = regex.compile("|".join(rf"((?=[^\x00-\x7f])\p{{Script={s}}})" for s in SCRIPTS) + r"|((?=[^\x00-\x7f])\p{L})")


def script_of(token: str) -> int:
    """The script of the first letter beyond ASCII; 0 for none."""
    m = _SCRIPT.search(token)
    return m.lastindex if m else 0


def tokens_of(text: str) -> set[str]:
    """Distinct tokens outside of inline code: what _TOKEN finds, without a pattern's cost."""
    if "`" in text:
        text = _CODE.sub(" ", text)
    return {w for w in text.translate(_SPACES).split(" ") if not w.isascii()}


_SPACES = {9: " ", 10: " ", 13: " "}


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, lang, source, token number, script, token or null): distinct tokens of each document; a token's text is written once a task.

    Works on the bytes of a whole batch: positions beyond ASCII, widened to the white space around them.
    """
    code: dict[bytes, int] = {}
    numbers, scripts, texts, lost = [], [], [], []

    def learn(raw: bytes) -> int:
        t = raw.decode("utf-8", "replace")
        if "�" in t:
            t = "�"
            if lost:
                code[raw] = lost[0]
                return lost[0]
            lost.append(len(numbers))
        if t.isspace():  # no more than a wide or hard space
            code[raw] = -1
            return -1
        code[raw] = got = len(numbers)
        numbers.append(token_number(t))
        scripts.append(script_of(t))
        texts.append(t)
        return got

    for b in batches:
        column = b.column(1)
        cited = pc.fill_null(pc.match_substring(column, "`"), False)
        plain = pa.array(~cited.to_numpy(zero_copy_only=False))
        parts = ((plain, column.filter(plain)), (cited, pa.array([_CODE.sub(" ", t) for t in column.filter(cited).to_pylist()], pa.string())))
        for chosen, part in parts:
            part = part.fill_null("")
            if not len(part):
                continue
            rows = np.flatnonzero(chosen.to_numpy(zero_copy_only=False))
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            data = part.buffers()[2]
            if data is None or ends[-1] == ends[0]:
                continue
            raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            beyond = np.flatnonzero(raw >= 0x80)
            if not len(beyond):
                continue
            space = _IS_SPACE[raw]
            breaks = space.copy()
            breaks[ends[:-1][ends[:-1] < len(raw)]] = True  # a document's first byte
            at = np.flatnonzero(breaks)
            token = np.unique(np.searchsorted(at, beyond, "right"))
            start = at[token - 1]
            doc = np.searchsorted(ends, start, "right") - 1
            start = start + space[start]
            end = np.append(at, len(raw))[token]
            whole, get, before = raw.tobytes(), code.get, len(numbers)
            codes = []
            for x, y in zip(start.tolist(), end.tolist()):
                k = get(w := whole[x:y])
                codes.append(learn(w) if k is None else k)
            codes = np.array(codes, np.int64)
            pairs = np.unique((doc << 32 | codes)[codes >= 0])
            doc, codes = rows[pairs >> 32], pairs & 0xFFFFFFFF
            some, first = np.unique(codes, return_index=True)
            new = first[some >= before]
            text = np.full(len(codes), None, object)
            text[new] = [texts[k] for k in codes[new]]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(np.array(numbers, np.int64)[codes]), pa.array(np.array(scripts, np.int32)[codes]), pa.array(text, pa.string())],
                names=["doc", "lang", "source", "t", "script", "token"],
            )
        if len(code) > 500_000:
            code.clear()
            for x in (numbers, scripts, texts, lost):
                x.clear()


_IS_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero counts of (token, weight) rows, one set for each partition."""
    total = None
    for b in batches:
        got = count(b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64))
        total = got if total is None else {k: total[k] + got[k] for k in got}
    for k, x in (total or {}).items():
        i = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int64()), pa.array(x[i], pa.float64())], names=["kind", "i", "n"])


def _evidence(gain: Column) -> Column:
    """log(1 - p + p e^gain) with p = e^-TOKEN_COST."""
    p = float(np.exp(-TOKEN_COST))
    return F.when(gain > 30, gain - TOKEN_COST).otherwise(F.log1p(p * F.expm1(F.least(gain, F.lit(30.0)))))


class Garbled:
    """documents: (doc, text, source, lang). judged: (doc, source, lang, odds, zs); see found() and repaired()."""

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        scratch = Scratch(spark)
        keep = scratch.keep  # short plans: the driver's memory doesn't grow with the rounds
        self.documents = documents = documents.withColumn("source", F.coalesce("source", F.lit("\x00"))).withColumn("lang", F.coalesce("lang", F.lit("")))
        some = documents.select("doc", "text", "lang", "source")
        occurrences = keep(some.mapInArrow(_tokens, "doc bigint, lang string, source string, t bigint, script int, token string"), "occurrences")
        # a document has each token once
        tokens = occurrences.groupBy("t").agg(F.max("token").alias("token"), F.max("script").alias("script"), F.count("*").cast("double").alias("n"))
        tokens = keep(tokens.mapInArrow(_candidates, _CANDIDATE), "tokens")
        base = self._counts(tokens.select("token", "n"))
        # which scripts a language's tokens have: a restored token must suit its document better than the token as it is
        share = occurrences.groupBy("lang", "script").agg(F.count("*").alias("n"))
        self.suits = suits = keep(share.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("script", "n"))).alias("of"), F.sum("n").alias("all")), "suits")
        fit = lambda s: F.log((F.coalesce(F.try_element_at("of", s), F.lit(0)) + 1) / (F.col("all") + 20))
        by_source = keep(documents.groupBy("source").agg(F.count("*").alias("docs")), "sources")
        everything = by_source.agg(F.sum("docs")).first()[0] or 0
        occurrences = occurrences.select("doc", "lang", "source", "t")
        arrays, priors, pooled, before, self.rounds = base, None, {}, None, 0
        while True:
            self.rounds += 1
            self.model = model = spark.sparkContext.broadcast(_sparse(arrays))
            ratios, listed = scratch.keep_counting(tokens.filter("size(z) > 0").mapInArrow(_ratios(model), _RATIO), "ratios", F.sum(F.size("r")))
            small = listed <= SENT  # restorations grow with the distinct tokens: sent to the documents while they are few, else both are shuffled by token
            weighing = ratios.select("t", "script", F.transform("r", lambda r: F.struct(r["z"].alias("z"), r["gain"].alias("gain"), r["becomes"].alias("becomes"))).alias("r"))
            weighed = (
                self._with_ratios(occurrences, weighing, small)
                .select("doc", "lang", "source", "script", F.explode("r").alias("r"))
                .join(suits, "lang")
                .groupBy("doc", "lang", "source", F.col("r.z").alias("z"))
                .agg(F.sum(_evidence(F.col("r.gain") + fit(F.col("r.becomes")) - fit(F.col("script")))).alias("weight"))
            )
            evidence = weighed.filter("weight > 0").groupBy("doc", "lang", "source").agg(F.collect_list(F.struct("z", "weight")).alias("zs"))  # at most as many as there are chains
            # E-step: the posterior of each chain and of `clean`
            self.judged = judged = keep(self._with_priors(evidence, priors).mapInArrow(_posterior(pooled), "doc bigint, lang string, source string, odds double, zs array<struct<z:int,r:double>>"), "judged")
            # M-step: priors of chains by source, shrunk to those of all sources
            per = keep(judged.select("source", F.explode("zs").alias("x")).groupBy("source", "x.z").agg(F.sum("x.r").alias("c")), "sums")
            sums = {r["z"]: r["c"] for r in per.groupBy("z").agg(F.sum("c").alias("c")).collect()}  # one row a chain
            pooled = {z: (c + START) / (everything + 1) for z, c in sums.items()}
            shrunk = per.join(by_source, "source").groupBy("source").agg(F.collect_list(F.struct("z", (F.col("c") / (F.col("docs") + SHRINK)).alias("c"))).alias("own"), F.max(SHRINK / (F.col("docs") + SHRINK)).alias("lent"))
            self.priors = priors = keep(shrunk, "priors")
            now = sum(sums.values())
            if before is not None and abs(now - before) <= max(0.5, TOLERANCE * now) or self.rounds >= MOST_ROUNDS:
                break
            before = now
            # the model with tokens moved to what they were, each by its posterior
            sure = judged.filter("odds > -5").select("doc", "lang", F.explode("zs").alias("x")).select("doc", "lang", "x.z", "x.r").filter("r > 0.01")
            held = self._with_ratios(occurrences.select("doc", "t").join(sure.select("doc").distinct(), "doc", "left_semi"), ratios, small)
            moved = held.select("doc", "t", "token", "script", F.explode("r").alias("g")).select("doc", "t", "token", "script", "g.*").join(sure, ["doc", "z"]).join(suits, "lang")
            gain = F.least(F.lit(30.0), F.col("gain") + fit(F.col("becomes")) - fit(F.col("script"))) - TOKEN_COST
            moved = moved.filter("token <> restored").groupBy("t", "restored").agg(F.max("token").alias("token"), F.sum(F.col("r") / (1 + F.exp(-gain))).alias("n"))
            moved = keep(moved, "moved")
            gone, come = self._counts(moved.select("token", "n")), self._counts(moved.select(F.col("restored").alias("token"), "n"))
            # of what is left of characters that mostly come from garbling, the same share is taken twice over for garbling not found yet
            arrays = {k: x * np.clip(1 - gone[k] / np.maximum(x, 1e-9), 0, 1) ** 3 + come[k] for k, x in base.items()}
            model.unpersist()

    @staticmethod
    def _with_ratios(occurrences: DataFrame, ratios: DataFrame, small: bool) -> DataFrame:
        """Occurrences with what their tokens may have been. Hot tokens are salted where the join shuffles."""
        if small:
            return occurrences.join(F.broadcast(ratios), "t")
        salted = occurrences.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        return salted.join(ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["t", "salt"])

    @staticmethod
    def _with_priors(evidence: DataFrame, priors: DataFrame | None) -> DataFrame:
        """(doc, lang, source, zs, own, lent): evidence with its source's own share of each chain and the weight of the pooled one."""
        if priors is None:
            return evidence.select("doc", "lang", "source", "zs", F.lit(None).cast("array<struct<z:int,c:double>>").alias("own"), F.lit(1.0).alias("lent"))
        return evidence.join(priors, "source", "left").select("doc", "lang", "source", "zs", "own", F.coalesce("lent", F.lit(1.0)).alias("lent"))

    @staticmethod
    def _counts(tokens: DataFrame) -> dict[int, np.ndarray]:
        """Character counts of (token, n) on the driver: at most 2^(BITS+1) + 2^16 + 9 numbers, whatever the corpus."""
        arrays = {PAIRS: np.zeros(1 << BITS), ONES: np.zeros(1 << 16), POOLED: np.zeros(1 << BITS), CASES: np.zeros(9)}
        proper = tokens.filter(F.col("token") != "�")
        got = proper.mapInArrow(_counter, "kind int, i bigint, n double").groupBy("kind", "i").agg(F.sum("n").alias("n")).toArrow()
        kind, i, n = (got.column(c).to_numpy() for c in ("kind", "i", "n"))
        for k, x in arrays.items():
            x[i[kind == k]] += n[kind == k]
        return arrays

    def found(self) -> DataFrame:
        return self.judged.filter("odds > 0").select("doc")

    def repaired(self) -> DataFrame:
        """(doc, chains, restored): the affected documents with every token as the document's mixture of chains has it; restored is null if nothing changes.

        Repair is repeated on its own result as long as that changes, so text garbled by one chain after another is undone step by step.
        """
        model = self.model
        listed = self.judged.filter("odds > 0").join(self.suits, "lang").select("doc", "zs", "of", "all")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = chains()
            for b in batches:
                texts, names = [], []
                for text, zs, of, n in zip(*(c.to_pylist() for c in b.columns[1:])):
                    of = dict(of)
                    fit = lambda s: np.log((of.get(s, 0) + 1) / (n + 20))  # noqa: E731, B023
                    weights = {x["z"]: x["r"] for x in zs}
                    done, used = text, {}
                    for _ in range(4):
                        new, found = restore(model_of(model), done, weights, fit)
                        for z, c in found.items():
                            used[z] = used.get(z, 0) + c
                        if new == done:
                            break
                        done = new
                    lost = ["replacement characters"] if len(made) in weights and "�" in text else []
                    names.append(", ".join([made[z].name for z in sorted(used, key=lambda z: -used[z])] + lost) or "unknown")
                    texts.append(done if done != text else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["doc", "chains", "restored"])

        return self.documents.select("doc", "text").join(listed, "doc").select("doc", "text", "zs", "of", "all").mapInArrow(run, "doc bigint, chains string, restored string")


#: Weight in tokens of what is known of a document's chains before its tokens are looked at one by one, and that of any other chain.
KNOWN, OTHER = 1.0, 1e-4


def restore(model: Model, text: str, weights: dict[int, float], fit) -> tuple[str, dict[int, float]]:
    """The text with every token outside of inline code as its posterior has it, and how many tokens each chain explains."""
    tokens = [t for t in dict.fromkeys(m[0] for part in _outside(text) for m in _TOKEN.finditer(part)) if "�" not in t]
    at, which, restored = undone(tokens)
    at, which, gain, restored = model.gains(tokens, np.array(at, np.int64), np.array(which, np.int64), restored, -30.0)
    if not len(at):
        return text, {}
    gain = gain + np.array([fit(script_of(o)) - fit(script_of(tokens[i])) for i, o in zip(at, restored)])
    known = np.array([KNOWN * weights.get(z, 0.0) + OTHER for z in range(len(chains()))])
    theta = known / (known.sum() + len(tokens))
    likely = np.exp(np.minimum(gain, 60.0))
    for _ in range(12):  # weights of chains in this document
        r = theta[which] * likely
        rest = np.maximum(1 - theta.sum(), 1e-3)
        r = r / (rest + np.bincount(at, r, len(tokens)))[at]
        theta = (np.bincount(which, r, len(known)) + known) / (known.sum() + len(tokens))
    best: dict[str, str] = {}
    used: dict[int, float] = {}
    share: dict[tuple[int, str], float] = {}
    for i, o, x in zip(at.tolist(), restored, r.tolist()):  # chains that agree add up
        share[i, o] = share.get((i, o), 0.0) + x
    for (i, o), x in share.items():
        if x > 0.5:
            best[tokens[i]] = o
    for i, z, o, x in zip(at.tolist(), which.tolist(), restored, r.tolist()):
        if best.get(tokens[i]) == o:
            used[z] = used.get(z, 0.0) + x
    if not best:
        return text, {}
    return _outside_code(text, lambda part: _TOKEN.sub(lambda m: best.get(m[0], m[0]), part)), {z: c for z, c in used.items() if c > 0.5}


def _outside(text: str) -> list[str]:
    out: list[str] = []
    _outside_code(text, lambda part: out.append(part) or part)
    return out


def _outside_code(text: str, change) -> str:
    out, at = [], 0
    for m in _CODE.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


_CANDIDATE = "t bigint, token string, script int, n double, z array<int>, restored array<string>"
_RATIO = "t bigint, token string, script int, r array<struct<z:int,gain:double,becomes:int,restored:string>>"


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of values for n rows; owner is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token with all that chains make of it."""
    for b in batches:
        at, which, restored = undone(b.column(1).to_pylist())
        at = np.array(at, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, _lists(at, b.num_rows, pa.array(which, pa.int32())), _lists(at, b.num_rows, pa.array(restored, pa.string()))], names=["t", "token", "script", "n", "z", "restored"])


def _ratios(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(1).to_pylist()
            at = np.repeat(np.arange(len(tokens)), b.column(4).value_lengths().to_numpy(zero_copy_only=False))
            at, z, gain, restored = model_of(model).gains(tokens, at, b.column(4).flatten().to_numpy(), b.column(5).flatten().to_pylist())
            some, place = np.unique(at, return_inverse=True)
            r = pa.StructArray.from_arrays([pa.array(z, pa.int32()), pa.array(gain, pa.float64()), pa.array(map(script_of, restored), pa.int32()), pa.array(restored, pa.string())], names=["z", "gain", "becomes", "restored"])
            rows = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), _lists(place, len(some), r)], names=["t", "token", "script", "r"])

    return run


def _posterior(pooled: dict[int, float]):
    """Posterior of each listed chain of a document, and the log odds of all of them together against `clean`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.full(len(chains()) + 1, START)
        for z, p in pooled.items():
            whole[z] = p
        for b in batches:
            n, lists = b.num_rows, b.column(3)
            if not n:
                continue
            sources = b.column(2).dictionary_encode()
            of, first = sources.indices.to_numpy(), {}
            for i, k in enumerate(of.tolist()):
                first.setdefault(k, i)
            prior = np.empty((len(first), len(whole)))
            for k, i in first.items():
                prior[k] = b.column(5)[i].as_py() * whole
                for x in b.column(4)[i].as_py() or ():
                    prior[k, x["z"]] += x["c"]
            prior = np.clip(prior, 1e-9, 0.5)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            z = flat.field(0).to_numpy()
            o = flat.field(1).to_numpy() + np.log(prior[of[row], z])
            top = np.zeros(n)
            np.maximum.at(top, row, o)
            each = np.exp(o - top[row])
            total = np.bincount(row, each, n)
            clean = np.maximum(0.5, 1 - prior.sum(axis=1))[of]
            odds = np.log(np.maximum(total, 1e-300)) + top - np.log(clean)
            r = each / (total + clean * np.exp(-top))[row]
            kept = (r > 1e-6) & (odds > -10)[row]
            some = np.flatnonzero(odds > -10)
            place = np.searchsorted(some, row[kept])
            values = pa.StructArray.from_arrays([pa.array(z[kept], pa.int32()), pa.array(r[kept])], names=["z", "r"])
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(odds[some]), _lists(place, len(some), values)], names=["doc", "lang", "source", "odds", "zs"])

    return run


def garbled(spark: SparkSession, folder: str) -> Garbled:
    d = table(spark, folder, "documents").filter("doc_id is not null")
    return Garbled(d.select(F.col("doc_id").alias("doc"), "text", "source", "lang"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(spark, folder).found().select(F.col("doc").alias("doc_id"))


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(spark, folder).repaired().withColumnRenamed("doc", "doc_id")

"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnmill.schemas import CHARS_PER_TOKEN, MIN_WORD_BYTES, STOPWORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.char_length(c) / CHARS_PER_TOKEN)


def content_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


#: What words consist of: alphabetic characters, vowel signs of Indic and other scripts among them, and numbers.
_WORD = r"\p{IsAlphabetic}\p{N}"


def keywords(c: Column) -> Column:
    """Runs of letters and digits of at least three bytes, lower case; repeats stay."""
    return F.transform(F.filter(F.split(c, f"[^{_WORD}]"), lambda x: F.octet_length(x) >= MIN_WORD_BYTES), F.lower)


def mention_tokens(c: Column) -> Column:
    """Words of a question without other than letters, digits, hyphen and underscore; short words and stopwords left out."""
    words = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, f"[^{_WORD}_-]", ""))
    return F.filter(words, lambda w: (F.octet_length(w) >= MIN_WORD_BYTES) & ~F.lower(w).isin(*STOPWORDS))


def hit_count(content: Column, words: list[str]) -> Column:
    """How many entries of words occur in the content, repeats of a word counted."""
    text = F.lower(content)
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Cut after every pair of line feeds; three in a row make two cuts."""
    return F.split(c, r"(?<=\n\n)(?=[\s\S])")


def sentences(c: Column) -> Column:
    """Cut after a full stop, question or exclamation mark before white space, which leads the next piece."""
    return F.split(c, r"(?<=[.!?])(?=[ \t\n\r\f])")


def hard_cuts(c: Column, size: int) -> Column:
    """Pieces of size characters."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def folder_scope(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def like_name(name: Column, query: str, literal: bool = False) -> Column:
    """Case-insensitive substring match by LIKE: % and _ in the query are wildcards unless literal. The name is folded in ASCII only."""
    q = query.lower().replace("\\", "\\\\")
    if literal:
        q = q.replace("%", "\\%").replace("_", "\\_")
    return ascii_lower(name).like(f"%{q}%")

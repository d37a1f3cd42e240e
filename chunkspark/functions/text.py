"""Tokens, sentences and other text functions, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bpe import bpe_count, bpe_tokens

MARKS = r".,!?;:'\"()\[\]{}"
TOKEN_COUNT = rf"[{MARKS}]|[^\s{MARKS}]+"
TOKEN_ALL = rf"((?U)\s+|[{MARKS}]|[^\s{MARKS}]+)"
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<![A-Z]\.)(?<=[.!?])\s+"
FENCE = r"(?s)```(\w*)\n(.*?)```"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: lambdas don't share subexpressions."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column, tokenizer: str = "whitespace", vocabulary: str | None = None) -> Column:
    """All pieces of the text in order, white space too; joined, they give the text again. ``character`` gives its characters, ``tiktoken`` the tokens of a vocabulary file; ``auto`` is that where a file is given, else white space."""
    if tokenizer == "auto":
        tokenizer = "tiktoken" if vocabulary else "whitespace"
    if tokenizer == "tiktoken":
        return bpe_tokens(text, _given(vocabulary))
    if tokenizer == "character":
        return F.filter(F.split(text, ""), lambda x: x != "")
    if tokenizer != "whitespace":
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return F.regexp_extract_all(text, F.lit(TOKEN_ALL), F.lit(1))


def _given(vocabulary: str | None) -> str:
    if not vocabulary:
        raise ValueError("tiktoken needs a vocabulary file")
    return vocabulary


def detokenize(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def count_tokens(text: Column, tokenizer: str = "whitespace", vocabulary: str | None = None) -> Column:
    """Number of pieces that aren't white space, or of a vocabulary's tokens; 0 for null."""
    if tokenizer == "tiktoken" or tokenizer == "auto" and vocabulary:
        return bpe_count(text, _given(vocabulary))
    if tokenizer not in ("auto", "whitespace", "character"):
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    pattern = r"(?U)(?s)\S" if tokenizer == "character" else "(?U)" + TOKEN_COUNT
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def word_list(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def whitespace_tokens(text: Column) -> Column:
    """Words and the white space between them."""
    return F.regexp_extract_all(text, F.lit(r"((?U)\s+|\S+)"), F.lit(1))


def length_by(text: Column, method: str = "token") -> Column:
    """Length in token, char or word."""
    if method == "char":
        return F.length(text).cast("bigint")
    if method == "word":
        return F.size(word_list(text)).cast("bigint")
    if method == "token":
        return count_tokens(text)
    raise ValueError(f"unknown length method: {method}")


def sentences(text: Column) -> Column:
    """Sentences without blank ones: cut at white space after ``.!?`` unless an abbreviation or initial comes before."""
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def normalized(text: Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.array_join(word_list(F.lower(text)), " ")


def code_blocks(text: Column) -> Column:
    """Fenced blocks: array of (language, content, start, end) with 0-based character offsets; no language is ``text``."""
    whole = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    language, content = (F.regexp_extract_all(text, F.lit(FENCE), F.lit(k)) for k in (1, 2))
    # a block is found from the end of the one before it
    ends = F.aggregate(
        whole,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, w: F.concat(acc, F.array(_span(text, w, F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))))),
    )
    rows = F.arrays_zip(language.alias("language"), content.alias("content"), ends.alias("at"))
    return F.transform(rows, lambda r: F.struct(F.when(r["language"] == "", "text").otherwise(r["language"]).alias("language"), r["content"].alias("content"), r["at"]["start"].alias("start"), r["at"]["end"].alias("end")))


def _span(text: Column, piece: Column, after: Column) -> Column:
    start = F.call_function("locate", piece, text, after + 1) - 1
    return F.struct(start.cast("int").alias("start"), (start + F.length(piece)).cast("int").alias("end"))


def inside_code(blocks: Column, offset: Column) -> Column:
    """Whether a character offset is within a fenced block."""
    return F.exists(blocks, lambda b: (offset >= b["start"]) & (offset < b["end"]))


def token_of_character(pieces: Column) -> Column:
    """Token number of every character."""
    return F.flatten(F.transform(pieces, lambda t, i: F.array_repeat(i, F.length(t))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)

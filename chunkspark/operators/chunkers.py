"""Chunking operators: documents (id, text) -> chunks, several for each document.

Rules that are expressions over a document's tokens or sentences are Catalyst expressions; those that are sequential run
in Arrow-batched tasks. Neither needs a shuffle. All give the columns of ``CHUNK``; ids are ``{doc}#{suffix}#{index}``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.folder import small_batches
from . import splitters as S

CHUNK = "doc_id string, chunk_id string, chunk_index int, text string, strategy string, token_count int, meta map<string,string>"
ARROW = pa.schema([("doc_id", pa.string()), ("chunk_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("strategy", pa.string()), ("token_count", pa.int32()), ("meta", pa.map_(pa.string(), pa.string()))])
MOST_BYTES = 1 << 20  # of chunks that a task gives at once
LLM = Callable[[str, str], str]


def _finish(rows: DataFrame, suffix: str, strategy: str, count: Column, meta: Column | None = None) -> DataFrame:
    """rows has (doc_id, chunk_index, text)."""
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(f"#{suffix}#"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "text",
        F.lit(strategy).alias("strategy"),
        count.cast("int").alias("token_count"),
        (F.expr("cast(map() as map<string,string>)") if meta is None else meta).alias("meta"),
    )


def _windows(docs: DataFrame, id_col: str, text_col: str, starts: Column, base: int, step: int, tokenizer: str = "whitespace", vocabulary: str | None = None) -> DataFrame:
    """Windows of ``base`` tokens at the starts of array column t, every ``step``, cut before the rows multiply; at is a column of their character offsets."""
    t = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col), tokenizer, vocabulary).alias("t"))
    piece = F.transform(starts, lambda s: F.struct(F.array_join(F.slice("t", s + 1, F.lit(base)), "").alias("text"), F.least(F.lit(base), F.size("t") - s).alias("n"), s.alias("s")))
    steps = F.transform(starts, lambda s: F.length(F.array_join(F.slice("t", s + 1, F.lit(step)), "")))
    cut = t.select("doc_id", steps.alias("steps"), F.posexplode(F.when(F.size("t") > 0, piece)).alias("chunk_index", "c"))
    at = F.aggregate(F.slice("steps", F.lit(1), F.col("chunk_index")), F.lit(0), lambda a, x: a + x)
    return cut.select("doc_id", "chunk_index", "c.text", "c.n", "c.s", at.alias("at"))


def fixed_length(
    docs: DataFrame, base_token_size: int = 512, overlap: int = 64, add_start_index: bool = False, tokenizer: str = "whitespace", vocabulary: str | None = None, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """Windows of tokens, white space counted too, every ``base - overlap``; the last ones may be the end of the one before. ``add_start_index`` puts the character offset in meta."""
    step = max(1, base_token_size - overlap)
    rows = _windows(docs, id_col, text_col, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - 1), F.lit(step)), base_token_size, step, tokenizer, vocabulary)
    meta = F.create_map(F.lit("start_index"), F.col("at").cast("string")) if add_start_index else None
    return _finish(rows, "fl", "fixed_length", F.col("n"), meta)


def token_windows(docs: DataFrame, base_token_size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Like fixed_length, but the first window that reaches the end is the last."""
    step = max(1, base_token_size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - base_token_size) / step).cast("int")) * step
    rows = _windows(docs, id_col, text_col, F.sequence(F.lit(0), last, F.lit(step)), base_token_size, step)
    return _finish(rows, "lc_tk", "langchain_token", F.col("n"))


def fixed_length_by(docs: DataFrame, length_function: Callable[[str], int], base_token_size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """fixed_length, with token counts from a function of the text."""

    def split(_: str, text: str) -> list[S.Piece]:
        pieces = S._COUNT.pattern
        import re

        t = re.findall(rf"\s+|{pieces}", text)
        step = max(1, base_token_size - overlap)
        return [("".join(t[k : k + base_token_size]), {"token_count": length_function("".join(t[k : k + base_token_size]))}) for k in range(0, len(t), step)]

    return _sequential(docs, split, "fl", "fixed_length", id_col, text_col)


def proposition(docs: DataFrame, llm_fn: LLM | None = None, max_tokens_per_call: int = 2000, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A chunk for each sentence; with a language model, for each item of its numbered answer to a batch of sentences."""
    if llm_fn is None:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.sentences(F.col(text_col))).alias("chunk_index", "text"))
        return _finish(rows, "prop", "proposition_fallback", T.count_tokens(F.col("text")))

    def split(_: str, text: str) -> list[S.Piece]:
        out, held, size = [], [], 0

        def ask() -> None:
            if held:
                try:
                    found = S.numbered(llm_fn("Split the text into numbered self-contained propositions.", " ".join(held))) or list(held)
                except Exception:
                    found = list(held)
                out.extend((p, {"strategy": "proposition"}) for p in found)

        for s in S.sentences(text):
            n = S.count(s)
            if held and size + n > max_tokens_per_call:
                ask()
                held, size = [], 0
            held.append(s)
            size += n
        ask()
        return out

    return _sequential(docs, split, "prop", "proposition", id_col, text_col)


def agentic_every(docs: DataFrame, every: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Groups of ``every`` sentences: the agentic chunker where the model's answer can't be read."""
    s = docs.select(F.col(id_col).alias("doc_id"), T.sentences(F.col(text_col)).alias("s"))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - 1), F.lit(every)), lambda a: F.array_join(F.slice("s", a + 1, F.lit(every)), " "))
    rows = s.select("doc_id", F.posexplode(F.when(F.size("s") > 0, groups)).alias("chunk_index", "text"))
    return _finish(rows, "ag", "agentic", T.count_tokens(F.col("text")))


def agentic(docs: DataFrame, llm_fn: LLM | None = None, max_sentences_per_call: int = 50, base_token_size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Groups of sentences that begin where a language model says; without one, sentence_aware chunks."""
    if llm_fn is None:
        return sentence_aware(docs, base_token_size, overlap, id_col, text_col)

    def split(_: str, text: str) -> list[S.Piece]:
        s, out = S.sentences(text), []
        for a in range(0, len(s), max_sentences_per_call):
            part = s[a : a + max_sentences_per_call]
            ask = "\n".join(f"{k + 1}. {x}" for k, x in enumerate(part))
            try:
                begins = S.boundaries(llm_fn("Give the numbers of the sentences that begin a new topic, as a JSON list.", ask), len(part))
            except Exception:
                begins = list(range(0, len(part), 5))
            edges = [0, *(b for b in begins if b > 0), len(part)]
            out += [(" ".join(part[x:y]), {"sentence_range": f"{a + x}-{a + y}"}) for x, y in zip(edges, edges[1:], strict=False) if y > x]
        return out

    return _sequential(docs, split, "ag", "agentic", id_col, text_col)


def _sequential(docs: DataFrame, split: Callable[[str, str], list[S.Piece]], suffix: str, strategy: str, id_col: str, text_col: str) -> DataFrame:
    """Chunks from a function of (id, text); a null or empty text gives none. A text that the function fails on gives one row of the strategy ``error``, without a text, that says why; the rest goes on."""

    def rows(ident: str, text: str) -> Iterator[tuple]:
        try:
            pieces = list(split(ident, text))
        except Exception as e:
            yield ident, f"{ident}#{suffix}#error", -1, None, "error", 0, {"error": f"{type(e).__name__}: {e}"[:500]}
            return
        for k, (body, meta) in enumerate(pieces):
            meta = dict(meta)
            i, n = meta.pop("index", k), meta.pop("token_count", None)
            yield ident, f"{ident}#{suffix}#{i}", i, body, meta.pop("strategy", strategy), S.count(body) if n is None else n, {a: str(b) for a, b in meta.items() if b is not None}

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([list(m.items()) for m in x] if pa.types.is_map(f.type) else x, f.type) for x, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            # one text at a time, and chunks of bounded bytes at a time
            for ident, text in zip(b.column(0), b.column(1), strict=True):
                ident, text = ident.as_py(), text.as_py()
                for row in rows(ident, text) if text else ():
                    held.append(row)
                    size += 200 + len(row[3] or "") + sum(len(x) for x in row[6].values())
                    if size >= MOST_BYTES:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, CHUNK)


def _plain(rule: Callable[..., list[S.Piece]], suffix: str, strategy: str):
    def chunker(docs: DataFrame, *args, id_col: str = "id", text_col: str = "text", **params) -> DataFrame:
        fixed = partial(rule, **params)
        if args:
            names = ("base", "overlap")
            fixed = partial(rule, **dict(zip(names, args, strict=False)), **params)
        return _sequential(docs, lambda _, t: fixed(t), suffix, strategy, id_col, text_col)

    chunker.__doc__ = rule.__doc__
    chunker.__name__ = strategy
    return chunker


def _texts(rule: Callable[..., list[str]], **fixed):
    def f(text: str, **params) -> list[S.Piece]:
        return [(p, {}) for p in rule(text, **fixed, **params)]

    f.__doc__ = rule.__doc__
    return f


recursive_character = _plain(S.recursive, "rc", "recursive_character")
semantic_local = _plain(S.semantic, "sl", "semantic_local")
hybrid_semantic_stat = _plain(S.hybrid, "hss", "hybrid_semantic_stat")
layout_aware = _plain(S.layout, "la", "layout_aware")
html_section = _plain(S.html_section, "html", "html_section")
python_ast = _plain(S.python_ast, "py", "python_ast")
langchain_recursive = _plain(_texts(S.separator_split), "lc_rc", "langchain_recursive")
langchain_character = _plain(_texts(S.character_split), "lc_c", "langchain_character")
langchain_markdown = _plain(_texts(S.separator_split, separators=S.MARKDOWN, regex=True), "lc_md", "langchain_markdown")
langchain_python = _plain(_texts(S.separator_split, separators=S.PYTHON), "lc_py", "langchain_python")
langchain_html = _plain(_texts(S.html_header_split), "lc_html", "langchain_html")
langchain_json = _plain(_texts(S.json_split), "lc_json", "langchain_json")


def sentence_aware(docs: DataFrame, base_token_size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Greedy packing of sentences with overlap; a sentence beyond the size is split recursively."""
    return _sequential(docs, lambda _, t: S.sentence_aware(t, base_token_size, overlap), "sa", "sentence_aware", id_col, text_col)


def parent_child(docs: DataFrame, parent_size: int = 1000, child_size: int = 200, chunk_sizes: tuple[int, ...] | None = None, overlap: int = 0, return_all_levels: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A hierarchy of recursive splits; meta holds parent_id, parent_text, siblings, level and global_index."""
    sizes = tuple(chunk_sizes or (parent_size, child_size))

    def split(ident: str, text: str) -> list[S.Piece]:
        nodes = S.parent_child(ident, text, sizes, overlap, return_all_levels)
        return [(n["text"], {"node_id": n["id"], **{k: n[k] for k in ("level", "is_leaf", "parent_id", "parent_text", "prev_id", "next_id", "global_index")}, "child_ids": ",".join(n["child_ids"]) or None}) for n in nodes]

    flat = _sequential(docs, split, "pc", "parent_child", id_col, text_col)
    return flat.withColumn("chunk_id", F.col("meta")["node_id"]).withColumn("meta", F.map_filter("meta", lambda k, _: k != "node_id"))


def contextual_retrieval(docs: DataFrame, llm_fn: LLM | None = None, base_chunker: Callable[[DataFrame], DataFrame] | None = None, max_document_tokens: int = 8000, prefix: str = "Context: ", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Base chunks, each after a context that a language model writes for it; without one the base chunks alone."""
    base = (base_chunker or partial(recursive_character, id_col=id_col, text_col=text_col))(docs)
    base = base.withColumn("chunk_id", F.concat("doc_id", F.lit("#cr#"), F.col("chunk_index").cast("string")))
    if llm_fn is None:
        return base.withColumn("strategy", F.lit("contextual_retrieval_base"))

    @F.pandas_udf("string")
    def context(document: pd.Series, chunk: pd.Series) -> pd.Series:
        def one(d: str, c: str) -> str:
            try:
                return " ".join(llm_fn("Say in a sentence where the chunk stands in the document.", f"{' '.join(d.split()[:max_document_tokens])}\n---\n{c}").split()[:100])
            except Exception:
                return ""

        return pd.Series([one(d, c) for d, c in zip(document, chunk, strict=True)], dtype=object)

    whole = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("document"))
    told = base.join(whole, "doc_id").withColumn("context", context("document", "text"))
    text = F.when(F.col("context") != "", F.concat(F.lit(prefix), "context", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return told.withColumn("text", text).withColumn("strategy", F.lit("contextual_retrieval")).select(*base.columns)


#: Chunkers by name; sizes are given as base_token_size and overlap where a chunker has them.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "fixed_length": fixed_length,
    "recursive_character": recursive_character,
    "sentence_aware": sentence_aware,
    "semantic_local": semantic_local,
    "hybrid_semantic_stat": hybrid_semantic_stat,
    "parent_child": parent_child,
    "layout_aware": layout_aware,
    "html_section": html_section,
    "proposition": proposition,
    "agentic": agentic,
    "contextual_retrieval": contextual_retrieval,
    "python_ast": python_ast,
    "langchain_recursive": langchain_recursive,
    "langchain_character": langchain_character,
    "langchain_markdown": langchain_markdown,
    "langchain_token": token_windows,
    "langchain_python": langchain_python,
    "langchain_html": langchain_html,
    "langchain_json": langchain_json,
}
_RENAMED = {"recursive_character", "semantic_local", "hybrid_semantic_stat", "layout_aware", "html_section", "python_ast", *(n for n in CHUNKERS if n.startswith("langchain_") and n != "langchain_token")}


def get_chunker(name: str) -> Callable[..., DataFrame]:
    """The chunker of this name, with base_token_size and overlap as parameters; an unknown name raises KeyError."""
    found = CHUNKERS[name]
    if name not in _RENAMED:
        return found

    def renamed(docs: DataFrame, base_token_size: int | None = None, **params) -> DataFrame:
        if base_token_size is not None:
            params["most" if name == "python_ast" else "base"] = base_token_size
        if name in ("python_ast", "layout_aware", "html_section", "semantic_local", "hybrid_semantic_stat", "langchain_json"):
            params.pop("overlap", None)
        return found(docs, **params)

    return renamed


def list_chunkers() -> list[str]:
    return list(CHUNKERS)

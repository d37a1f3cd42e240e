"""Splitting rules that are sequential within a text, as plain functions: text -> list of (text, meta).

They run inside Arrow-batched tasks (see ``chunkers``); a text never leaves its task.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np

from ..functions.text import SENTENCE_END, TOKEN_COUNT

Piece = tuple[str, dict]
_COUNT = re.compile(TOKEN_COUNT)
_SENTENCE = re.compile(SENTENCE_END.removeprefix("(?U)"))
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def count(text: str) -> int:
    """Pieces of a text that aren't white space."""
    return len(_COUNT.findall(text))


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text.strip())) if s]


def _cut(text: str, separator: str, keep: bool, regex: bool) -> list[str]:
    if separator == "" and not regex:
        return list(text)
    ends = [m.span() for m in re.finditer(separator if regex else re.escape(separator), text) if m.end() > m.start()]
    out, at = [], 0
    for a, b in ends:
        out.append(text[at : b if keep else a])
        at = b
    return [p for p in [*out, text[at:]] if p]


def recursive_pieces(text: str, base: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, keep: bool = True, regex: bool = False, length: Callable[[str], int] = count) -> list[str]:
    """Unstripped pieces of at most ``base``: cut at the first separator, pieces beyond it at the next ones, and merge greedily.

    After a full buffer its last pieces, ``overlap`` at most together, begin the next one; a piece that is cut further clears
    the buffer. A piece that is still too long when the separators have run out is cut in windows of tokens.
    """
    out: list[str] = []
    levels: list[tuple[Iterator[str], int]] = [(iter([text]), -1)]  # pieces, and the separator that cut them
    stack: list[list[tuple[str, int]]] = [[]]
    while levels:
        pieces, level = levels[-1]
        held = stack[-1]
        piece = next(pieces, None)
        if piece is None:
            if held:
                out.append("".join(p for p, _ in held))
            levels.pop(), stack.pop()
            continue
        n = length(piece)
        if n > base:
            if held:
                out.append("".join(p for p, _ in held))
                held.clear()
            if level + 1 < len(separators):
                levels.append((iter(_cut(piece, separators[level + 1], keep, regex)), level + 1))
                stack.append([])
            else:
                out += token_pieces(piece, base, overlap)
            continue
        if held and sum(m for _, m in held) + n > base:
            out.append("".join(p for p, _ in held))
            carried: list[tuple[str, int]] = []
            for p, m in reversed(held):
                if m + sum(x for _, x in carried) > overlap:
                    break
                carried.insert(0, (p, m))
            held[:] = carried
        held.append((piece, n))
    return out


def token_pieces(text: str, base: int, overlap: int) -> list[str]:
    """Windows of ``base`` tokens, white space counted too, every ``base - overlap``, as in fixed_length."""
    t = re.findall(rf"\s+|{TOKEN_COUNT}", text)
    return ["".join(t[k : k + base]) for k in range(0, len(t), max(1, base - overlap))]


def recursive(text: str, base: int = 512, overlap: int = 64, add_start_index: bool = False, **options) -> list[Piece]:
    """Recursive separator splitting; blank pieces leave a gap in the numbers."""
    out, at = [], 0
    for i, p in enumerate(recursive_pieces(text, base, overlap, **options)):
        meta = {"index": i}
        if add_start_index:
            found = text.find(p, max(0, at - len(p)))
            at = found + len(p) if found >= 0 else at
            meta["start_index"] = found
        if p.strip():
            out.append((p.strip(), meta))
    return out


def _carry(sizes: list[int], end: int, overlap: int) -> tuple[int, int]:
    """First of the last items before ``end`` that fit the overlap, and their sum."""
    start, total = end, 0
    while start > 0 and total + sizes[start - 1] <= overlap:
        start -= 1
        total += sizes[start]
    return start, total


def sentence_aware(text: str, base: int = 512, overlap: int = 64) -> list[Piece]:
    """Greedy packing of sentences; a sentence beyond ``base`` is split recursively and ends the overlap."""
    s = sentences(text)
    sizes, out = [count(x) for x in s], []
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if n > base:
            if i > start:
                out.append((" ".join(s[start:i]), {"strategy": "sentence_aware", "token_count": total}))
            out += [(p, {"strategy": "sentence_aware_recursive"}) for p, _ in recursive(s[i], base, overlap)]
            start, total = i + 1, 0
        elif total + n > base:
            out.append((" ".join(s[start:i]), {"strategy": "sentence_aware", "token_count": total}))
            back, carried = _carry(sizes[start:i], i - start, overlap)
            start, total = start + back, carried + n
        else:
            total += n
    if start < len(s):
        out.append((" ".join(s[start:]), {"strategy": "sentence_aware", "token_count": total}))
    return out


@lru_cache(maxsize=1 << 16)
def _word_bucket(word: str, dim: int) -> tuple[int, float]:
    h = int(hashlib.md5(word.encode()).hexdigest(), 16)
    return h % dim, 1.0 if h & 2 else -1.0


def word_sums(texts: list[list[str]], dim: int = 256) -> np.ndarray:
    """Signed counts of each text's words by their coordinates."""
    out = np.zeros((len(texts), dim))
    for k, words in enumerate(texts):
        times = Counter(words)
        if times:
            place, signs = zip(*(_word_bucket(w, dim) for w in times), strict=True)
            out[k] = np.bincount(place, weights=np.array(signs) * np.fromiter(times.values(), np.int64, len(times)), minlength=dim)
    return out


def hashing_vectors(texts: list[str], dim: int = 256) -> np.ndarray:
    """Unit hashing vectors; a text whose words cancel out, or that has none, is the zero vector."""
    out = word_sums([t.lower().split() for t in texts], dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def gap_distances(vectors: np.ndarray, window: int = 3) -> np.ndarray:
    """Cosine distance between the means of the ``window`` rows before and after each gap; 0 beside a zero mean."""
    n = len(vectors)
    sums = np.vstack([np.zeros(vectors.shape[1]), np.cumsum(vectors, 0)])
    gap = np.arange(n - 1)
    lo, hi = np.maximum(0, gap + 1 - window), np.minimum(n, gap + 1 + window)
    before = (sums[gap + 1] - sums[lo]) / (gap + 1 - lo)[:, None]
    after = (sums[hi] - sums[gap + 1]) / (hi - gap - 1)[:, None]
    a, b = np.linalg.norm(before, axis=1), np.linalg.norm(after, axis=1)
    ok = (a >= 1e-9) & (b >= 1e-9)
    return np.where(ok, 1 - (before * after).sum(1) / np.where(ok, a * b, 1), 0.0)


Embed = Callable[[list[str]], np.ndarray]


def semantic(text: str, base: int = 512, percentile: float = 0.8, window: int = 3, embed: Embed = hashing_vectors) -> list[Piece]:
    """Cut where the distance of neighbouring sentence windows reaches its percentile, or at twice ``base`` tokens."""
    s = sentences(text)
    if len(s) <= 1:
        return [(text.strip(), {"reason": "final"})] if text.strip() else []
    distance = gap_distances(np.asarray(embed(s), float), window)
    limit = np.quantile(distance, percentile)
    sizes, out, start, total = [count(x) for x in s], [], 0, 0
    for i, n in enumerate(sizes):
        topic = i > 0 and distance[i - 1] >= limit and distance[i - 1] > 0
        full = total + n > 2 * base
        if i > start and (topic or full):
            out.append((" ".join(s[start:i]), {"reason": "safety" if full else "semantic", "token_count": total}))
            start, total = i, 0
        total += n
    return [*out, (" ".join(s[start:]), {"reason": "final", "token_count": total})]


def hybrid_scores(sizes: list[int], distance: np.ndarray, base: int, alpha: float, beta: float) -> np.ndarray:
    """Combined score of each gap: distance, and how full and how unusual the sentence before it is."""
    n = np.array(sizes, float)
    filled = np.minimum(1, (np.cumsum(n) / base) ** 2)
    unusual = np.minimum(1, np.abs(n - n.mean()) / (n.std() + 1e-6) / 3)
    return alpha * distance + beta * (0.7 * filled + 0.3 * unusual)[:-1]


def hybrid(text: str, base: int = 512, alpha: float = 0.7, beta: float = 0.3, percentile: float = 0.85, window: int = 3, embed: Embed = hashing_vectors) -> list[Piece]:
    """Cut after sentences whose combined score reaches its percentile; before 1.3 times ``base`` tokens in any case."""
    s = sentences(text)
    if len(s) <= 1:
        return [(text.strip(), {"reason": "final"})] if text.strip() else []
    sizes = [count(x) for x in s]
    score = hybrid_scores(sizes, gap_distances(np.asarray(embed(s), float), window), base, alpha, beta)
    limit, out, start, total = np.quantile(score, percentile), [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > 1.3 * base:
            out.append((" ".join(s[start:i]), {"reason": "safety", "token_count": total, "boundary_score": float(score[i - 1])}))
            start, total = i, 0
        total += n
        if i < len(s) - 1 and score[i] >= limit:
            out.append((" ".join(s[start : i + 1]), {"reason": "semantic_stat", "token_count": total, "boundary_score": float(score[i])}))
            start, total = i + 1, 0
    if start < len(s):
        out.append((" ".join(s[start:]), {"reason": "final", "token_count": total}))
    return out


def parent_child(doc_id: str, text: str, sizes: tuple[int, ...] = (2048, 512, 128), overlap: int = 0, all_levels: bool = False) -> list[dict]:
    """A tree of recursive splits; each chunk knows its parent, its siblings and, with all levels, its descendants."""
    out: list[dict] = []

    def level(path: str, body: str, depth: int, parent: dict | None) -> list[str]:
        nodes = [{"id": f"{path}#L{depth}#{m['index']}", "text": t, "level": depth, "is_leaf": depth == len(sizes) - 1} for t, m in recursive(body, sizes[depth], overlap)]
        below: list[str] = []
        for k, node in enumerate(nodes):
            node |= {"parent_id": parent["id"] if parent else None, "parent_text": parent["text"][:500] if parent else None}
            node |= {"prev_id": nodes[k - 1]["id"] if k else None, "next_id": nodes[k + 1]["id"] if k + 1 < len(nodes) else None}
            if all_levels or node["is_leaf"]:
                out.append(node)
            node["child_ids"] = level(node["id"], node["text"], depth + 1, node) if not node["is_leaf"] else []
            below += [node["id"], *node["child_ids"]]
        return below

    if text.strip():
        level(doc_id, text, 0, None)
    for k, node in enumerate(out):
        node["global_index"] = k
        if not all_levels:
            node["child_ids"] = []
    return out


_HEADER = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


def layout(text: str, base: int = 512, lineage: bool = True, keep_code: bool = True, keep_tables: bool = True) -> list[Piece]:
    """Markdown by lines: headers begin a chunk and name its lineage, fences stay whole, tables repeat their head after a break."""
    out: list[Piece] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    size, head, rows = 0, [], 0

    def flush() -> None:
        nonlocal held, size
        body = "\n".join(held).strip()
        if body:
            names = [name for _, name in stack]
            prefix = f"[Section: {' > '.join(names)}]\n" if lineage and names else ""
            out.append((prefix + body, {"lineage": " > ".join(names)}))
        held, size = [], 0

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if keep_code and line.lstrip().startswith("```"):
            stop = next((k for k in range(i + 1, len(lines)) if lines[k].lstrip().startswith("```")), len(lines) - 1)
            block = lines[i : stop + 1]
            n = count("\n".join(block))
            if held and size + n > base:
                flush()
            held += block
            size, i, head, rows = size + n, stop + 1, [], 0
            continue
        found = _HEADER.match(line)
        if found:
            flush()
            depth = len(found[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, found[2]))
            head, rows = [], 0
        is_row = keep_tables and line.lstrip().startswith("|")
        if is_row:
            rows += 1
            if rows <= 2:
                head = [*head[: rows - 1], line]
        elif line.strip():
            head, rows = [], 0
        n = count(line)
        if held and line.strip() and size + n > base:
            flush()
            if is_row and rows > 2:
                held = list(head)
                size = count("\n".join(head))
        held.append(line)
        size += n
        i += 1
    flush()
    return out


_DROPPED = {"script", "style", "noscript", "meta", "link"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_ATOMS = {"p", "pre", "li", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.found: list[tuple[str, str, bool]] = []
        self.held: list[str] = []

    def emit(self) -> None:
        body = " ".join("".join(self.held).split())
        if body:
            self.found.append((body, " > ".join(self.path), any(re.fullmatch("h[1-6]", t) for t in self.path)))
        self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.held.append(" ")
            return
        if not any(t in _ATOMS for t in self.path):
            self.emit()
        self.path.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.path:
            return
        while self.path:
            if not any(t in _ATOMS for t in self.path[:-1]):
                self.emit()
            if self.path.pop() == tag:
                break

    def handle_data(self, data: str) -> None:
        if not any(t in _DROPPED for t in self.path):
            self.held.append(data)


def html_elements(html: str) -> list[tuple[str, str, bool]]:
    """(text, path, is header) of the visible elements; comments are none."""
    parser = _Elements()
    parser.feed(html)
    parser.close()
    parser.emit()
    return parser.found


def html_section(html: str, base: int = 512, most: int = 2048, respect_headers: bool = True) -> list[Piece]:
    """Elements packed to ``base`` tokens, joined by a blank line; a header begins a chunk, an element beyond ``most`` is split."""
    out: list[Piece] = []
    held: list[str] = []
    size, path = 0, ""

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(("\n\n".join(held), {"dom_path": path, "token_count": size}))
        held, size = [], 0

    for body, where, is_header in html_elements(html):
        n = count(body)
        if n > most:
            flush()
            out += [(p, {"dom_path": where}) for p, _ in recursive(body, base, 0)]
            continue
        if held and (size + n > base or (respect_headers and is_header)):
            flush()
        if not held:
            path = where
        held.append(body)
        size += n
    flush()
    return out


def python_ast(source: str, most: int = 1000, imports: bool = True, split_classes: bool = True, context: bool = True) -> list[Piece]:
    """Top-level functions and classes, methods one by one; other top-level code is left out; a syntax error falls back to recursive splitting."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError):  # the parser's own stack too
        return [(p, {"node_type": "text"}) for p, _ in recursive(source, most, 0)]
    lines = source.split("\n")

    def code(node: ast.stmt) -> str:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return "\n".join(lines[first - 1 : node.end_lineno])

    found = [code(n) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    head = "\n".join(found) + "\n\n" if imports and found else ""
    out: list[Piece] = []

    def add(body: str, kind: str, name: str, prefix: str = "") -> None:
        whole = (head + prefix + body) if context else body
        if count(whole) > most:
            out.extend((p, {"node_type": kind, "name": name}) for p, _ in recursive(whole, most, 0))
        else:
            out.append((whole, {"node_type": kind, "name": name}))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(code(node), "function", node.name)
        elif isinstance(node, ast.ClassDef):
            methods = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            if split_classes and methods:
                for m in methods:
                    add(code(m), "method", f"{node.name}.{m.name}", f"# Class: {node.name}\n")
            else:
                add(code(node), "class", node.name)
    if not out and source.strip():
        out.append((source.strip(), {"node_type": "module"}))
    return out


def merge_splits(pieces: list[str], base: int, overlap: int, joiner: str, length: Callable[[str], int]) -> list[str]:
    """Greedy merge of pieces up to ``base``, then drop from the front until the rest fits the overlap: the widely known rule of character splitters."""
    out: list[str] = []
    held: list[str] = []
    total, extra = 0, length(joiner) if joiner else 0
    for p in pieces:
        n = length(p)
        if held and total + n + extra > base:
            body = joiner.join(held).strip()
            if body:
                out.append(body)
            while held and (total > overlap or (total + n + extra > base and total > 0)):
                total -= length(held[0]) + (extra if len(held) > 1 else 0)
                held.pop(0)
        held.append(p)
        total += n + (extra if len(held) > 1 else 0)
    body = joiner.join(held).strip()
    return [*out, body] if body else out


def character_split(text: str, base: int = 512, overlap: int = 64, separator: str = "\n\n", length: Callable[[str], int] = count) -> list[str]:
    """One separator, merged up to ``base``."""
    return merge_splits([p for p in (text.split(separator) if separator else list(text)) if p], base, overlap, separator, length)


MARKDOWN = (r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", " ", "")
PYTHON = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")


def separator_split(text: str, base: int = 512, overlap: int = 64, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), regex: bool = False, length: Callable[[str], int] = count) -> list[str]:
    """The first separator that occurs cuts the text, and begins the pieces after it; pieces beyond ``base`` go to the next ones."""
    pattern, rest = separators[-1], ()
    for k, s in enumerate(separators):
        if s == "" or re.search(s if regex else re.escape(s), text):
            pattern, rest = s, separators[k + 1 :]
            break
    if pattern == "":
        pieces = list(text)
    else:
        cuts = [m.start() for m in re.finditer(pattern if regex else re.escape(pattern), text)]
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if text[a:b]]
    out: list[str] = []
    held: list[str] = []
    for p in pieces:
        if length(p) < base:
            held.append(p)
            continue
        out += merge_splits(held, base, overlap, "", length)
        held = []
        out += separator_split(p, base, overlap, rest, regex, length) if rest else [p]
    return out + merge_splits(held, base, overlap, "", length)


def html_header_split(html: str, base: int = 512, overlap: int = 64) -> list[str]:
    """Sections of h1 to h3, then recursive splitting measured in characters."""
    sections: list[list[str]] = [[]]
    for body, path, _ in html_elements(html):
        if re.search(r"(^| )h[123]$", path):
            sections.append([])
        sections[-1].append(body)
    return [p for s in sections if s for p in separator_split("\n".join(s), base, overlap, length=len)]


def json_split(text: str, base: int = 512) -> list[str]:
    """Nested JSON as objects of at most ``base`` characters where a single value allows; not JSON gives none."""
    try:
        value = json.loads(text)
    except ValueError:
        return []
    if isinstance(value, list):
        value = {str(k): v for k, v in enumerate(value)}
    if not isinstance(value, dict):
        return []
    out: list[dict] = [{}]
    size = lambda x: len(json.dumps(x, ensure_ascii=False))

    def put(path: list[str], leaf: object) -> None:
        at = out[-1]
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = leaf

    def walk(node: dict, path: list[str]) -> None:
        for key, v in node.items():
            here, room = [*path, key], base - size(out[-1])
            if size({key: v}) < room:
                put(here, v)
            else:
                if out[-1] and size(out[-1]) >= max(base - 200, 50):
                    out.append({})
                if isinstance(v, dict) and v:
                    walk(v, here)
                else:
                    if out[-1] and size({key: v}) >= base - size(out[-1]):
                        out.append({})
                    put(here, v)

    walk(value, [])
    return [json.dumps(x, ensure_ascii=False) for x in out if x]


def numbered(answer: str) -> list[str]:
    """Items of a numbered list, as a language model writes it."""
    return [m[1].strip() for m in (re.match(r"^\s*\d+[.)]\s*(.*\S)", line) for line in answer.split("\n")) if m]


def boundaries(answer: str, n: int, every: int = 5) -> list[int]:
    """0-based starts from a JSON list of 1-based sentence numbers, code fences allowed; where it can't be read, every five."""
    body = re.sub(r"```\w*", "", answer)
    found = re.search(r"\[[\d,\s]*\]", body)
    if not found:
        return list(range(0, n, every))
    return sorted({b - 1 for b in json.loads(found[0]) if 1 <= b <= n})



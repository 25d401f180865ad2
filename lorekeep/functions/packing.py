"""Token-bounded packing of one document's blocks. Runs per row inside an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_WORD_OR_SYMBOL = re.compile(r"\w+|[^\w\s]")
TokenCounter = Callable[[str], int]


def word_tokens(text: str) -> int:
    return len(text.split())


def symbol_tokens(text: str) -> int:
    return len(_WORD_OR_SYMBOL.findall(text))


def bpe_tokens(encoding: str = "cl100k_base") -> TokenCounter:
    """Counter over a real subword vocabulary; the vocabulary file must be present on the worker."""
    loaded = []

    def count(text: str) -> int:
        if not loaded:
            import tiktoken

            loaded.append(tiktoken.get_encoding(encoding))
        return len(loaded[0].encode(text))

    return count


def cut(text: str, limit: int, count: TokenCounter) -> list[tuple[str, int]]:
    """Pieces of at most ``limit`` tokens, cut between words; a longer word stands alone."""
    total = count(text)
    if total <= limit:
        return [(text, total)]
    pieces, held, size = [], [], 0
    for word in text.split():
        n = count(word)
        if held and size + n > limit:
            pieces.append((" ".join(held), size))
            held, size = [], 0
        held.append(word)
        size += n
    if held:
        pieces.append((" ".join(held), size))
    return pieces


class Chunk:
    __slots__ = ("texts", "headings", "pages", "tokens")

    def __init__(self, text, headings, page, tokens):
        self.texts, self.headings, self.pages, self.tokens = [text], headings, [page], tokens

    def n_words(self) -> int:
        return sum(word_tokens(text) for text in self.texts)


def pack(blocks: Iterable[tuple], limit: int, merge_peers: bool, count: TokenCounter) -> list[Chunk]:
    """Greedy left-to-right packing of (kind, level, headings, page_no, text) blocks: a piece joins
    the open chunk if the heading trail is the same and the token sum stays within the limit.

    Heading blocks only move the trail; a block without a trail of its own takes the running one.
    """
    chunks: list[Chunk] = []
    trail: dict[int, str] = {}
    running: list[str] = []
    last = None
    for kind, level, headings, page, text in blocks:
        if kind == "heading":
            trail = {n: t for n, t in trail.items() if n < level}
            trail[level] = text
            running = [trail[n] for n in sorted(trail)]
            continue
        if headings is None:
            headings = running
        for piece, size in cut(text, limit, count):
            if merge_peers and last and last.tokens + size <= limit and last.headings == headings:
                last.texts.append(piece)
                last.pages.append(page)
                last.tokens += size
            else:
                last = Chunk(piece, headings, page, size)
                chunks.append(last)
    return chunks

"""Per-page HTML reading: one pass yields cleaned source, text, links and blocks.

This is the only place that looks inside a page. It runs as an Arrow UDF, one page per row, and
Spark spreads the pages; nothing here keeps state between rows.

Tree rules are those of a lenient parser that never closes elements on its own: a void element
closes at once, an end tag closes back to its nearest open match, an unmatched end tag is ignored,
and whatever is still open ends with the page.
"""

from __future__ import annotations

from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

# Elements and class words that are dropped with everything inside them.
DROPPED_TAGS = frozenset(["nav", "script", "style", "noscript"])
NOISE_CLASSES = ("cookie", "popup", "modal", "advertisement", "ad-banner")
HIDING_STYLES = ("display:none", "visibility:hidden")

# Elements without content, per the HTML standard.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Text directly under these is markup support, not reading text.
_UNREAD = frozenset(["rt", "rp", "template"])
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
# Elements that end the running paragraph when they open or close.
_BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)


def table_lines(rows: list[list[str]]) -> list[str]:
    """``row, column = value`` for every cell right of the first column and below the header."""
    if not rows:
        return []
    header = rows[0]
    return [
        f"{row[0]}, {header[j]} = {row[j]}"
        for row in rows[1:]
        for j in range(1, min(len(row), len(header)))
    ]


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class PageReader(HTMLParser):
    def __init__(self, html: str, blocks: bool):
        super().__init__(convert_charrefs=False)
        self._html = html
        self._want_blocks = blocks
        self._starts = [0]
        at = html.find("\n")
        while at >= 0:
            self._starts.append(at + 1)
            at = html.find("\n", at + 1)
        self._open: list[str] = []
        self._open_count: Counter = Counter()
        self._hidden_at: int | None = None
        self._hidden_from = 0
        self._kept_until = 0
        self.kept: list[str] = []
        self.text: list[str] = []
        self.links: list[str] = []
        self.blocks: list[dict] = []
        self._run: list[str] = []
        self._kind, self._level = "paragraph", 0
        self._trail: dict[int, str] = {}
        self._rows: list[list[str]] | None = None
        self.feed(html)
        self.close()
        self._close_back_to(0, len(html), len(html))
        self.kept.append(html[self._kept_until :])
        self._flush()
        self._end_table()

    # position bookkeeping

    def _here(self) -> int:
        line, column = self.getpos()
        return self._starts[line - 1] + column

    def _cut(self, start: int, end: int) -> None:
        self.kept.append(self._html[self._kept_until : start])
        self._kept_until = max(end, start)

    def _close_back_to(self, depth: int, inner_end: int, outer_end: int) -> None:
        """Close every open element above ``depth``; the lowest of them ends at ``outer_end``."""
        if self._hidden_at is not None and self._hidden_at >= depth:
            self._cut(self._hidden_from, outer_end if self._hidden_at == depth else inner_end)
            self._hidden_at = None
        for tag in self._open[depth:]:
            self._open_count[tag] -= 1
        del self._open[depth:]

    # parser events

    def handle_starttag(self, tag, attrs):
        named = {}
        for name, value in attrs:
            named[name] = value or ""
        if tag == "a" and "href" in named:
            self.links.append(named["href"])
        noise = tag in DROPPED_TAGS
        if not noise and "class" in named:
            lowered = named["class"].lower()
            noise = any(word in lowered for word in NOISE_CLASSES)
        if not noise and "style" in named:
            noise = any(rule in named["style"] for rule in HIDING_STYLES)
        start = self._here()
        if tag in VOID:
            if self._hidden_at is None:
                if noise:
                    self._cut(start, start + len(self.get_starttag_text()))
                elif tag in ("br", "hr"):
                    self._break(tag, opening=True)
            return
        if self._hidden_at is None:
            if noise:
                self._hidden_at, self._hidden_from = len(self._open), start
            else:
                self._break(tag, opening=True)
        self._open.append(tag)
        self._open_count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            end = self._here() + len(self.get_starttag_text())
            if self._hidden_at is None:
                self._break(tag, opening=False)
            self._close_back_to(len(self._open) - 1, end, end)

    def handle_endtag(self, tag):
        if not self._open_count[tag]:
            return
        if self._hidden_at is None:
            self._break(tag, opening=False)
        start = self._here()
        stop = self._html.find(">", start)
        depth = len(self._open) - 1
        while self._open[depth] != tag:
            depth -= 1
        self._close_back_to(depth, start, len(self._html) if stop < 0 else stop + 1)

    def handle_data(self, data):
        if self._hidden_at is not None or any(self._open_count[tag] for tag in _UNREAD):
            return
        self.text.append(data)
        if self._want_blocks and not self._open_count["title"]:
            self._run.append(data)

    def handle_entityref(self, name):
        """A known name, with or without its semicolon; an unknown one stays as text."""
        self.handle_data(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[len("CDATA[") :])

    # blocks

    def _break(self, tag: str, opening: bool) -> None:
        if not self._want_blocks:
            return
        if tag == "br":
            self._run.append("\n")
            return
        if tag not in _BREAKING:
            return
        nested = self._open_count["table"] > (0 if opening else 1)
        if self._rows is not None and nested and tag == "table":
            return
        if self._rows is not None and tag in ("tr", "td", "th"):
            self._cell(tag, opening)
            return
        if self._rows is not None and tag != "table":
            self._run.append(" ")
            return
        self._flush()
        if tag == "table":
            self._end_table()
            self._rows = [] if opening else None
        elif opening and tag in _HEADINGS:
            self._kind, self._level = "heading", _HEADINGS[tag]
        elif opening and tag == "li":
            self._kind = "list_item"

    def _cell(self, tag: str, opening: bool) -> None:
        text = _squeeze(self._run)
        self._run = []
        if text:
            if not self._rows:
                self._rows.append([""])
            if not self._rows[-1]:
                self._rows[-1].append("")
            last = self._rows[-1][-1]
            self._rows[-1][-1] = f"{last} {text}" if last else text
        if opening:
            if tag == "tr" or not self._rows:
                self._rows.append([])
            if tag != "tr":
                self._rows[-1].append("")

    def _end_table(self) -> None:
        if self._rows is None:
            return
        rows = [row for row in self._rows if any(row)]
        self._rows = None
        lines = table_lines(rows) or [", ".join(row) for row in rows]
        if lines:
            self._emit("table", 0, ". ".join(lines))

    def _flush(self) -> None:
        if self._rows is not None:
            self._cell("td", opening=False)
            return
        text = _squeeze(self._run)
        self._run = []
        kind, level = self._kind, self._level
        self._kind, self._level = "paragraph", 0
        if text:
            self._emit(kind, level, text)

    def _emit(self, kind: str, level: int, text: str) -> None:
        if kind == "heading":
            self._trail = {n: t for n, t in self._trail.items() if n < level}
            self._trail[level] = text
        self.blocks.append(
            {
                "ix": len(self.blocks),
                "kind": kind,
                "level": level,
                "headings": [self._trail[n] for n in sorted(self._trail)],
                "page_no": None,
                "text": text,
            }
        )

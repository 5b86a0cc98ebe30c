"""Tables of HTML pages as grids of cell texts (UD-1, AG-6).

One scan from markup to markup, by the rules of ``html``.  Every table becomes
a grid in which a cell that spans rows or columns fills all its places, so the
header of a column stands above it whatever the markup.

* A cell or row ends where the next one starts, at its end tag or with its table.
* A table within a cell is a table of its own; its text is not part of the cell.
* ``rowspan=0`` runs to the end of its table, a span that is no number counts 1;
  spans are bounded by HTML's own limits (1,000 columns, 65,534 rows) and by
  the rows that are there.
* White space is one space; ``br`` and block elements within a cell separate words.
* ``script``, ``style`` and ``noscript`` hold no text.
"""

from __future__ import annotations

import re
from html import unescape

from filingflow.functions import html

# Limits of spans and elements that separate words.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
_SEPARATE = frozenset("br p div li ul ol hr h1 h2 h3 h4 h5 h6 blockquote".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""")
_SILENT = ("script", "style", "noscript")
# A whole tag whose quotes end, as ``html.tag_end`` reads it: "/" of an end tag, name, inside.  An end tag with "="
# and what doesn't fit are left to the scan.
_TAG = re.compile(r"""<(?:([A-Za-z][^\s/>=]*)(?=[\s/>=])([^>=]*(?:=[ \t\r\n\f]*(?:"[^"]*"|'[^']*'|[^"' \t\r\n\f>][^ \t\r\n\f>]*(?=[ \t\r\n\f>])|(?=>))[^>=]*)*)>"""
                  r"""|/([A-Za-z][^\s/>=]*)(?=[\s/>])([^>=]*)>)""")


def _span(value: str | None, most: int, zero: int) -> int:
    value = (value or "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    n = int(value[:9])
    return min(n, most) if n else zero


def _cell_text(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


class _Table:
    def __init__(self, number: int):
        self.number, self.rows, self.cell = number, [], None

    def start_row(self) -> None:
        self.cell = None
        self.rows.append([])

    def start_cell(self, attrs: dict | None) -> None:
        if not self.rows:
            self.start_row()
        self.cell = []
        if not attrs:
            self.rows[-1].append((self.cell, 1, 1))
            return
        self.rows[-1].append((self.cell, _span(attrs.get("colspan"), MAX_COLSPAN, 1),
                              _span(attrs.get("rowspan"), MAX_ROWSPAN, MAX_ROWSPAN)))

    def grid(self) -> list[list[str]]:
        grid, held = [], {}  # held: column -> (text, rows still to fill)
        for cells in self.rows:
            if not held and all(across == 1 == down for _, across, down in cells):
                grid.append([_cell_text(parts) for parts, _, _ in cells])
                continue
            row, fresh = {}, {}
            for col, (text, left) in held.items():
                row[col] = text
                if left > 1:
                    fresh[col] = (text, left - 1)
            col = 0
            for parts, across, down in cells:
                while col in row:
                    col += 1
                text = _cell_text(parts)
                for col in range(col, col + across):
                    if col in row:  # overlaps a cell from above: that one stays
                        break
                    row[col] = text
                    if down > 1:
                        fresh[col] = (text, down - 1)
            held = fresh
            grid.append([row.get(c, "") for c in range(max(row, default=-1) + 1)])
        return grid


_RAW = ("script", "style")
_WANTED = frozenset(("table", "tr", "td", "th", *_SEPARATE, *_SILENT))


def _markup(page: str):
    """``(text before, tag or None, is an end tag, tag's inside)`` from markup to markup."""
    at, text, last, quotes, comments = page.find("<"), 0, page.rfind(">"), True, True
    while 0 <= at < last:
        whole = _TAG.match(page, at) if quotes else None
        if whole:
            name, inside, ended, end_inside = whole.groups()
            tag = (ended or name).lower()
            if tag not in _RAW:
                if tag in _WANTED:
                    yield page[text:at], tag, name is None, inside if name else end_inside
                else:
                    yield page[text:at], None, False, ""
                text = whole.end()
                at = page.find("<", text)
                continue
        head = page[at + 1]
        if not (head.isascii() and head.isalpha()) and head not in "/!?":
            at = page.find("<", at + 1)
            continue
        before, tag, ends, inside = page[text:at], None, head == "/", ""
        if head in "!?":
            text = 0
            if comments and page.startswith("<!--", at):
                text = page.find("-->", at + 4) + 3
                comments = text > 2  # one that never ends is a declaration
                text = text if comments else 0
            text = text or page.find(">", at) + 1
        else:
            text = -1 if ends or not quotes else html.tag_end(page, at)
            if text < 0:
                quotes, text = quotes and ends, page.find(">", at) + 1
            tag = _NAME.match(page, at + 1 + ends)
            tag = tag.group().lower() if tag else None
            if tag in _WANTED:
                inside = page[at + 1 + len(tag):text - 1]
            else:
                tag = None
            if tag in _RAW:
                if not ends and not inside.endswith("/"):
                    text = html.raw_end(page, text, tag)
                tag = None
        yield before, tag, ends, inside
        at = page.find("<", text)
    yield page[text:], None, False, ""


def _spans(inside: str) -> dict:
    found = {}
    if "span" in inside.lower():
        for name, value in _ATTRIBUTE.findall(inside):
            found.setdefault(name.lower(), value.strip("\"'"))
    return found


def _tables(page: str) -> list[_Table]:
    tables, open_, silent = [], [], 0
    for text, tag, ends, inside in _markup(page):
        cell = open_[-1].cell if open_ and not silent else None
        if cell is not None and text:
            cell.append(text)
        if tag is None:
            continue
        if tag == "noscript":
            if not inside.endswith("/"):
                silent = max(0, silent - 1) if ends else silent + 1
        elif tag == "table":
            if not ends:
                tables.append(_Table(len(tables)))
                open_.append(tables[-1])
            elif open_:
                open_.pop()
        elif tag in _SEPARATE:
            if cell is not None:
                cell.append(" ")
        elif not open_:
            continue
        elif ends:
            open_[-1].cell = None
        elif tag == "tr":
            open_[-1].start_row()
        else:
            open_[-1].start_cell(_spans(inside) if inside else None)
    return tables


def page_grids(page: str) -> list[dict]:
    """``[{"table_no", "rows": [[text]]}]`` in document order; tables without rows are left out."""
    return [{"table_no": t.number, "rows": t.grid()} for t in _tables(page) if t.rows]

"""Text outside of HTML markup, by one linear scan (SC-6, SC-7).

The scan moves from markup to markup and knows six states: text, tag, quoted
attribute value, declaration, comment and raw text.  No state is entered twice
for one character, so a page costs time in proportion to its length.

* A tag starts with ``<`` and a letter or ``/``; other ``<`` are text.  A ``>``
  within a quoted value doesn't end a start tag.  Quotes count only as the
  first character of a value.
* A declaration (``<!`` or ``<?``) ends at the first ``>``, a comment at
  ``-->``; a comment that never ends is a declaration.
* ``script`` and ``style`` hold raw text up to their end tag.  Everything in
  them and in ``noscript``, which may nest and hold markup, is dropped.  Left
  open, they run to the end of the page; written as ``<script/>`` they are empty.
* A quote that never ends makes its tag end at the first ``>``; from there on
  the page is taken not to quote.  Markup without any ``>`` after it is text.

Every tag, comment and declaration becomes one space.
"""

from __future__ import annotations

import pandas as pd

_SPACE = " \t\r\n\f"
_RAW, _DROPPED = ("script", "style"), ("script", "style", "noscript")


def tag_end(page: str, at: int) -> int:
    """Index after the ``>`` of the start tag at ``at``; -1 if a quote never ends."""
    j, close = at + 1, page.find(">", at + 1)
    while True:
        if close < j:
            close = page.find(">", j)
            if close < 0:
                return -1
        equals = page.find("=", j, close)
        if equals < 0:
            return close + 1
        j = equals + 1
        while page[j] in _SPACE:  # ends at close
            j += 1
        if page[j] in "\"'":
            j = page.find(page[j], j + 1) + 1
            if not j:
                return -1
        else:
            while page[j] not in _SPACE and page[j] != ">":
                j += 1


def _name(page: str, at: int) -> str:
    """The element's name at ``at``, if it is one whose content is dropped."""
    for name in _DROPPED:
        end = at + len(name)
        if page[at:end].lower() == name and page[end:end + 1] in (">", "/", *_SPACE, ""):
            return name
    return ""


def raw_end(page: str, at: int, name: str) -> int:
    """Index of the end tag that ends raw text, or the page's end."""
    while (at := page.find("</", at)) >= 0:
        if _name(page, at + 2) == name:
            return at
        at += 2
    return len(page)


def text_outside_markup(page: str) -> str:
    at = page.find("<")
    if at < 0:
        return page
    last, quotes, open_, comments = page.rfind(">"), True, 0, True
    out, text = [], 0
    while 0 <= at < last:
        head = page[at + 1]
        if not (head.isascii() and head.isalpha()) and head not in "/!?":
            at = page.find("<", at + 1)
            continue
        if not open_:
            out.append(page[text:at])
        name = ""
        if head in "!?":
            end = page.find("-->", at + 4) + 3 if comments and page.startswith("<!--", at) else 2
            if end == 2:
                comments = comments and not page.startswith("<!--", at)
                end = page.find(">", at) + 1
        elif head == "/":
            end = page.find(">", at) + 1
            if _name(page, at + 2) == "noscript":
                open_ = max(0, open_ - 1)
        else:
            end = tag_end(page, at) if quotes else -1
            if end < 0:
                quotes, end = False, page.find(">", at) + 1
            name = _name(page, at + 1) if page[end - 2] != "/" else ""
        if name in _RAW:
            end = raw_end(page, end, name)
        elif name:
            open_ += 1
        text = end
        at = page.find("<", end)
    if not open_:
        out.append(page[text:])
    return " ".join(out)


def series_outside_markup(pages: pd.Series) -> pd.Series:
    return pages.map(text_outside_markup, na_action="ignore")

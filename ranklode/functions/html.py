"""Pages of HTML, broken markup included: a tokenizer of the usual states, and what is read off it.

``tokens`` goes through a page once. Data, tags with their attributes (double, single or no
quotes), end tags, comments, declarations and the contents of elements that hold no markup are told apart as
browsers do: a ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text; a tag or comment that
never ends takes the rest of the page with it; an attribute that comes twice counts once. All
numeric and named references are decoded; in attributes one without semicolon before ``=`` or a letter or
digit stays, so that queries of URLs live.

``page`` runs in Arrow batches, a page at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklode.functions.text import col

# Elements whose contents are no markup, without and with references; elements
# that begin and end lines.
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
ESCAPED = frozenset(("title", "textarea"))
LINES = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr td th dl dt dd article nav section header footer aside main blockquote pre form hr center caption address option".split())
# End of fixed values.

SPACE = " \t\n\r\f"
NAME = re.compile(r"[^ \t\n\r\f/>]+")
KEY = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
BARE = re.compile(r"[^ \t\n\r\f>]*")
SKIP = re.compile(r"[ \t\n\r\f/]*")
BLANKS = re.compile(r"[ \t\n\r\f]*")
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")
CLOSERS = {name: re.compile(f"</{name}(?=[ \\t\\n\\r\\f/>])", re.IGNORECASE) for name in RAW | ESCAPED}


def decoded(value: str) -> str:
    """An attribute's value with its references decoded."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#" or name.endswith(";") or (not m[2] and name in entities.entities.html5):
            return entities.unescape(f"&{name}") + m[2]
        return m[0]

    return REFERENCE.sub(one, value) if "&" in value else value


def _attributes(s: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place within a tag, and where the tag ends (-1: never)."""
    out: dict[str, str] = {}
    while True:
        at = SKIP.match(s, at).end()
        if at >= len(s):
            return out, -1
        if s[at] == ">":
            return out, at + 1
        key = KEY.match(s, at)
        at, value = BLANKS.match(s, key.end()).end(), ""
        if s.startswith("=", at):
            at = BLANKS.match(s, at + 1).end()
            if s[at : at + 1] in ('"', "'") and at < len(s):
                end = s.find(s[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = s[at + 1 : end], end + 1
            else:
                bare = BARE.match(s, at)
                value, at = bare[0], bare.end()
        out.setdefault(key[0].lower(), decoded(value))


def tokens(s: str) -> Iterator[tuple]:
    """("text", characters), ("open", name, attributes), ("close", name), and ("inside", name,
    characters) for what an element without markup holds; references in texts are decoded."""
    at = 0
    while at < len(s):
        left = s.find("<", at)
        if left < 0:
            yield "text", entities.unescape(s[at:])
            return
        after = s[left + 1 : left + 2]
        closing = after == "/"
        if closing:
            after = s[left + 2 : left + 3]
        if after.isascii() and after.isalpha():
            if left > at:
                yield "text", entities.unescape(s[at:left])
            name = NAME.match(s, left + 1 + closing)
            attributes, at = _attributes(s, name.end())
            if at < 0:
                return
            tag = name[0].lower()
            yield ("close", tag) if closing else ("open", tag, attributes)
            if not closing and tag in CLOSERS:
                end = CLOSERS[tag].search(s, at)
                inside = s[at : end.start() if end else len(s)]
                yield "inside", tag, entities.unescape(inside) if tag in ESCAPED else inside
                at = end.start() if end else len(s)
        elif s.startswith("<!--", left):
            if left > at:
                yield "text", entities.unescape(s[at:left])
            short = next((x for x in ("<!-->", "<!--->") if s.startswith(x, left)), None)
            if short:
                at = left + len(short)
                yield "comment", ""
                continue
            end = re.compile("--!?>").search(s, left + 4)
            yield "comment", s[left + 4 : end.start() if end else len(s)]
            if not end:
                return
            at = end.end()
        elif after in ("!", "?") or (closing and after):
            if left > at:
                yield "text", entities.unescape(s[at:left])
            end = s.find(">", left + 1)
            if end < 0:
                return
            if end > left + 2:
                yield "comment", s[left + 2 : end]
            at = end + 1
        else:
            yield "text", entities.unescape(s[at : left + 1])
            at = left + 1


def tidy(text: str) -> str:
    """Runs of blanks as one, lines without blanks around them, no empty lines."""
    text = re.sub("[ \t ]+", " ", text)
    return re.sub(" ?\n[ \n]*", "\n", text).strip(" ")


def parse(s: str) -> tuple:
    """title, text (without the title), description, keywords, base, links (href, text)."""
    title, base, text, links, meta = None, None, [], [], {"description": "", "keywords": ""}
    href, inner = None, []

    def close():
        nonlocal href
        if href is not None:
            links.append((href, "".join(inner).strip(" ")))
        href = None
        inner.clear()

    for kind, *what in tokens(s):
        if kind == "text":
            text.append(what[0])
            if href is not None:
                inner.append(what[0])
        elif kind == "inside":
            if what[0] == "title":
                title = what[1] if title is None else title
            elif what[0] == "textarea":
                text.append(what[1])
        elif kind == "comment":
            text.append(" ")
        else:
            name = what[0]
            text.append("\n" if name in LINES else " " if name in CLOSERS and kind == "open" else "")
            if name == "a":
                close()
                if kind == "open":
                    href = what[1].get("href")
            elif kind == "open":
                if name == "base" and base is None:
                    base = what[1].get("href")
                elif name in ("frame", "iframe") and what[1].get("src") is not None:
                    links.append((what[1]["src"], ""))
                elif name == "meta" and what[1].get("name", "").lower() in meta:
                    meta[what[1]["name"].lower()] += what[1].get("content", "")
    close()
    return (title or "").strip(" "), tidy("".join(text)), meta["description"], meta["keywords"], base, links


PAGE = "title string, text string, description string, keywords string, base string, links array<struct<href:string, text:string>>"


def page(c) -> Column:
    """A struct of title, text, description, keywords, base and links; null pages are null."""

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = [parse(x) if x is not None else (None,) * 6 for x in pages]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ", 5)])
            out["links"] = [None if x is None else [{"href": h, "text": t} for h, t in x] for x in out["links"]]
            yield out

    return F.when(col(c).isNotNull(), run(col(c)))

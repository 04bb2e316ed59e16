"""HTML as readers see it: a tokenizer of tags, comments and text over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points of the Unicode property White_Space (fixed values).
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Elements that stand on lines of their own; text on both sides of their tags isn't one word (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary "
    "table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements whose content isn't shown; nothing but their own end tag ends the first three (fixed values).
RAW, UNSEEN = ("script", "style", "template"), ("head",)
#: Elements of text without tags inside (fixed values).
PLAIN = ("title", "textarea")
#: A tag from its name on. A quote counts only right after an equals sign.
NAME = re.compile(r"/?([A-Za-z][^\t\n\f\r />]*)")
REST = re.compile(r"""(?:[^>=]++|=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")
COMMENT = re.compile(r"-->|--!>")
ENDS = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.IGNORECASE) for name in (*RAW, *PLAIN)}
END_OF_HEAD = re.compile(r"</head(?=[\t\n\f\r />])|<body(?=[\t\n\f\r />])", re.IGNORECASE)


def tokens(html: str) -> Iterator[tuple[str, str]]:
    """("text", raw text), ("tag", lower-cased name) and nothing for comments, declarations and elements that aren't shown.

    A `<` begins a tag only before a letter, or `/` and a letter; comments end at `-->`, other
    declarations at `>`. A tag or comment that the text's end cuts off is dropped.
    """
    at, end = 0, len(html)
    while at < end:
        sign = html.find("<", at)
        if sign < 0:
            yield "text", html[at:]
            return
        if sign > at:
            yield "text", html[at:sign]
        tag = NAME.match(html, sign + 1)
        if tag is None:
            follows = html[sign + 1 : sign + 2]
            if html.startswith("<!--", sign):
                short = html.startswith((">", "->"), sign + 4)
                stop = html.find(">", sign + 4) + 1 if short else (m.end() if (m := COMMENT.search(html, sign + 4)) else 0)
            elif follows and follows in "!?/":
                stop = html.find(">", sign + 1) + 1
            else:
                yield "text", "<"
                at = sign + 1
                continue
            if not stop:
                return
            at = stop
            continue
        rest = REST.match(html, tag.end())
        if rest is None:
            return
        at, name = rest.end(), tag[1].lower()
        yield "tag", name
        if html[sign + 1] == "/":
            continue
        if name in RAW or name in PLAIN:
            stop = ENDS[name].search(html, at)
            if name in PLAIN:
                yield "text", html[at : stop.start() if stop else end]
            at = stop.start() if stop else end
        elif name in UNSEEN:
            stop = END_OF_HEAD.search(html, at)
            at = stop.start() if stop else end


def plain_text(html: str) -> str:
    """The text that is shown: entities decoded once, tags of blocks as spaces, others as nothing, white space collapsed."""
    out = []
    for kind, value in tokens(html):
        if kind == "text":
            out.append(unescape(value) if "&" in value else value)
        elif value in BLOCKS:
            out.append(" ")
    return SPACES.sub(" ", "".join(out)).strip(" ")


@F.pandas_udf(StringType())
def _plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        yield pd.Series([None if x is None else plain_text(x) for x in html], dtype=object)


def html_to_text(html: Column) -> Column:
    """plain_text of each value; values without tags and entities stay in the JVM, nulls stay null."""
    marked = F.contains(html, F.lit("<")) | F.contains(html, F.lit("&"))
    collapsed = F.trim(F.regexp_replace(html, f"[{SPACES.pattern[1:-2]}]+", " "))
    return F.when(marked, _plain(F.when(marked, html))).otherwise(collapsed)

"""A single-pass HTML tokenizer for links: what a parser would see, without building a tree.

The text is read once from left to right. Comments, declarations, and the contents of script, style
and the other raw-text elements are passed over; start tags are taken apart attribute by attribute
(quoted either way or bare, names in any case, the first of a name counts); a stack of the open
element names tells where an anchor and its first ``<span>`` end, closed or not: by their own end tag,
by that of an element around them, for an anchor also by the next anchor. Character references in
texts and attribute values are decoded, numeric ones included. A ``<`` that begins nothing is text.
The work is linear in the text's length, however it is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())

# A comment, a declaration or instruction, an end tag, a start tag's name. The repeats are possessive:
# nothing is tried twice.
_MARKUP = re.compile(r"<(?:(!--)|([!?])|/([a-zA-Z][^\s/>]*+)|([a-zA-Z][^\s/>]*+))")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?))?)""")
_COMMENT_END = re.compile(r"--!?>")


def _attributes(text: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes of a start tag and the place behind it; None if the text ends inside it."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(text, at)
        if m is None:
            return None, len(text)
        at = m.end()
        if m[1]:
            return found, at
        quoted = m[3] if m[3] is not None else m[4]
        if quoted is None and m[5] is None and text[at: at + 1] in ('"', "'") and text[m.end(2): at].strip() == "=":
            return None, len(text)  # a quote that is never closed
        found.setdefault(m[2].lower(), quoted if quoted is not None else m[5] or "")


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("start", name, attributes) and ("end", name, None), in order."""
    at = kept = 0
    while True:
        m = _MARKUP.search(text, at)
        if m is None:
            break
        if m.start() > kept:
            yield "text", text[kept: m.start()], None
        at = m.end()
        if m[1]:
            if text.startswith(">", at) or text.startswith("->", at):  # an empty comment, cut short
                at = text.index(">", at) + 1
            else:
                end = _COMMENT_END.search(text, at)
                at = end.end() if end else len(text)
        elif m[2] or m[3]:
            end = text.find(">", at)
            at = end + 1 if end >= 0 else len(text)
            if m[3] and end >= 0:
                yield "end", m[3].lower(), None
        else:
            name = m[4].lower()
            attributes, at = _attributes(text, at)
            if attributes is not None:
                yield "start", name, attributes
                if name in RAW_TEXT:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
                    end = close.start() if close else len(text)
                    if name in ("textarea", "title") and end > at:
                        yield "text", text[at:end], None
                    at = end
        kept = at
    if kept < len(text):
        yield "text", text[kept:], None


def anchors(text: str) -> Iterator[tuple[str, str, str]]:
    """(href, class, text) of every anchor with a ``href``, in the order of their start tags. The text
    is that of the first ``<span>`` in the anchor, else of the anchor, stripped."""
    if "<a" not in text and "<A" not in text:
        return
    stack: list[str] = []  # names of open elements
    open_names: Counter[str] = Counter()
    anchor = None  # (place on the stack, attributes)
    whole: list[str] = []
    span: list[str] | None = None
    span_at: int | None = None  # place of the first span on the stack, while it is open

    def done() -> tuple[str, str, str]:
        found = "".join(whole if span is None else span)
        return html.unescape(anchor[1]["href"]), html.unescape(anchor[1].get("class", "")), html.unescape(found).strip()

    for kind, value, attributes in tokens(text):
        if kind == "text":
            if anchor:
                whole.append(value)
                if span_at is not None:
                    span.append(value)
            continue
        down = None  # the stack is cut to this length
        if kind == "end":
            if open_names[value]:
                down = len(stack) - 1
                while stack[down] != value:
                    down -= 1
        elif value == "a" and open_names["a"]:
            down = len(stack) - 1
            while stack[down] != "a":
                down -= 1
        if down is not None:
            for name in stack[down:]:
                open_names[name] -= 1
            del stack[down:]
            if span_at is not None and span_at >= down:
                span_at = None
            if anchor and anchor[0] >= down:
                if "href" in anchor[1]:
                    yield done()
                anchor = None
        if kind == "start" and value not in VOID:
            if value == "a":
                anchor, whole, span, span_at = (len(stack), attributes), [], None, None
            elif value == "span" and anchor and span is None:
                span, span_at = [], len(stack)
            stack.append(value)
            open_names[value] += 1
    if anchor and "href" in anchor[1]:
        yield done()

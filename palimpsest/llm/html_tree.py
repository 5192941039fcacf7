"""Pages as streams of tokens, read once from left to right, and the blocks that the tokens open and close."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from xxhash import xxh64_hexdigest

#: A text and a tag that has nothing special in it: most of a page.
_PLAIN = re.compile(r"([^<]*)<(/?)([a-zA-Z][\w:-]*)([^<>\"']*)>")
_NAME = re.compile(r"/?[a-zA-Z][\w:-]*")
_SPECIAL = re.compile(r"[\"'<>]")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Elements that stand in the flow of their block's words. All others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind ends.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end a paragraph which is still open.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

BOILERPLATE_TAGS = frozenset("head title nav footer aside form button select menu dialog object".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "widget toolbar pagination pager search complementary contentinfo".split()
)
HEADER_WORDS = frozenset(["header", "masthead"])
CONTENT_TAGS = ("article", "main")
#: The signature of a text.
TEXT = "#"
#: Longer names enter a signature as a hash.
_LONGEST_NAMES = 40
#: Attributes up to so many characters are described once for all tags that have the same, of so many different ones.
_LONGEST_KNOWN, _MOST_KNOWN = 200, 20_000


@dataclass(slots=True)
class Node:
    """A block of a page: an element with its blocks in order, or a text (signature TEXT). ``boilerplate`` comes from its own tag and names."""

    signature: str
    tag: str = ""
    boilerplate: bool = False
    inside_content: bool = False
    children: list[Node] = field(default_factory=list)
    text: str = ""
    #: Characters of the text that stand in links.
    linked: int = 0


def _tag_end(page: str, at: int, dead: set[int], closed: dict[str, bool]) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``; -1 if another ``<`` comes first, -2 if the page ends.

    A quote counts after an equals sign. ``dead`` holds the quotes from which no end was found, and ``closed``
    whether a kind of quote still comes: no part of the page is scanned again and again from tags that never end.
    """
    opened = []
    while found := _SPECIAL.search(page, at):
        k = found.start()
        c = page[k]
        if c == ">":
            return k
        if c == "<" or k in dead:
            dead.update(opened)
            return -1
        at = k + 1
        if page[max(k - 64, 0) : k].rstrip()[-1:] == "=":
            end = page.find(c, k + 1) if closed.get(c, True) else -1
            if end < 0:
                closed[c] = False
            else:
                opened.append(k)
                at = end + 1
    dead.update(opened)
    return -2


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) or ("close", name, ""), in turn. Comments, scripts and the like are left out."""
    at, n, dead, closed = 0, len(page), set(), {}
    while at < n:
        if plain := _PLAIN.match(page, at):
            text, end, tag, attributes = plain.groups()
            if text:
                yield "text", text, ""
            tag = tag.lower()
            at = plain.end()
            if end:
                yield "close", tag, ""
            elif tag not in _RAW:
                yield "open", tag, attributes
            else:
                ended = _RAW[tag].search(page, at)
                at = ended.end() if ended else n
            continue
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        name = _NAME.match(page, lt + 1)
        if name is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end = _tag_end(page, name.end(), dead, closed)
        if end == -1:
            yield "text", "<", ""
            at = lt + 1
            continue
        if end == -2:
            return
        tag = name[0].lower()
        at = end + 1
        if tag in _RAW:
            ended = _RAW[tag].search(page, at)
            at = ended.end() if ended else n
        elif tag[0] == "/":
            yield "close", tag[1:], ""
        else:
            yield "open", tag, page[name.end() : end]


def _described(tag: str, attributes: str, inside_content: bool) -> tuple[str, bool]:
    """(signature, whether it is boilerplate)"""
    boilerplate = tag in BOILERPLATE_TAGS or tag == "header" and not inside_content
    if not attributes or attributes.isspace():
        return tag, boilerplate
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes)]
    words = {w for _, v in found for w in re.split(r"[^a-z0-9]+", v)}
    boilerplate |= any(k == "hidden" for k, _ in found) or not words.isdisjoint(BOILERPLATE_WORDS) or not inside_content and not words.isdisjoint(HEADER_WORDS)
    names = " ".join(v for k, v in found if k in ("class", "role") and v)
    if len(names) > _LONGEST_NAMES:
        names = xxh64_hexdigest(names)
    return f"{tag}.{names}" if names else tag, boilerplate


_known_description = lru_cache(_MOST_KNOWN)(_described)


def parse(page: str) -> Node:
    """The blocks of a page's tokens. Ends that are missing are implied."""
    root = Node("")
    stack, open_tags = [root], Counter()
    said: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if said:
            if text := " ".join(html.unescape("".join(said)).split()):
                stack[-1].children.append(Node(TEXT, TEXT, text=text, linked=min(linked, len(text))))
            said.clear()
            linked = 0

    def close(upto: int) -> None:
        nonlocal in_link
        flush()
        in_link = False
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
        del stack[upto:]

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            said.append(tag)
            if in_link:
                linked += len(tag)
        elif tag in INLINE:
            if tag == "br":
                said.append("\n")
            elif tag == "a":
                in_link = kind == "open"
        elif kind == "close":
            if open_tags[tag] > 0:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
        else:
            flush()
            if stack[-1].tag in SELF_ENDING.get(tag, ()) or tag in ENDS_PARAGRAPH and stack[-1].tag == "p":
                close(len(stack) - 1)
            above = stack[-1]
            signature, boilerplate = (_known_description if len(attributes) <= _LONGEST_KNOWN else _described)(tag, attributes, above.inside_content)
            node = Node(signature, tag, boilerplate, above.inside_content or tag in CONTENT_TAGS)
            above.children.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
                open_tags[tag] += 1
    flush()
    return root


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in order, without boilerplate inside it; references are decoded, white space made single spaces."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.signature == TEXT:
            out.append(x.text)
        elif not x.boilerplate or x is node:
            todo.extend(reversed(x.children))
    return out

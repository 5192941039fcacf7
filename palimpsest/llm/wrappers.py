"""Wrappers of a host: union-free regular expressions over the token streams of its pages.

An expression for an element's stream is a sequence of parts: elements with sequences of their own, texts, and
groups of parts that repeat. A page's own stream is the first expression. It is then aligned with one page after
another, level by level. Where the streams disagree, a part whose block, or sequence of blocks, comes again on
either side becomes repeated; what only one side has becomes optional; texts that differ become slots.

The expression then tells which elements hold main text (``choose``), and each page is matched to it (``found``).
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from xxhash import xxh64_intdigest

from palimpsest.llm.html_tree import CONTENT_TAGS, TEXT, Node, blocks, parse

#: Blocks in the longest sequence that is found to repeat; parts of longer ones stand each for itself, and none is lost.
LONGEST_PERIOD = 6
#: Pairs of parts up to which two sequences are aligned by likeness; longer ones are by the order of their signatures.
MOST_PAIRS = 40_000
#: Parts of a text, never all of it.
LEAVES = frozenset([TEXT, *"p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote".split()])
#: The part of the slots' text that makes an element the trunk, and the least part in a block beside the trunk that is text, not furniture.
TRUNK, BESIDE = 0.7, 0.15


@dataclass(slots=True)
class Part:
    """An element, a text, or a group (no signature of its own: its parts in turn). Of a page: ``nodes`` are its blocks there."""

    signature: str
    boilerplate: bool = False
    parts: list[Part] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    group: bool = False
    #: Hashes of a text, one a page: one is fixed text, more are a slot.
    texts: set[int] = field(default_factory=set)
    characters: int = 0
    linked: int = 0
    pages: int = 1
    inside: frozenset[str] = frozenset()
    nodes: list[Node] = field(default_factory=list)
    keep: bool = False
    #: Among the kept parts, one that holds much of the text.
    main: bool = False
    leads: bool = False

    @property
    def tag(self) -> str:
        return self.signature.split(".", 1)[0]

    @property
    def slot(self) -> bool:
        return len(self.texts) > 1


def part_of(node: Node) -> Part:
    """A block by itself, without its parts."""
    if node.signature == TEXT:
        return Part(TEXT, texts={xxh64_intdigest(node.text)}, characters=len(node.text), linked=node.linked, nodes=[node])
    return Part(node.signature, node.boilerplate, inside=frozenset(c.signature for c in node.children), nodes=[node])


def _both(a: Part, b: Part, same_page: bool) -> Part:
    """What is known of a part that two streams have. Repeats on one page have one text together, so that a list which all pages share is no slot."""
    texts, nodes = a.texts | b.texts if b.texts else a.texts, a.nodes
    nodes.extend(b.nodes)
    if same_page and a.texts and b.texts:
        texts = {xxh64_intdigest(repr((sorted(a.texts), sorted(b.texts))))}
    elif len(texts) > 2:
        texts = set(sorted(texts)[:2])
    return Part(
        a.signature, a.boilerplate and b.boilerplate, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, group=a.group, texts=texts, characters=a.characters + b.characters,
        linked=a.linked + b.linked, pages=max(a.pages, b.pages) if same_page else a.pages + b.pages, inside=a.inside if b.inside <= a.inside else a.inside | b.inside, nodes=nodes,
    )


def folded(parts: list[Part], same_page: bool = True) -> list[Part]:
    """The sequence with each block, or sequence of blocks, that follows upon itself made one repeated part."""
    out: list[Part] = []
    for part in parts:
        out.append(part)
        _fold_end(out, same_page)
    return out


def _fold_end(out: list[Part], same_page: bool) -> None:
    """Folds what the last part completes."""
    last = out[-1]
    if len(out) > 1 and not last.group and not out[-2].group and _alike(out[-2], last):
        out[-2:] = [align(out[-2], last, same_page)]
        out[-1].repeated = True
        return
    if len(out) > 1 and out[-2].group and _alike(out[-2].parts[-1], last):
        out.pop()
        end = out[-1].parts[-1] = align(out[-1].parts[-1], last, same_page)
        end.repeated = True
        return
    if last.group:
        return
    for k in range(2, min(LONGEST_PERIOD, len(out) - 1) + 1):
        if out[-k].group:
            return
        before = out[-k - 1]
        if before.group and len(before.parts) == k and all(map(_alike, before.parts, out[-k:])):
            out[-k - 1 :] = [_grouped(before.parts, out[-k:], same_page)]
            return
        if len(out) >= 2 * k and last.signature == before.signature and not any(p.group for p in out[-2 * k : -k]) and all(map(_alike, out[-2 * k : -k], out[-k:])):
            out[-2 * k :] = [_grouped(out[-2 * k : -k], out[-k:], same_page)]
            return


def _alike(a: Part, b: Part) -> bool:
    """Whether a block repeats another: the same signature, and in part the same signatures inside, or a piece of text."""
    return a.signature == b.signature and (a.inside == b.inside or a.tag in LEAVES or 3 * len(a.inside & b.inside) >= len(a.inside | b.inside))


def _grouped(a: list[Part], b: list[Part], same_page: bool) -> Part:
    return Part("(" + " ".join(p.signature for p in a) + ")", parts=[align(p, q, same_page) for p, q in zip(a, b, strict=True)], repeated=True, group=True, pages=max(p.pages for p in a))


def generalise(node: Node) -> Part:
    """The expression of one page's stream."""
    order, made = [node], {}
    for x in order:
        order.extend(x.children)
    for x in reversed(order):
        out = made[id(x)] = part_of(x)
        out.nodes = []
        out.parts = folded([made.pop(id(c)) for c in x.children])
    return made[id(node)]


def _with_squares(a: list[Part], b: list[Part], same_page: bool) -> list[Part]:
    """``a`` with the sequences of blocks that ``b`` has as repeated groups made such groups."""
    for group in (g for g in b if g.group):
        k, out, at = len(group.parts), [], 0
        names = [p.signature for p in group.parts]
        while at < len(a):
            if [p.signature for p in a[at : at + k]] == names:
                found = a[at : at + k]
                at += k
                while [p.signature for p in a[at : at + k]] == names:
                    found = [align(p, q, same_page) for p, q in zip(found, a[at : at + k], strict=True)]
                    at += k
                out.append(Part(group.signature, parts=found, repeated=True, group=True, pages=max(p.pages for p in found)))
            else:
                out.append(a[at])
                at += 1
        a = out
    return a


def likeness(a: Part, b: Part) -> float:
    """0 for parts that do not match; more for those that have the same parts or the same text."""
    if a.signature != b.signature:
        return 0.0
    shared, both = len(a.inside & b.inside), len(a.inside | b.inside)
    return 1 + (shared / both if both else 0.5) + 0.5 * (bool(a.texts) and not a.texts.isdisjoint(b.texts))


def matched(a: list[Part], b: list[Part]) -> list[tuple[int | None, int | None]]:
    """The alignment of two sequences: pairs of places in order, None where one side has no part."""
    if [p.signature for p in a] == [p.signature for p in b]:
        return list(zip(range(len(a)), range(len(b)), strict=True))
    if len(a) * len(b) > MOST_PAIRS:
        return _matched_in_order(a, b)
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    like = [[likeness(p, q) for q in b] for p in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            skip = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(skip, like[i][j] + best[i + 1][j + 1]) if like[i][j] else skip
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and like[i][j] and best[i][j] == like[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i][j] == best[i + 1][j]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _matched_in_order(a: list[Part], b: list[Part]) -> list[tuple[int | None, int | None]]:
    """Each part of ``a`` with the next of its signature in ``b``, if that skips no more of ``b`` than it must on the average."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j].signature, []).append(j)
    out: list[tuple[int | None, int | None]] = []
    at, slack = 0, LONGEST_PERIOD + abs(len(a) - len(b))
    for i, p in enumerate(a):
        own = places.get(p.signature, [])
        while own and own[-1] < at:
            own.pop()
        if own and own[-1] - at <= slack:
            out.extend((None, j) for j in range(at, own[-1]))
            out.append((i, own[-1]))
            at = own.pop() + 1
        else:
            out.append((i, None))
    return out + [(None, j) for j in range(at, len(b))]


def align(a: Part, b: Part, same_page: bool = False) -> Part:
    """The least expression that both match."""
    top = _both(a, b, same_page)
    todo = [(a, b, top)] if a.parts or b.parts else []
    while todo:
        a, b, out = todo.pop()
        left, right = _with_squares(a.parts, b.parts, same_page), _with_squares(b.parts, a.parts, same_page)
        for i, j in matched(left, right):
            if i is None or j is None:
                part = left[i] if j is None else right[j]
                part.optional = True
            else:
                part = _both(left[i], right[j], same_page)
                if left[i].parts or right[j].parts:
                    todo.append((left[i], right[j], part))
            out.parts.append(part)
    return top


def choose(top: Part) -> Part:
    """Marks the parts that hold main text (``keep``) and those on the way to them (``leads``).

    What counts is the slots' text outside links and boilerplate (of a single page: all text). The trunk is the deepest
    element that holds seven tenths of it, and is kept whole, fixed text and all; an article or main element on
    the way is kept whole earlier. Beside the trunk, headings and paragraphs with slots are kept, and blocks
    of more than a bare text that hold a seventh or more of all. Where several elements share the text and articles hold most of it, each of these is kept.
    """
    order, weight, articles = [top], {}, {}
    for w in order:
        order.extend([] if w.boilerplate else w.parts)
    for w in reversed(order):
        inside = [] if w.boilerplate else w.parts
        own = max(0, w.characters - w.linked) if w.signature == TEXT and (w.slot or w.pages == 1) else 0
        weight[id(w)] = own + sum(weight[id(p)] for p in inside)
        articles[id(w)] = weight[id(w)] if w.tag in CONTENT_TAGS else sum(articles[id(p)] for p in inside)
    total, kept, above = weight[id(top)], [], {}
    todo = [top]
    while todo:
        w = todo.pop()
        n = weight[id(w)]
        if not n:
            continue
        inside = [] if w.boilerplate else w.parts
        nested = sum(articles[id(p)] for p in inside)
        fullest = max(inside, key=lambda p: weight[id(p)], default=None)
        descends = fullest is not None and not _is_leaf(fullest) and not fullest.repeated and weight[id(fullest)] >= TRUNK * n
        shared = 2 * nested >= n
        if _is_leaf(w) or w.tag in CONTENT_TAGS and nested < n or not (descends or shared):
            kept.append(w)
            while (w := above.get(id(w))) is not None and not w.leads:
                w.leads = True
            continue
        for p in inside:
            if p is fullest and descends or shared and articles[id(p)] or p.signature != TEXT and (_is_leaf(p) or weight[id(p)] >= BESIDE * total and p.inside != {TEXT}):
                above[id(p)] = w
                todo.append(p)
    most = max((weight[id(w)] for w in kept), default=0)
    for w in kept:
        w.keep, w.main = True, 2 * weight[id(w)] >= most
    return top


def _is_leaf(p: Part) -> bool:
    return all(q.tag in LEAVES for q in p.parts) if p.group else p.tag in LEAVES


def dumped(top: Part) -> str:
    """What ``main_text`` needs of an expression: the parts on the way to main text and those beside them, as flat JSON."""
    out, todo = [], [(top, 0)]
    while todo:
        p, depth = todo.pop()
        out.append([depth, p.signature, p.keep + p.main, p.leads, p.group, sorted(p.inside)])
        if p.leads or p.group:
            todo.extend((q, depth + 1) for q in reversed(p.parts))
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def packed(top: Part) -> bytes:
    """A whole expression, to be aligned with others elsewhere; flat, so that deep ones take no recursion."""
    out, todo = [], [(top, 0)]
    while todo:
        p, depth = todo.pop()
        out.append([depth, p.signature, p.boilerplate, p.optional, p.repeated, p.group, sorted(p.texts), p.characters, p.linked, p.pages, sorted(p.inside)])
        todo.extend((q, depth + 1) for q in reversed(p.parts))
    return zlib.compress(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def unpacked(data: bytes) -> Part:
    path: list[Part] = []
    for depth, signature, boilerplate, optional, repeated, group, texts, characters, linked, pages, inside in json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass")):
        part = Part(signature, boilerplate, optional=optional, repeated=repeated, group=group, texts=set(texts), characters=characters, linked=linked, pages=pages, inside=frozenset(inside))
        del path[depth:]
        if path:
            path[-1].parts.append(part)
        path.append(part)
    return path[0]


def loaded(text: str) -> Part:
    path: list[Part] = []
    for depth, signature, kept, leads, group, inside in json.loads(text):
        part = Part(signature, keep=kept > 0, main=kept > 1, leads=leads, group=group, inside=frozenset(inside))
        del path[depth:]
        if path:
            path[-1].parts.append(part)
        path.append(part)
    return path[0]


def found(root: Node, wrapper: Part) -> list[Node]:
    """The page's blocks that match the wrapper's main text, in page order, none inside another; none if it does not fit."""
    wanted: set[int] = set()
    fits, todo = False, [([root], wrapper)]
    while todo:
        nodes, w = todo.pop()
        if w.keep:
            own = [id(n) for n in nodes if not n.boilerplate]
            wanted.update(own)
            fits |= w.main and bool(own)
            continue
        groups = {p.signature for p in w.parts if p.group}
        for node in nodes:
            own = _with_squares([q for p in folded([part_of(c) for c in node.children]) for q in (p.parts if p.group and p.signature not in groups else [p])], w.parts, True)
            for i, j in matched(own, w.parts):
                if i is not None and j is not None:
                    pairs = zip(own[i].parts, w.parts[j].parts, strict=True) if w.parts[j].group else [(own[i], w.parts[j])]
                    todo.extend((p.nodes, q) for p, q in pairs if q.keep or q.leads)
    out, walk = [], [root] if fits else []
    while walk:
        x = walk.pop()
        if id(x) in wanted:
            out.append(x)
        else:
            walk.extend(reversed(x.children))
    return out


def main_text(page: str, wrapper: Part | None) -> str:
    """The page's main text by its host's wrapper; a page that does not fit it is read by its own."""
    root = parse(page)
    nodes = found(root, wrapper) if wrapper is not None else []
    if not nodes:
        nodes = found(root, choose(generalise(root)))
    return "\n\n".join(t for n in nodes for t in blocks(n))

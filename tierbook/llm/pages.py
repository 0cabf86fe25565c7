"""Tolerant reading of HTML into a small tree."""

from __future__ import annotations

import re

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or never text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml noframes xmp".split())
#: Elements that end an open paragraph and start a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends, and the elements that shelter from it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
#: Tags whose quotes run to the end of the page, after which quotes are no longer trusted.
UNCLOSED = 16
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element: its children are nodes and pieces of undecoded text."""

    __slots__ = ("tag", "names", "children", "slot", "kept")

    def __init__(self, tag: str, names: dict[str, str]):
        self.tag, self.names, self.children, self.slot, self.kept = tag, names, [], None, False

    @property
    def label(self) -> str:
        kind = self.names.get("class", "").split()
        return f"{self.tag}.{kind[0]}" if kind else self.tag


def parsed(html: str) -> Node:
    """The tree under an outermost node; unclosed elements end with their parents, text is never lost."""
    root = Node("#page", {})
    stack, at, begun, size, last = [root], 0, 0, len(html), html.rfind(">")
    unclosed, missing = 0, set()
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end, tag = (size if end < 0 else end + 3), ""
        elif lt > last:
            break
        elif html[lt + 1] in "!?":
            end, tag = html.find(">", lt) + 1, ""
        elif (m := TAG.match(html, lt)) is not None:
            close, tag = m[1], m[2].lower()
            quoted = QUOTED.match(html, m.end()) if unclosed < UNCLOSED else None
            unclosed += quoted is None
            end = quoted.end() if quoted else html.find(">", m.end()) + 1
            rest = html[m.end() : end - 1]
        else:
            at = lt + 1
            continue
        if lt > begun:
            stack[-1].children.append(html[begun:lt])
        at = begun = end
        if not tag:
            continue
        if close:
            _end(stack, tag)
            continue
        if tag in BLOCK:
            _end(stack, "p", shelter=True)
        if tag in ENDS:
            ended, shelter = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    break
                if stack[k].tag in shelter:
                    break
        names = {k.lower(): (a or b or c).lower() for k, a, b, c in NAMES.findall(rest)} if rest else {}
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in RAW and not rest.endswith("/"):
            found = None if tag in missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if found:
                at = begun = found.end()
            else:
                missing.add(tag)  # nor will it be found further on
                if tag in ("script", "style"):
                    at = begun = size
        elif tag not in VOID:
            stack.append(node)
    if begun < size:
        stack[-1].children.append(html[begun:])
    return root


def _end(stack: list[Node], tag: str, shelter: bool = False) -> None:
    """Close the innermost open element of that tag; an inline end tag does not reach beyond its block."""
    inline = tag not in BLOCK
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if (inline or shelter) and stack[k].tag in BLOCK:
            return

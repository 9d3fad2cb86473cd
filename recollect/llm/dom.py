"""A small HTML reader: a scanner cuts tags, a stack builds the tree, and each text run knows its node.

Only comments and the content of script and style are left out; all other elements, as svg, math, object, noscript,
template and iframe, are ordinary nodes, and ``/>`` ends any element at once. What has no end as a tag is text. Time is
linear in the page for any markup: where a tag ends is remembered for each quote, and open elements are kept by name.
"""

import re
from html import unescape

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hr html head li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split())
#: An opening of the second kind ends an open element of the first kind, up to the nearest of the third kind.
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
P_LIMITS = frozenset("article aside blockquote body button caption div fieldset footer form header html main nav object section table td th".split())

#: Elements whose content holds no tags; the text of the last two is kept.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "title", "textarea")}
KEPT_RAW = frozenset(("title", "textarea"))
NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


class Tree:
    """Nodes in page order: ``tags``, ``parents``, ``tokens`` of class, id and role; ``runs`` of (node, text, breaks before)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.tokens = [""], [-1], [()]
        self.runs: list[tuple[int, str, bool]] = []
        self.html, self.stack, self.open, self.ends, self.seen = html, [0], {}, {}, (0, -1)
        at, shown, broken = 0, 0, True
        while (at := html.find("<", at)) >= 0:
            found = self._tag(at)
            if found is None:
                at += 1
                continue
            end, closing, name, attributes = found
            if at > shown:
                self.runs.append((self.stack[-1], html[shown:at], broken))
                broken = False
            at = shown = end
            if not name:
                continue
            if name in RAW and not closing:
                close = None if attributes.endswith("/") else RAW[name].search(html, end)
                inside = "" if attributes.endswith("/") else html[end:close.start()] if close else html[end:]
                at = shown = end + len(inside) if not close else close.end()
                if name in KEPT_RAW:
                    self.runs.append((self._node(name, attributes), inside, True))
                    broken = True
                continue
            broken |= name in BLOCK
            if closing:
                if self.open.get(name):
                    self._cut(self.open[name][-1])
                continue
            if name in CLOSES_P:
                self._close(("p",), P_LIMITS)
            if name in SAME:
                self._close(("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,), SAME[name])
            if name == "br":
                self.runs.append((self.stack[-1], " ", broken))
            node = self._node(name, attributes)
            if name not in VOID and not attributes.endswith("/"):
                self.open.setdefault(name, []).append(len(self.stack))
                self.stack.append(node)
        if shown < len(html):
            self.runs.append((self.stack[-1], html[shown:], broken))

    def _tag(self, at: int) -> tuple[int, bool, str, str] | None:
        """End, whether it closes, name and attributes of what begins at ``at``; without a name: a comment or the like. None: text."""
        html = self.html
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return len(html) if end < 0 else end + 3, False, "", ""
        closing = html.startswith("/", at + 1)
        m = NAME.match(html, at + 1 + closing)
        end = self._end(m.end()) if m else -1
        if end >= 0:
            return end + 1, closing, m.group().lower(), html[m.end():end]
        if html[at + 1:at + 2] in ("!", "?", "/"):
            end = html.find(">", at)
            return len(html) if end < 0 else end + 1, False, "", ""
        return None

    def _end(self, at: int) -> int:
        """Where the ``>`` of a tag stands, outside quoted values; -1 without one. Each quote is followed once only."""
        html, ends, path = self.html, self.ends, []
        while True:
            if not self.seen[0] <= at <= self.seen[1]:
                m = SPECIAL.search(html, at)
                self.seen = at, m.start() if m else len(html)
            place = self.seen[1] if self.seen[1] < len(html) else -1
            if place < 0 or place in ends or html[place] == ">":
                break
            path.append(place)
            close = html.find(html[place], place + 1)
            if close < 0:
                place = -1
                break
            at = close + 1
        end = ends.get(place, place)
        for p in path:
            ends[p] = end
        return end

    def _node(self, name: str, attributes: str) -> int:
        self.tags.append(name)
        self.parents.append(self.stack[-1])
        self.tokens.append(tuple(w for a in ATTR.finditer(attributes) for w in WORD.findall(a.group(2).lower())) if attributes else ())
        return len(self.tags) - 1

    def _cut(self, k: int) -> None:
        """Ends the open elements from place ``k`` of the stack on."""
        for node in self.stack[k:]:
            self.open[self.tags[node]].pop()
        del self.stack[k:]

    def _close(self, names, limits) -> None:
        """Ends the nearest open element of ``names``, unless one of ``limits`` is nearer."""
        nearest = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        k = nearest(names)
        if k and k > nearest(limits):
            self._cut(k)

    def text(self, chosen) -> str:
        """The blocks of the chosen nodes' runs: references decoded, white space as one space, joined by newlines."""
        blocks, held = [], []
        for node, run, breaks in self.runs:
            if breaks and held:
                blocks.append("".join(held))
                held = []
            if chosen[node]:
                held.append(run)
        blocks.append("".join(held))
        return "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)

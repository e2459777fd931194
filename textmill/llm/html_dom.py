"""A small, forgiving HTML reader that makes flat arrays of DOM nodes."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML by their part in a page.
GROUPS: dict[str, tuple[str, ...]] = {
    "root": ("#root", "html", "body"),
    "article": ("article", "main"),
    "nav": ("nav", "menu"),
    "header": ("header",),
    "footer": ("footer", "address"),
    "aside": ("aside", "dialog"),
    "form": ("form", "fieldset", "label", "legend", "select", "option", "optgroup", "button", "input", "textarea", "datalist", "output"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    "paragraph": ("p", "pre", "blockquote"),
    "list": ("ul", "ol", "dl"),
    "item": ("li", "dt", "dd"),
    "table": ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"),
    "figure": ("figure", "figcaption", "img", "picture", "video", "audio", "iframe", "ins", "object", "embed", "svg", "canvas"),
    "box": ("div", "section", "center", "details", "summary"),
    "link": ("a",),
    "inline": ("span", "b", "i", "em", "strong", "u", "s", "small", "sub", "sup", "code", "q", "cite", "abbr", "time", "mark", "font", "br", "hr", "wbr", "kbd", "var", "del", "bdi", "bdo"),
    "text": ("#text",),
    "other": (),
}
NAMES = list(GROUPS)
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags}
OTHER, TEXT, LINK = NAMES.index("other"), NAMES.index("text"), NAMES.index("link")

# Words in class, id and role that tell a part of a page.
WORDS: dict[str, str] = {
    "content": "article content main post entry story body text prose page",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar branding hero logo",
    "footer": "footer copyright legal bottom colophon contentinfo",
    "side": "sidebar side aside related recommended widget rail trending popular complementary more",
    "ad": "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promoted promotion banner",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall warning announcement dialog",
    "form": "form search login register contact feedback",
    "comment": "comment comments reply replies discussion respond disqus reviews",
    "share": "share sharing social follow tags byline toolbar",
}
WORD_NAMES = list(WORDS)
WORD_OF = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title head".split())
IN_HEAD = frozenset("title meta link script style base noscript template head html".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Parts of a form that are no text, wherever they are.
CONTROLS = frozenset("button datalist input label legend meter optgroup option output progress select textarea".split())
#: A form whose other text is shorter, and that holds no article, isn't part of the page; a longer one is a page within a form.
FORM_CHARS = 400
#: A start tag closes an open element of these kinds, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
CLOSES_P = frozenset(BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend dt dd li summary".split())) | {"li", "dt", "dd"}
P_SCOPE = frozenset("table td th button body html #root".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|"
    r"<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>", re.S,
)
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# A value without quotes that ends in a slash, which is no slash of the element then.
_BARE_END = re.compile(r"=\s*[^\s\"']*/\s*\Z")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


@dataclass
class Dom:
    """Nodes in page order; a node's parent comes before it. What is never shown, controls and
    short forms have no nodes."""

    parent: list[int] = field(default_factory=lambda: [-1])
    group: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    block: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])
    mark: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, group: int, marks: int, block: int, text: str | None, mark: str | None = None) -> int:
        self.parent.append(parent)
        self.group.append(group)
        self.depth.append(self.depth[parent] + 1)
        self.marks.append(marks)
        self.block.append(block)
        self.text.append(text)
        self.mark.append(mark)
        return len(self.parent) - 1

    def cut(self, node: int) -> None:
        """Take out the last nodes from ``node`` on."""
        for own in (self.parent, self.group, self.depth, self.marks, self.block, self.text, self.mark):
            del own[node:]


def _marks(attributes: str) -> int:
    found = 0
    for m in _MARKS.finditer(attributes):
        for word in _WORD.findall(m[1].lower()):
            k = WORD_OF.get(word)
            if k is not None:
                found |= 1 << k
    return found


def _unseen(attributes: str) -> bool:
    """Whether an element is hidden by its own attributes."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    return "hidden" in found or bool(_UNSEEN.search(found.get("style", "")))


def parse(page: str, mark_attribute: str | None = None) -> Dom:
    """The DOM of a page. ``mark_attribute`` names an attribute to note, for labelled pages."""
    dom = Dom()
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
    block = at = hidden = covered = 0
    marked = re.compile(rf"{mark_attribute}=\"?(\w+)") if mark_attribute else None

    def text(begin: int, end: int) -> None:
        if begin < end and not hidden and not covered:
            dom.add(stack[-1][1], TEXT, 0, block, html.unescape(page[begin:end]))

    def pop(n: int) -> None:
        nonlocal block, hidden, covered
        for tag, node, unseen in reversed(stack[n:]):
            block += tag in BLOCK
            hidden -= tag in HIDDEN
            covered -= unseen
            if tag == "form" and not covered and not unseen and _is_form(dom, node):
                dom.cut(node)
        del stack[n:]

    def close(kinds: frozenset, within: frozenset) -> None:
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in kinds:
                cut = k
            elif stack[k][0] in within:
                break
        if cut is not None:
            pop(cut)

    while m := _TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        if tag := m["end"]:
            tag = tag.lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
        elif tag := m["start"]:
            tag, attributes = tag.lower(), m["attributes"]
            if tag in ("html", "body") and len(stack) > 1 and any(t == tag for t, _, _ in stack):
                continue
            if hidden and tag not in IN_HEAD:
                # Whatever doesn't belong in a head ends it, with or without its end tag.
                pop(next((k for k, (t, _, _) in enumerate(stack) if t == "head"), len(stack)))
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in P_SCOPE:
                        break
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
                continue
            if tag in BLOCK:
                block += 1
            unseen = tag in CONTROLS or _unseen(attributes)
            if hidden or covered or unseen:
                node = stack[-1][1]
            else:
                node = dom.add(stack[-1][1], GROUP_OF.get(tag, OTHER), _marks(attributes) if "=" in attributes else 0, block, None, m_[1] if marked and (m_ := marked.search(attributes)) else None)
            if tag == "br" and not hidden and not covered:
                dom.add(stack[-1][1], TEXT, 0, block, " ")
            closed = attributes.rstrip().endswith("/") and not _BARE_END.search(attributes)
            if tag not in VOID and (tag in BLOCK or not closed):
                stack.append((tag, node, unseen))
                hidden += tag in HIDDEN
                covered += unseen
    text(at, len(page))
    pop(1)
    return dom


def _is_form(dom: Dom, node: int) -> bool:
    """Whether an element of a page that has ended is a form, by what it holds besides controls."""
    return GROUP_OF["article"] not in dom.group[node:] and sum(len(t.strip()) for t in dom.text[node:] if t) < FORM_CHARS

"""A small node tree and selector matcher for use inside Arrow batches.

Covers tag, .class, #id, [attr] with =, *=, ^=, $= and ~=, compounds of these, descendant, child and
sibling steps, and comma lists; pseudo-classes are not covered. Everything after node selection is
Catalyst.
"""

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
HIDDEN_TAGS = {"script", "style", "template"}
TOKEN = re.compile(
    r"""\s*(?P<step>[>+~])\s*|(?P<gap>\s+)|(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""",
    re.X,
)


ATTRIBUTE_TESTS = {
    "*=": lambda have, value: value in have,
    "^=": str.startswith,
    "$=": str.endswith,
    "~=": lambda have, value: value in have.split(),
}


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.classes = attrs["class"].split() if "class" in attrs else ()

    def walk(self):
        stack = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))

    def strings(self):
        stack = list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                yield part
            elif part.tag not in HIDDEN_TAGS:
                stack.extend(reversed(part.parts))

    def text(self):
        """Text with every string stripped, joined without a gap."""
        return "".join(s.strip() for s in self.strings())

    def content(self):
        """Whole text, stripped at both ends."""
        return "".join(self.strings()).strip()

    def closest(self, tags):
        node = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open = Counter()

    def handle_starttag(self, tag, attrs):
        values = {}
        for key, value in attrs:
            values.setdefault(key, value or "")
        node = Node(tag, values, self.at)
        self.at.parts.append(node)
        if tag not in VOID_TAGS:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        """Close the nearest open tag of this name and all within; a stray end tag is ignored."""
        if not self.open[tag]:
            return
        closed = None
        while closed != tag:
            closed = self.at.tag
            self.open[closed] -= 1
            self.at = self.at.parent

    def handle_data(self, data):
        parts = self.at.parts
        if parts and isinstance(parts[-1], str):
            parts[-1] += data
        else:
            parts.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


@lru_cache(maxsize=4096)
def compile_selector(text: str):
    """Tuple of alternatives, each a list of (combinator, tests) from left to right."""
    alternatives = []
    for part in re.split(r""",(?=(?:[^"'\]]|"[^"]*"|'[^']*'|\])*$)""", text):
        steps, tests, combinator, pos = [], [], " ", 0
        part = part.strip()
        if not part:
            raise ValueError(f"empty selector in {text!r}")
        while pos < len(part):
            m = TOKEN.match(part, pos)
            if not m:
                raise ValueError(f"selector not supported: {text!r}")
            pos = m.end()
            if m["step"] or m["gap"]:
                steps.append((combinator, tests))
                tests, combinator = [], m["step"] or " "
            elif m["tag"]:
                tests.append(("tag", m["tag"].lower(), None))
            elif m["cls"]:
                tests.append(("cls", m["cls"], None))
            elif m["id"]:
                tests.append(("=", "id", m["id"]))
            else:
                value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
                tests.append((m["op"] or "has", m["attr"].lower(), value))
        steps.append((combinator, tests))
        alternatives.append(steps)
    return tuple(alternatives)


def _passes(node, tests):
    for kind, name, value in tests:
        if kind == "tag":
            ok = name == "*" or node.tag == name
        elif kind == "cls":
            ok = name in node.classes
        elif kind == "has":
            ok = name in node.attrs
        elif kind == "=":
            ok = node.attrs.get(name) == value
        else:
            ok = bool(value) and name in node.attrs and ATTRIBUTE_TESTS[kind](node.attrs[name], value)
        if not ok:
            return False
    return True


def _related(node, combinator):
    """Nodes a step may continue at, nearest first."""
    if combinator in "+~":
        before = []
        for part in node.parent.parts:
            if part is node:
                break
            if isinstance(part, Node):
                before.append(part)
        before.reverse()
        return before[:1] if combinator == "+" else before
    above, found = node.parent, []
    while above is not None and above.tag:
        found.append(above)
        if combinator == ">":
            break
        above = above.parent
    return found


def _matches(node, steps):
    combinator, tests = steps[-1]
    if not _passes(node, tests):
        return False
    return len(steps) == 1 or any(_matches(other, steps[:-1]) for other in _related(node, combinator))


def _any_match(node, alternatives):
    for steps in alternatives:
        if _matches(node, steps):
            return True
    return False


def select(root: Node, selector: str) -> list:
    """All matching nodes below root, in document order."""
    alternatives = compile_selector(selector)
    return [n for n in root.walk() if _any_match(n, alternatives)]


def first(nodes, selector: str):
    """First match among nodes given in document order, such as root.walk() or a list of it."""
    alternatives = compile_selector(selector)
    return next((n for n in nodes if _any_match(n, alternatives)), None)

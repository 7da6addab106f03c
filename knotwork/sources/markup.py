"""Graph rows from documents: Markdown and HTML sections with mentions, and labels of diagrams.

Sections nest by heading level. Code spans, links and the like name symbols; they stay pending on their section
until ``enrich.resolve_mentions`` finds the symbol.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

#: How sure a mention is, by where it stands.
SPAN, BLOCK, LINK, FOOTNOTE = 0.85, 0.80, 0.70, 0.85
WORD, TICKS, CODE, EMPHASIS, CELL, SCRIPT, HEADING, DESCRIPTION = 0.75, 0.85, 0.80, 0.80, 0.65, 0.70, 0.90, 0.60
#: Endings a link's last part loses.
LINK_ENDINGS = (".html", ".md", ".txt", ".htm", ".php", ".js", ".ts", ".rs", ".py")


def slug_of(title: str) -> str:
    return "-".join(re.sub(r"[^\w]|_", "-", title.lower()).replace("-", " ").split())


def code_tokens(code: str) -> list[str]:
    return re.findall(r"[\w:.=+-]+", code)


def symbol_of_link(url: str) -> str:
    """Last part of a link without fragment, query and file ending."""
    tail = re.split(r"[?#]", url.rstrip("/"))[0].rsplit("/", 1)[-1]
    if "#" in url and not tail:
        tail = url.rsplit("#", 1)[-1]
    return next((tail[: -len(e)] for e in LINK_ENDINGS if tail.endswith(e)), tail)


class Document:
    """A document node, its tree of sections, and what they mention."""

    def __init__(self, path: str, lines: int):
        self.root, self.path = f"doc::{path}", path
        self.nodes = [self._node("document", path.rsplit("/", 1)[-1], self.root, 1, lines)]
        self.edges: list[dict] = []
        self.stack: list[tuple[int, str]] = []
        self.pending: dict[str, dict[str, float]] = {}

    def _node(self, kind, name, qualified, start, end):
        return {"kind": kind, "name": name, "qualified_name": qualified, "source_uri": self.path, "line_start": start, "line_end": end, "is_test": False, "properties": None, "source_text": None}

    @property
    def current(self) -> str:
        return self.stack[-1][1] if self.stack else self.root

    def heading(self, level: int, title: str, line: int) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        slug = slug_of(title) or "section"
        qualified = f"{self.root}::{slug}"
        if not any(n["qualified_name"] == qualified for n in self.nodes):  # equal headings are one section
            self.nodes.append(self._node("section", slug, qualified, line, line))
            self.edges.append({"src": self.current, "dst": qualified, "kind": "defines", "conf_class": "extracted", "confidence": 1.0, "call_scope": None, "call_receiver": None})
        self.stack.append((level, qualified))

    def mention(self, token: str, confidence: float) -> None:
        token = token.strip().removesuffix("()")
        if token and len(token) <= 200:
            own = self.pending.setdefault(self.current, {})
            own[token] = max(confidence, own.get(token, 0.0))

    def rows(self, properties: dict | None = None) -> tuple[list[dict], list[dict]]:
        for n in self.nodes:
            p = dict(properties or {}) if n["qualified_name"] == self.root else {}
            if self.pending.get(n["qualified_name"]):
                p["pending_mentions"] = [[t, c] for t, c in self.pending[n["qualified_name"]].items()]
            n["properties"] = json.dumps(p, ensure_ascii=False) if p else None
        ends = [n["line_start"] - 1 for n in self.nodes[2:]] + [self.nodes[0]["line_end"]]
        for n, end in zip(self.nodes[1:], ends):
            n["line_end"] = max(n["line_start"], end)
        return self.nodes, self.edges


def extract_markdown(path: str, text: str) -> tuple[list[dict], list[dict]]:
    lines = text.split("\n")
    doc = Document(path, len(lines))
    refs = {m.group(1).lower(): m.group(2) for m in re.finditer(r"^ {0,3}\[([^\]^]+)\]:\s*<?([^\s>]+)>?", text, re.M)}
    fence = None
    for number, line in enumerate(lines, 1):
        line = line.rstrip("\r")
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark.group(1).startswith(fence):
                fence = None
            else:
                for t in code_tokens(line):
                    doc.mention(t, BLOCK)
            continue
        if mark:
            fence = mark.group(1)
            continue
        head = re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        under = number < len(lines) and re.match(r" {0,3}(=+|-{2,})\s*$", lines[number].rstrip("\r")) and line.strip() and not line.lstrip().startswith(("-", "*", ">", "#", "|"))
        if head or under:
            doc.heading(len(head.group(1)) if head else 1 if "=" in lines[number] else 2, head.group(2) if head else line.strip(), number)
            continue
        if re.match(r" {0,3}\[\^[^\]]+\]:", line):
            for t in re.findall(r"`([^`]+)`", line):
                doc.mention(t, FOOTNOTE)
            continue
        for t in re.findall(r"`+([^`]+)`+", line):
            doc.mention(t, SPAN)
        for label, url, ref in re.findall(r"\[([^\]]+)\](?:\(\s*<?([^\s)>]+)[^)]*\)|\[([^\]]*)\])?", line):
            target = url or refs.get((ref or label).lower())
            if target:
                doc.mention(symbol_of_link(target), LINK)
    return doc.rows()


class _Html(HTMLParser):
    def __init__(self, doc: Document):
        super().__init__(convert_charrefs=True)
        self.doc, self.open, self.text, self.properties = doc, [], {}, {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content"):
            name = (a.get("name") or "").lower()
            if name == "description":
                self.properties["description"] = a["content"]
            elif name in ("keywords", "author"):
                for t in a["content"].split(",") if name == "keywords" else [a["content"]]:
                    self.doc.mention(t, DESCRIPTION if name == "keywords" else LINK)
            return
        if tag == "a" and a.get("href"):
            self.doc.mention(symbol_of_link(a["href"]), LINK)
        self.open.append(tag)
        self.text[len(self.open)] = ""
        if tag == "script" and "json" in (a.get("type") or "").lower():
            self.open[-1] = "skip"

    def handle_endtag(self, tag):
        if tag not in self.open and not (tag == "script" and "skip" in self.open):
            return
        while self.open:
            top = self.open.pop()
            text = " ".join(self.text.pop(len(self.open) + 1, "").split())
            if top == tag or (tag == "script" and top == "skip"):
                self._close(top, text)
                return

    def _close(self, tag, text):
        if not text or tag == "skip":
            return
        if re.fullmatch("h[1-6]", tag):
            self.doc.heading(int(tag[1]), text, self.getpos()[0])
            for t in re.findall(r"[A-Za-z_][\w:.]*", text):
                self.doc.mention(t, HEADING)
        elif tag in ("code", "pre"):
            for t in code_tokens(text):
                self.doc.mention(t, CODE)
        elif tag in ("em", "strong", "b", "i"):
            self.doc.mention(text, EMPHASIS)
        elif tag == "a":
            self.doc.mention(text, LINK)
        elif tag in ("td", "th"):
            self.doc.mention(text, CELL)
        elif tag == "script":
            for t in code_tokens(text):
                self.doc.mention(t, SCRIPT)
        elif tag in ("p", "li", "dd", "dt", "blockquote"):
            for t in re.findall(r"`([^`]+)`", text):
                self.doc.mention(t, TICKS)
            for t in re.findall(r"\b(?:[A-Za-z_]\w*(?:::|_)\w+|[A-Z][a-z0-9]+[A-Z]\w*)", text):
                self.doc.mention(t, WORD)

    def handle_data(self, data):
        if self.open and self.open[-1] != "style":
            self.text[len(self.open)] = self.text.get(len(self.open), "") + data
            # inline text also belongs to the block around it
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i] in ("code", "em", "strong", "b", "i", "a", "span"):
                    self.text[i] = self.text.get(i, "") + data
                else:
                    break


def extract_html(path: str, text: str) -> tuple[list[dict], list[dict]]:
    doc = Document(path, text.count("\n") + 1)
    parser = _Html(doc)
    parser.feed(text)
    parser.close()
    return doc.rows(parser.properties)


def extract_svg(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """A diagram node and a concept per text label."""
    root = f"diagram::{path}"
    blank = {"line_start": None, "line_end": None, "is_test": False, "properties": None, "source_text": None}
    nodes, edges = [{"kind": "diagram", "name": path.rsplit("/", 1)[-1], "qualified_name": root, "source_uri": path, **blank}], []
    for inner in re.findall(r"<text\b[^>]*>(.*?)</text>", text, re.S):
        label = re.sub(r"<[^>]*>", "", inner).strip()
        if label:
            nodes.append({"kind": "concept", "name": label, "qualified_name": f"concept::{label}", "source_uri": None, **blank})
            edges.append({"src": root, "dst": f"concept::{label}", "kind": "illustrates", "conf_class": "inferred", "confidence": 0.7, "call_scope": None, "call_receiver": None})
    return nodes, edges

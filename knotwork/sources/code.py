"""Graph rows from source text: Python by its syntax tree, other languages by a line and brace walker.

Each extractor takes (path, text) and returns (nodes, edges) as lists of dictionaries; edges name their ends
by qualified name. Calls go to ``call::<name>`` placeholders as ambiguous edges until they are resolved.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from knotwork.functions.names import TEST_NAME, TEST_PATH
from knotwork.sources.registry import Language

#: Names of builtins and control words whose calls say nothing about a project: a list of our own.
SUPPRESSED = frozenset({
    "if", "for", "while", "switch", "match", "return", "catch", "print", "println", "printf", "format", "len", "str", "int", "float", "bool", "list",
    "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "any", "all", "sum", "min", "max", "abs", "sorted", "open", "isinstance",
    "super", "getattr", "setattr", "hasattr", "type", "repr", "vec", "some", "none", "ok", "err", "box", "rc", "arc", "string", "assert", "assert_eq",
    "assert_ne", "panic", "unwrap", "expect", "clone", "into", "from", "to_string", "iter", "collect", "push", "pop", "insert", "get", "require",
    "console", "log", "sizeof", "malloc", "free",
})
_TEST_PATH, _TEST_NAME = re.compile(TEST_PATH), re.compile(TEST_NAME)


@dataclass
class Rows:
    path: str
    text: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.lines = self.text.split("\n")
        self.root = f"file::{self.path}"
        self.test_path = bool(_TEST_PATH.search(self.path.replace("\\", "/")))
        self.node("file", self.path.rsplit("/", 1)[-1], self.root, 1, len(self.lines), keep_text=False)

    def node(self, kind, name, qualified, start=None, end=None, test=False, keep_text=True, path=True):
        text = "\n".join(self.lines[start - 1 : end]) if keep_text and start else None
        self.nodes.append({"kind": kind, "name": name, "qualified_name": qualified, "source_uri": self.path if path else None, "line_start": start, "line_end": end,
                           "is_test": bool(kind in ("function", "method", "class") and (test or self.test_path or _TEST_NAME.search(name))), "properties": None, "source_text": text})

    def outside(self, kind, name, qualified):
        self.node(kind, name, qualified, keep_text=False, path=False)

    def edge(self, src, dst, kind, conf="extracted", score=1.0, scope=None, receiver=None):
        self.edges.append({"src": src, "dst": dst, "kind": kind, "conf_class": conf, "confidence": score, "call_scope": scope, "call_receiver": receiver})

    def define(self, kind, name, parent, start, end, test=False) -> str:
        qualified = f"{parent}::{name}"
        self.node(kind, name, qualified, start, end, test)
        self.edge(parent, qualified, "defines")
        return qualified

    def imports(self, name, prefix="module"):
        self.outside("module", name, f"{prefix}::{name}")
        self.edge(self.root, f"{prefix}::{name}", "imports")

    def inherits(self, child, base):
        self.outside("type", base, f"type::{base}")
        self.edge(child, f"type::{base}", "inherits")

    def call(self, caller, name, scope=None, receiver=None):
        if name and name.lower() not in SUPPRESSED:
            self.outside("function", name, f"call::{name}")
            self.edge(caller, f"call::{name}", "calls", "ambiguous", 0.0, scope, receiver)


def extract_python(path: str, text: str) -> tuple[list[dict], list[dict]]:
    rows = Rows(path, text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return rows.nodes, rows.edges

    def callee(f):
        if isinstance(f, ast.Name):
            return f.id, None
        if isinstance(f, ast.Attribute):
            return f.attr, ast.unparse(f.value)
        return None, None

    def walk(body, parent, in_class):
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                own = rows.define(kind, x.name, parent, start, x.end_lineno)
                if kind == "class":
                    for b in x.bases:
                        name, _ = callee(b)
                        if name:
                            rows.inherits(own, name)
                walk(x.body, own, kind == "class")
                continue
            if isinstance(x, ast.Import):
                for a in x.names:
                    rows.imports(a.name)
            elif isinstance(x, ast.ImportFrom):
                rows.imports("." * x.level + (x.module or ""))
            stack = [x]
            while stack:
                y = stack.pop()
                if y is not x and isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    walk([y], parent, False)
                    continue
                if isinstance(y, ast.Call):
                    name, receiver = callee(y.func)
                    if name:
                        rows.call(parent, name, None, receiver)
                stack.extend(reversed(list(ast.iter_child_nodes(y))))

    walk(tree.body, rows.root, False)
    return rows.nodes, rows.edges


_STRINGS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_CALL = re.compile(r"(?:(?P<receiver>[A-Za-z_][\w.]*(?:\(\))?)\.|(?P<scope>(?:[A-Za-z_]\w*::)+))?(?P<name>[A-Za-z_]\w*)(?:::<[^>\n]*>)?(?P<bang>!)?\s*\(")
_RUST = (
    ("mod", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{")),
    ("trait", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)")),
    ("impl", re.compile(r"^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, &']+\s+for\s+)?(\w+)")),
    ("class", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)")),
    ("type", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)")),
    ("function", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"?\w*\"?\s*)*fn\s+(\w+)")),
)
_TS = (
    ("mod", re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)\s*\{")),
    ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)")),
    ("type", re.compile(r"^\s*(?:export\s+)?(?:const\s+)?(?:type\s+(\w+)\s*(?:<[^=]*>)?\s*=|enum\s+(\w+))")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")),
    ("member", re.compile(r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{;]+)?\{")),
)
_CPP = (
    ("mod", re.compile(r"^\s*namespace\s+(\w+)")),
    ("class", re.compile(r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)[^;]*$")),
    ("function", re.compile(r"^\s*(?:[\w:<>,*&~]+\s+)+[*&]*((?:\w+::)*~?\w+)\s*\([^;]*$")),
)
_PATTERNS = {"rust": _RUST, "typescript": _TS, "cpp": _CPP}
_IMPORTS = {
    "rust": (("module", re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)")),),
    "typescript": (("module", re.compile(r"^\s*import\s+(?:[^'\"]*\bfrom\s+)?['\"]([^'\"]+)['\"]|^\s*(?:const|let|var)\s+.*?require\(['\"]([^'\"]+)")), ("export", re.compile(r"^\s*export\s+(?:\*|\{[^}]*\})[^'\"]*from\s+['\"]([^'\"]+)"))),
    "cpp": (("include", re.compile(r"^\s*#\s*include\s*[<\"]([^>\"]+)")),),
}
_BASES = {"typescript": re.compile(r"\bextends\s+([\w., ]+)"), "cpp": re.compile(r":\s*((?:public|private|protected|virtual|\s|,|[\w:<>])+)")}


def extract_braces(path: str, text: str, language: str) -> tuple[list[dict], list[dict]]:
    """Rust, TypeScript and C++: declarations by pattern, their extent by braces, calls within functions.

    Comments and strings are blanked first. Patterns see at most one line at a time, so declarations broken over
    lines before their name are missed; this is a subset of the languages.
    """
    rows = Rows(path, text)
    plain = _STRINGS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text).split("\n")
    depth, scopes, waiting = 0, [], None  # scopes: (depth, qualified, kind, node index)
    attributes: list[str] = []
    for number, line in enumerate(rows.lines, 1):
        for prefix, p in _IMPORTS[language]:
            m = p.match(line)
            if m:
                rows.imports(next(g for g in m.groups() if g), prefix)
    # a line may open a block and declare something within it, so patterns see it brace by brace
    segments = [(number, part) for number, line in enumerate(plain, 1) for part in re.findall(r"[^{]*\{|[^{]+", line) or [""]]
    for number, code in segments:
        parent = next((s for s in reversed(scopes)), (0, rows.root, "file", 0))
        if code.strip().startswith("#[") and language == "rust":
            attributes.append(code)
        else:
            for kind, p in _PATTERNS[language]:
                m = p.match(code)
                if not m or (kind == "member" and parent[2] != "class") or (parent[2] in ("function", "method") and kind in ("member", "class", "type") and language == "cpp"):
                    continue
                name = next(g for g in m.groups() if g)
                inside = parent[2] in ("class", "impl", "trait")
                real = {"mod": "module", "member": "method", "function": "method" if inside or "::" in name else "function"}.get(kind, kind)
                if kind == "impl":
                    waiting = (parent[1] + "::" + name, "impl", None)
                    break
                test = any(re.search(r"\b(test|rstest|test_case)\b", a) for a in attributes)
                own = rows.define(real, name, parent[1], number, number, test)
                waiting = (own, real, len(rows.nodes) - 1)
                base = _BASES.get(language)
                if base and real == "class" and (b := base.search(code[m.end(1) if m.group(1) else m.end() :])):
                    for x in re.split(r"[\s,]+", b.group(1)):
                        if re.fullmatch(r"[\w:.]+", x) and x not in ("public", "private", "protected", "virtual", "implements", "extends"):
                            rows.inherits(own, x)
                break
            if code.strip():
                attributes = []
        holder = waiting if waiting and waiting[1] in ("function", "method") else next(((s[1], s[2]) for s in reversed(scopes) if s[2] in ("function", "method")), None)
        if holder:
            for m in _CALL.finditer(code):
                if waiting and m.group("name") == holder[0].rsplit("::", 1)[-1] and re.search(r"\b(fn|function)\s*$|^\s*[\w:<>*& ]*$", code[: m.start()]) and number == rows.nodes[waiting[2]]["line_start"]:
                    continue
                rows.call(holder[0], m.group("name"), (m.group("scope") or "").rstrip(":") or None, m.group("receiver"))
        for c in code:
            if c == "{":
                depth += 1
                if waiting:
                    scopes.append((depth, *waiting))
                    waiting = None
            elif c == "}":
                if scopes and scopes[-1][0] == depth:
                    index = scopes.pop()[3]
                    if index is not None:
                        _close(rows, index, number)
                depth = max(0, depth - 1)
            elif c == ";" and waiting:
                waiting = None
    return rows.nodes, rows.edges


def _close(rows: Rows, index: int, end: int) -> None:
    n = rows.nodes[index]
    n["line_end"] = end
    n["source_text"] = "\n".join(rows.lines[n["line_start"] - 1 : end])


def extract_lines(path: str, text: str, language: Language) -> tuple[list[dict], list[dict]]:
    """Languages read by one pattern each for functions, containers and imports; nesting by indentation."""
    rows = Rows(path, text)
    patterns = [(k, re.compile(p)) for k, p in (("class", language.container), ("function", language.function)) if p]
    imports = re.compile(language.imports) if language.imports else None
    open_: list[tuple[int, str, int]] = []  # indentation, qualified name, node index
    for number, line in enumerate(rows.lines, 1):
        if not line.strip():
            continue
        if imports and (m := imports.match(line) or (imports.search(line) if not imports.pattern.startswith("^") else None)):
            rows.imports(m.group(1))
            continue
        indent = len(line) - len(line.lstrip())
        for kind, p in patterns:
            m = p.match(line)
            if m and m.group(1).lower() not in SUPPRESSED:
                while open_ and open_[-1][0] >= indent:
                    _close(rows, open_.pop()[2], number - 1)
                parent = open_[-1][1] if open_ else rows.root
                inside = open_ and rows.nodes[open_[-1][2]]["kind"] == "class"
                own = rows.define("method" if kind == "function" and inside else kind, m.group(1), parent, number, number)
                open_.append((indent, own, len(rows.nodes) - 1))
                break
        else:
            for m in _CALL.finditer(line):
                rows.call(open_[-1][1] if open_ else rows.root, m.group("name"), (m.group("scope") or "").rstrip(":") or None, m.group("receiver"))
    while open_:
        _close(rows, open_.pop()[2], len(rows.lines))
    return rows.nodes, rows.edges

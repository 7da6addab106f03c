"""Languages by file ending, with a user's overlay, and which paths are worth reading."""

from __future__ import annotations

import fnmatch
import re
import tomllib
from dataclasses import dataclass, replace
from pathlib import PurePosixPath

#: Folders never read.
EXCLUDED = ("target", "node_modules", "__pycache__")
MARKUP = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "svg": "svg"}
OVERLAY_LIMIT = 20


@dataclass(frozen=True)
class Language:
    name: str
    endings: tuple[str, ...]
    function: str = ""
    container: str = ""
    imports: str = ""


#: Languages with a walker of their own, then those read by patterns of one line alone.
LANGUAGES = (
    Language("rust", ("rs",)),
    Language("python", ("py",)),
    Language("typescript", ("ts", "tsx", "js", "jsx", "mjs", "cjs")),
    Language("cpp", ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")),
    Language("go", ("go",), r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)\s+(?:struct|interface)", r'^\s*(?:import\s+)?"([\w./-]+)"'),
    Language("java", ("java",), r"^\s+(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum)\s+(\w+)", r"^import\s+(?:static\s+)?([\w.]+)"),
    Language("ruby", ("rb",), r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*(?:class|module)\s+(\w+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
    Language("php", ("php",), r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)", r"^use\s+([\w\\]+)"),
    Language("csharp", ("cs",), r"^\s+(?:public|private|protected|internal|static|async|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$", r"^\s*(?:public\s+|internal\s+|abstract\s+|sealed\s+)*(?:class|interface|struct|enum)\s+(\w+)", r"^using\s+([\w.]+)"),
    Language("kotlin", ("kt", "kts"), r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)", r"^import\s+([\w.]+)"),
    Language("swift", ("swift",), r"^\s*(?:\w+\s+)*func\s+(\w+)", r"^\s*(?:\w+\s+)*(?:class|struct|protocol|enum)\s+(\w+)", r"^import\s+(\w+)"),
    Language("scala", ("scala",), r"^\s*(?:\w+\s+)*def\s+(\w+)", r"^\s*(?:\w+\s+)*(?:class|object|trait)\s+(\w+)", r"^import\s+([\w.]+)"),
    Language("lua", ("lua",), r"^\s*(?:local\s+)?function\s+(?:\w+[.:])?(\w+)", "", r"require\s*\(?['\"]([\w./]+)"),
    Language("dart", ("dart",), r"^\s*(?:[\w<>?]+\s+)?(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{", r"^\s*(?:abstract\s+)?class\s+(\w+)", r"^import\s+['\"]([^'\"]+)"),
)


def load_registry(overlay: str | None = None) -> dict[str, Language]:
    """Language by name; ``overlay`` is TOML text with [[language]] entries merged field by field.

    At most OVERLAY_LIMIT entries; each needs a name, endings without dots, and patterns that compile with
    one group.
    """
    out = {x.name: x for x in LANGUAGES}
    entries = tomllib.loads(overlay).get("language", []) if overlay else []
    if len(entries) > OVERLAY_LIMIT:
        raise ValueError(f"more than {OVERLAY_LIMIT} languages in the overlay")
    for e in entries:
        name = e.get("name", "").strip().lower()
        if not name:
            raise ValueError("a language needs a name")
        fields = {k: tuple(x.lower().lstrip(".") for x in v) if k == "endings" else v for k, v in e.items() if k in ("endings", "function", "container", "imports")}
        for k, v in fields.items():
            if k != "endings" and v and re.compile(v).groups != 1:
                raise ValueError(f"{name}: {k} needs one group")
        merged = replace(out[name], **fields) if name in out else Language(name, fields.pop("endings", ()), **fields)
        if not merged.endings:
            raise ValueError(f"{name} has no endings")
        out[name] = merged
    return out


def language_of_path(path: str, registry: dict[str, Language] | None = None) -> str | None:
    """Language or markup kind by ending, in any case; the last language that claims it."""
    ending = PurePosixPath(path).suffix.lower().lstrip(".")
    claims = [x.name for x in (registry or load_registry()).values() if ending in x.endings]
    return claims[-1] if claims else MARKUP.get(ending)


@dataclass(frozen=True)
class IgnoreRules:
    """Rules of ignore files: the last one that matches a path or one of its folders decides."""

    rules: tuple[tuple[str, str, bool, bool], ...] = ()  # base folder, pattern, folders only, re-include

    @staticmethod
    def of(files: dict[str, str]) -> IgnoreRules:
        """From {folder of the ignore file: its text}; nested files add to outer ones."""
        out = []
        for base in sorted(files, key=lambda b: b.count("/") + bool(b)):
            for line in files[base].splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[keep:]
                only = line.endswith("/")
                out.append((base.strip("/"), line.rstrip("/"), only, keep))
        return IgnoreRules(tuple(out))

    def ignores(self, path: str) -> bool:
        parts = path.strip("/").split("/")
        for i in range(1, len(parts) + 1):  # an ignored folder takes all within it
            verdict = None
            for rule in self.rules:
                if self._matches(rule, parts[:i], i < len(parts)):
                    verdict = not rule[3]
            if verdict:
                return True
        return False

    @staticmethod
    def _matches(rule, parts: list[str], is_folder: bool) -> bool:
        base, pattern, only, _ = rule
        if only and not is_folder:
            return False
        depth = len(base.split("/")) if base else 0
        if base and "/".join(parts[:depth]) != base:
            return False
        rest = parts[depth:]
        if not rest:
            return False
        if "/" in pattern:
            regex = "".join("(?:.*/)?" if x == "**/" else ".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern.lstrip("/")))
            return re.fullmatch(regex, "/".join(rest)) is not None
        return fnmatch.fnmatchcase(rest[-1], pattern)


def is_relevant(path: str, ignore: IgnoreRules | None = None, registry: dict[str, Language] | None = None) -> bool:
    """A supported file outside hidden and excluded folders that no rule ignores."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if any(p in EXCLUDED or p.startswith(".") for p in parts):
        return False
    return language_of_path(path, registry) is not None and not (ignore and ignore.ignores("/".join(parts)))

"""Extraction, registry, diffs, the store and its incremental update, sinks."""

import xml.etree.ElementTree as ElementTree

import pytest
from graphs import make
from pyspark.sql import functions as F

from knotwork.plans import files as plan_files
from knotwork.sources import code, markup, sinks
from knotwork.sources.diffs import diff_lines, parse_diff
from knotwork.sources.extract import build, extract_rows, scan_files
from knotwork.sources.registry import IgnoreRules, is_relevant, language_of_path, load_registry
from knotwork.sources.store import Store
from knotwork.streaming.update import full_build, incremental_update

PYTHON = '''import os
from .core import Graph

class Loader(Base):
    """Loads."""
    def __init__(self):
        self.g = Graph()

    @staticmethod
    def load(path):
        return open_file(path)

def main():
    l = Loader()
    l.load("x")

def test_main():
    main()
'''
RUST = '''use crate::core::Graph;
/// Comment with fn fake() {
pub struct Store { g: Graph }
impl<T> Trait for Store {
    pub fn get(&self) -> u32 { self.inner.fetch("}") }
}
trait Walk { fn step(&self); }
enum Kind { A, B }
fn helper() -> u32 {
    let s = Store::open("x");
    s.get()
}
#[cfg(test)]
mod tests {
    #[test]
    fn works() { helper(); }
}
'''
TS = '''import { a } from "./lib";
export * from './re';
export class View extends Base {
  render(x: number): string {
    return draw(x);
  }
}
interface Shape { area(): number; }
type Alias = string;
const go = async (x) => { run(x); };
function plain() { new View(); }
'''
CPP = '''#include <vector>
namespace geo {
class Shape : public Base {
  int area() { return compute(1); }
};
int Shape::size() { return helper(2); }
}
'''


def by_kind(nodes):
    out = {}
    for n in nodes:
        out.setdefault(n["kind"], set()).add(n["qualified_name"].replace("file::p", ""))
    return out


def ends(edges, kind):
    return {(e["src"].replace("file::p", ""), e["dst"].replace("file::p", "")) for e in edges if e["kind"] == kind}


def test_python():
    nodes, edges = code.extract_python("p", PYTHON)
    k = by_kind(nodes)
    assert k["class"] == {"::Loader"} and k["method"] == {"::Loader::__init__", "::Loader::load"} and {"::main", "::test_main"} <= k["function"]
    assert ("", "module::os") in ends(edges, "imports") and ("", "module::.core") in ends(edges, "imports") and ends(edges, "inherits") == {("::Loader", "type::Base")}
    assert {("::main", "call::load"), ("::main", "call::Loader"), ("::Loader::load", "call::open_file"), ("::test_main", "call::main")} <= ends(edges, "calls")
    one = {n["qualified_name"]: n for n in nodes}
    assert one["file::p::Loader::load"]["line_start"] == 9 and one["file::p::test_main"]["is_test"] and one["file::p::main"]["source_text"].startswith("def main")
    assert len(code.extract_python("p", "def broken(:")[0]) == 1


def test_rust():
    nodes, edges = code.extract_braces("p", RUST, "rust")
    k = by_kind(nodes)
    assert k["class"] == {"::Store"} and k["method"] == {"::Store::get", "::Walk::step"} and k["trait"] == {"::Walk"} and k["type"] == {"::Kind"}
    assert {"::helper", "::tests::works"} <= k["function"] and not any("fake" in x for x in k["function"])
    calls = {(e["src"].replace("file::p", ""), e["dst"]): e for e in edges if e["kind"] == "calls"}
    assert calls["::Store::get", "call::fetch"]["call_receiver"] == "self.inner" and calls["::helper", "call::open"]["call_scope"] == "Store" if ("::helper", "call::open") in calls else True
    assert ("::tests::works", "call::helper") in calls
    assert {n["qualified_name"]: n for n in nodes}["file::p::tests::works"]["is_test"] and ends(edges, "imports") == {("", "module::crate::core::Graph")}


def test_long_functions_keep_their_whole_text():
    filler = "".join(f"    step({i});\n" for i in range(2_000))
    rust = "fn long() {\n" + filler + "    let x: Engine = make();\n    x.start();\n}"
    python = "def long():\n" + filler.replace(";", "") + "    last()"
    for text, (nodes, _) in ((rust, code.extract_braces("p", rust, "rust")), (python, code.extract_python("p", python))):
        assert [n["source_text"] for n in nodes if n["name"] == "long" and n["kind"] == "function"] == [text]


def test_typescript_and_cpp():
    nodes, edges = code.extract_braces("p", TS, "typescript")
    k = by_kind(nodes)
    assert {"::View", "::Shape"} <= k["class"] and k["method"] == {"::View::render"} and {"::go", "::plain"} <= k["function"] and "::Alias" in k["type"]
    assert ends(edges, "inherits") == {("::View", "type::Base")} and ("::View::render", "call::draw") in ends(edges, "calls")
    assert ends(edges, "imports") == {("", "module::./lib"), ("", "export::./re")}
    nodes, edges = code.extract_braces("p", CPP, "cpp")
    k = by_kind(nodes)
    assert "::geo::Shape" in k["class"] and "::geo::Shape::area" in k["method"] and ("::geo::Shape", "type::Base") in ends(edges, "inherits") and ("", "include::vector") in ends(edges, "imports")


def test_line_languages():
    r = load_registry('[[language]]\nname = "go"\nendings = ["go", ".GOX"]\n[[language]]\nname = "toy"\nendings = ["toy"]\nfunction = "^fun (\\\\w+)"')
    assert r["go"].endings == ("go", "gox") and language_of_path("a/B.TOY", r) == "toy" and language_of_path("x.unknown") is None and language_of_path("r.md") == "markdown"
    nodes, edges = code.extract_lines("p", "func Add(a int) {\n\tother(a)\n}\n", r["go"])
    assert by_kind(nodes)["function"] == {"::Add", "call::other"} and ends(edges, "calls") == {("::Add", "call::other")}
    for bad in ('[[language]]\nname = ""', '[[language]]\nname = "x"', '[[language]]\nname = "x"\nendings = ["x"]\nfunction = "a"'):
        with pytest.raises(ValueError):
            load_registry(bad)


def test_ignore_rules():
    rules = IgnoreRules.of({"": "*.log\nbuild/\n!keep.log\n/only_root.py\ndocs/**/gen", "sub": "*.py\n!ok.py"})
    ignored = {"a.log": True, "x/a.log": True, "keep.log": False, "build/a.py": True, "only_root.py": True, "x/only_root.py": False, "sub/a.py": True, "sub/ok.py": False, "docs/a/b/gen": True, "a.py": False}
    assert {p: rules.ignores(p) for p in ignored} == ignored
    assert is_relevant("src/a.py") and not is_relevant(".git/a.py") and not is_relevant("node_modules/a.js") and not is_relevant("a.bin") and not is_relevant("a.log", rules)


MD = """# Title
Intro `load_graph` and [link](src/graph.rs#x) and [ref].

[ref]: <docs/other.md> "t"

## Part
```py
code_call(x)
# not a heading
```
### Deep
## Part
[^1]: see `note_fn`

Under
-----
"""


def test_markdown_html_svg():
    nodes, edges = markup.extract_markdown("d.md", MD)
    names = [n["qualified_name"] for n in nodes]
    assert names == ["doc::d.md", "doc::d.md::title", "doc::d.md::part", "doc::d.md::deep", "doc::d.md::under"]
    assert {(e["src"], e["dst"]) for e in edges} == {("doc::d.md", "doc::d.md::title"), ("doc::d.md::title", "doc::d.md::part"), ("doc::d.md::part", "doc::d.md::deep"), ("doc::d.md::title", "doc::d.md::under")}
    import json

    p = {n["name"]: dict(map(tuple, json.loads(n["properties"] or "{}").get("pending_mentions", []))) for n in nodes}
    assert p["title"] == {"load_graph": 0.85, "graph": 0.7, "other": 0.7} and p["part"]["code_call"] == 0.8 and p["part"]["note_fn"] == 0.85
    html = '<html><head><meta name="description" content="D"><meta name="keywords" content="k1,k2"></head><body><h1>Top <em>x</em></h1><p>use <code>run_it</code> and GraphLoader</p><h2>Sub</h2><a href="/a/b.html">b</a><table><tr><td>cell_x</td></tr></table></body></html>'
    nodes, edges = markup.extract_html("h.html", html)
    assert [n["name"] for n in nodes][1:] == ["top-x", "sub"] and "D" in nodes[0]["properties"] and "k1" in nodes[0]["properties"]
    top = dict(map(tuple, json.loads(nodes[1]["properties"])["pending_mentions"]))
    assert top["run_it"] == 0.8 and top["GraphLoader"] == 0.75
    nodes, edges = markup.extract_svg("s.svg", "<svg><text x='1'>Load <tspan>er</tspan></text><text> </text></svg>")
    assert [n["qualified_name"] for n in nodes] == ["diagram::s.svg", "concept::Load er"] and edges[0]["kind"] == "illustrates"


def test_diffs(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n+a\n@@ -9 +10 @@\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,4 +0,0 @@\n"
    rows = parse_diff(diff_lines(spark.createDataFrame([(1, text)], "diff_id int, text string"))).orderBy("path", "old_start").collect()
    assert [tuple(r)[1:] for r in rows] == [("x.py", 1, 2, 1, 3), ("x.py", 9, 1, 10, 1), ("y", 1, 4, 0, 0)]


def files(spark, tmp, content):
    for name, text in content.items():
        f = tmp / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return scan_files(spark, str(tmp))


def test_build_from_a_folder(spark, tmp_path):
    df = files(spark, tmp_path, {"a.py": PYTHON, "b.rs": RUST, "doc.md": MD.replace("load_graph", "helper"), ".hidden/x.py": "x=1", "node_modules/y.js": "z()", "big.bin": "?"})
    assert {r.path for r in df.collect()} == {"a.py", "b.rs", "doc.md"}
    g = build(df, "c1")
    name = {r.id: r.qualified_name for r in g.nodes.collect()}
    links = {(name[r.src], name[r.dst], r.kind) for r in g.edges.collect()}
    assert ("file::a.py::main", "file::a.py::Loader::load", "calls") in links and ("file::a.py::main", "file::a.py::test_main", "tested_by") in links
    assert ("doc::doc.md::title", "file::b.rs::helper", "mentions") in links and {r.valid_from for r in g.nodes.collect()} == {"c1"}
    assert extract_rows(df.limit(0)).count() == 0


def test_store_and_update(spark, tmp_path):
    src, at = tmp_path / "src", str(tmp_path / "store")
    df = files(spark, src, {"a.py": "def used():\n    pass\n\ndef gone():\n    pass\n", "b.py": "def caller():\n    used()\n    gone()\n", "c.py": "def old():\n    pass\n"})
    store = Store(spark, at)
    full_build(store, df, "c1", now=1)
    assert incremental_update(store, scan_files(spark, str(src)), "c2").count() == 0
    (src / "c.py").unlink()
    df = files(spark, src, {"a.py": "def used():\n    return 1\n", "d.py": "def fresh():\n    used()\n"})
    changes = {(r.path, r.change) for r in incremental_update(store, df, "c2", now=2).collect()}
    assert changes == {("a.py", "changed"), ("c.py", "deleted"), ("d.py", "added")}
    g = store.load()
    nodes = {r.qualified_name: r for r in g.nodes.collect()}
    assert "file::c.py::old" not in nodes and nodes["file::a.py::used"].valid_from == "c1" and nodes["file::d.py::fresh"].valid_from == "c2"
    name = {r.id: q for q, r in nodes.items()}
    calls = {(name[r.src], name[r.dst]) for r in g.edges.where("kind = 'calls'").collect()}
    assert calls == {("file::b.py::caller", "file::a.py::used"), ("file::b.py::caller", "call::gone"), ("file::d.py::fresh", "file::a.py::used")}
    closed = {r.qualified_name: (r.valid_from, r.valid_to) for r in store.read("node_archive").collect()}
    assert closed["file::c.py::old"] == ("c1", "c2") and store.has_history()
    assert "file::c.py::old" in {r.qualified_name for r in store.load_temporal().nodes.collect()}
    assert store.of_sources(spark.createDataFrame([("b.py",)], "source_uri string")).edges.count() == 3
    store.rebuild_index()
    assert store.search_text("caller").count() == 1
    store.delete_sources(spark.createDataFrame([("b.py",)], "source_uri string"))
    assert store.search_text("caller").count() == 0 and store.load().nodes.where("source_uri = 'b.py'").count() == 0 and store.stats()["file_state"] == 2
    store.rebuild_embeddings()
    store.rebuild_index()
    assert {r.id for r in store.search_text("fresh").collect()} == {r.id for r in store.load().nodes.where("name = 'fresh'").collect()} and store.stats()["embeddings"] == store.load().nodes.where("qualified_name not like 'call::%'").count()
    store.reset()
    assert not store.exists("nodes")
    with pytest.raises(FileNotFoundError):
        store.load()


def test_sinks(spark, tmp_path):
    g = make(spark, [(1, "function", "a<b"), (2, "function", 'q"&'), (3, "file", "f")], [(1, 2, "calls"), (3, 1, "defines")])
    c = g.nodes.select("id", F.lit(7).alias("community"))
    out = str(tmp_path / "g")
    sinks.write_graphml(g, out, c)
    import glob

    root = ElementTree.fromstring("\n".join(open(f).read() for f in sorted(glob.glob(out + "/part-*"))).encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(ns + "node"))) == 3 and len(list(root.iter(ns + "edge"))) == 2
    assert "## Hubs" in sinks.report(g, c) and "none" in sinks.report(make(spark, [], []), c.limit(0))
    rows, about = sinks.page(g.nodes, ["id"], 1, 1)
    assert about == {"total": 3, "offset": 1, "limit": 1, "next": 2} and '"id": 2' in sinks.to_json(rows, about)
    assert sinks.graph_page(g, c)["nodes"].count() == 3


def test_every_kind_of_document_is_read(spark, tmp_path):
    kinds = ["readme", "design_note", "issue", "changelog", "docstring", "commit_message", "source_comment", "diagram_text"]
    rows = [(i, k, f"# Part {i}\nSee `load_graph`.") for i, k in enumerate(kinds)] + [
        (20, "diagram_text", "<svg><text>Store</text></svg>"), (21, "docstring", "<html><h1>Top</h1></html>"), (22, "readme", None)]
    spark.createDataFrame(rows, "doc_id bigint, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r.qualified_name for r in plan_files.markdown_sections(spark, str(tmp_path)).collect()}
    assert {n for i in range(8) for n in [f"docs/{i}.md"] if any(n in x for x in names)} == {f"docs/{i}.md" for i in range(8)}
    assert any("docs/20.svg" in x for x in names) and any("docs/21.html" in x for x in names) and not any("docs/22" in x for x in names)

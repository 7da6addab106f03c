"""Communities, flows, enrichment, review, history, search and label merging on small graphs."""

import json

import pytest
from graphs import make, random_graph
from pyspark.sql import functions as F

from knotwork import ops
from knotwork.functions import embedding, names, similarity
from knotwork.operators import communities as comm
from knotwork.operators import dedup, enrich, flows, motifs, refactor, review, search, temporal

TRIANGLES = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]


def labels(df):
    return {r.id: r.community for r in df.collect()}


@pytest.mark.parametrize(("algorithm", "small"), [("louvain", 100_000), ("leiden", 100_000), ("infomap", 100_000), ("leiden", 0)])
def test_two_triangles(spark, algorithm, small):
    g = make(spark, [(i, "function", f"x{i}") for i in range(7)], [(a, b, "calls") for a, b in TRIANGLES])
    c = labels(comm.detect(g, algorithm, comm.Options(small=small)))
    assert c[0] == c[1] == c[2] and c[3] == c[4] == c[5] and c[0] != c[3] and c[6] == 6


def ring_of_cliques(spark, n=30, k=5):
    """Modularity joins neighbouring cliques here; the map equation and a Potts objective of this resolution don't."""
    links = [(c * k + i, c * k + j, "calls") for c in range(n) for i in range(k) for j in range(i + 1, k)] + [(c * k, (c + 1) % n * k + 1, "calls") for c in range(n)]
    return make(spark, [(i, "function", f"x{i}") for i in range(n * k)], links), {i: i // k * k for i in range(n * k)}


def test_components_above_the_bound_keep_their_algorithm(spark):
    g, cliques = ring_of_cliques(spark)
    assert labels(comm.detect(g, "infomap", comm.Options(small=0))) == cliques
    w = comm.weighted_links(g).first().w
    assert labels(comm.detect(g, "leiden", comm.Options(small=0, objective="cpm", resolution=0.1 * w))) == cliques
    assert labels(comm.detect(g, "louvain", comm.Options(small=0))) != cliques
    assert labels(comm.detect(g, "louvain", comm.Options(small=0, passes=0))) == {i: i for i in cliques}


def test_refinement_above_the_bound(spark):
    g, cliques = ring_of_cliques(spark, 6)
    links = comm.weighted_links(g).withColumn("w", F.lit(1.0))
    nodes = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"), F.sum("w").alias("out")).withColumn("n", F.lit(1.0))
    group = g.nodes.select("id", (F.col("id") - F.col("id") % 15).alias("community"))  # three cliques each
    parts = labels(comm._refined(links, nodes, group, links.count(), comm.Options()))
    assert all(cliques[i] == cliques[c] for i, c in parts.items()) and 6 <= len(set(parts.values())) < 15


@pytest.mark.parametrize(("algorithm", "small"), [("louvain", 100_000), ("leiden", 100_000), ("louvain", 0)])
def test_communities_are_connected_and_beat_components(spark, algorithm, small):
    g, _ = random_graph(spark, 9, 40, 60)
    c = comm.detect(g, algorithm, comm.Options(small=small)).cache()
    again = comm.enforce_connected(c, g.undirected())
    assert labels(again) == labels(c)
    whole = g.nodes.select("id", F.lit(0).alias("community"))
    assert comm.modularity(g, c).first()[0] > comm.modularity(g, whole).first()[0]


def test_above_the_bound_blocks_shrink_the_graph_until_the_kernel_takes_it(spark, monkeypatch):
    """No synchronous rounds over the whole graph, and as good a division as the kernel's of all links."""
    g, _ = ring_of_cliques(spark, 30, 6)
    whole = comm.modularity(g, comm.detect(g)).first()[0]

    def never(*_):
        raise AssertionError("synchronous rounds")

    monkeypatch.setattr(comm, "_moves", never)
    found = comm.detect(g, "leiden", comm.Options(small=500)).cache()
    assert labels(comm.enforce_connected(found, g.undirected())) == labels(found) and len(labels(found)) == 180
    assert comm.modularity(g, found).first()[0] > 0.97 * whole


def test_candidates_of_calls_carry_no_text(spark):
    g = make(spark, [(0, "function", "f", {"source_text": "let p = Parser::new(); p.read()"}), (1, "function", "??", {"qualified_name": f"{enrich.PLACEHOLDER}read"}), (2, "method", "read"), (3, "method", "read", {"qualified_name": "n::read"})], [(0, 1, "calls", {"call_receiver": "p"})])
    rows = enrich.call_candidates(g)
    assert "from_text" not in rows.columns and {(r.candidate, r.bound_type) for r in rows.collect()} == {(2, "Parser"), (3, "Parser")}


def test_quality_of_dense_pairs(spark):
    g = make(spark, [(i, "function", f"x{i}") for i in range(4)], [(0, 1, "calls"), (1, 0, "calls"), (2, 3, "calls"), (3, 2, "calls")])
    c = comm.detect(g)
    q = comm.quality(g, c).first()
    assert (q.communities, q.largest, q.max_conductance, q.low_cohesion) == (2, 2, 0.0, 0)
    assert {r.cohesion for r in comm.cohesion(g, c).collect()} == {1.0}
    assert comm.split_oversized(g, 0.1, 1).count() == 4


def test_a_large_flow_keeps_its_entry_and_counts_calls_within(spark):
    """250 callees, each called by five outsiders: these calls say nothing about the flow. Callee 250 is called by ten siblings."""
    calls = [(0, i, "calls") for i in range(1, 251)] + [(1000 + k, i, "calls") for k in range(5) for i in range(1, 251)] + [(i, 250, "calls") for i in range(1, 11)]
    g = make(spark, [(i, "function", "main" if i == 0 else f"f{i}") for i in [*range(251), *range(1000, 1005)]], calls)
    entry = g.nodes.where("id = 0").select("id")
    got = {r.node_id: r.depth for r in flows.trace(g, entries=entry).collect()}
    assert len(got) == 200 and got[0] == 0 and 250 in got and set(got) == {0, 250, *range(1, 199)}


def test_flows(spark):
    chain = [(i, "function", n) for i, n in enumerate(["main", "b", "c", "d", "e", "f", "g", "h"])]
    g = make(spark, [*chain, (20, "function", "test_main", {"is_test": True}), (30, "function", "x", {"qualified_name": "call::x"})],
             [(i, i + 1, "calls") for i in range(7)] + [(20, 1, "calls"), (0, 30, "calls"), (0, 7, "calls", {"conf_class": "ambiguous"})])
    members = flows.trace(g).cache()
    got = {(r.flow_id, r.node_id): r.depth for r in members.collect()}
    assert got[0, 6] == 6 and (0, 7) not in got and (0, 30) not in got
    f = {r.flow_id: r for r in flows.flows(g, members).collect()}
    assert set(f) == {0, 20} and f[20].is_test_flow and f[0].criticality > f[20].criticality
    assert flows.trace(g, cap=2).where("flow_id = 0").count() == 2
    assert {r.flow_id for r in flows.affected_flows(members, flows.flows(g, members), g.nodes.where("name = 'c'")).collect()} == {0, 20}
    full = flows.as_graph(g, flows.flows(g, members), members)
    assert full.nodes.where("kind = 'flow'").count() == 2 and full.edges.where("kind = 'entry_of'").count() == 2


def test_call_tiers(spark):
    def fn(i, name, qn, uri, **x):
        return (i, x.pop("kind", "function"), name, {"qualified_name": qn, "source_uri": uri, **x})

    nodes = [
        fn(1, "caller", "file::a/m.rs::Own::caller", "a/m.rs", kind="method", source_text="let s: Store = make(); let t = Tree::new();"),
        fn(2, "only", "file::b/n.rs::only", "b/n.rs"),
        fn(3, "near", "file::a/m.rs::near", "a/m.rs"), fn(4, "near", "file::c/o.rs::near", "c/o.rs"),
        fn(5, "scoped", "file::c/o.rs::Alpha::scoped", "c/o.rs"), fn(6, "scoped", "file::d/p.rs::Beta::scoped", "d/p.rs"),
        fn(7, "get", "file::c/o.rs::Store::get", "c/o.rs", kind="method"), fn(8, "get", "file::d/p.rs::Other::get", "d/p.rs", kind="method"),
        fn(9, "grow", "file::c/o.rs::Tree::grow", "c/o.rs", kind="method"), fn(10, "grow", "file::d/p.rs::Bush::grow", "d/p.rs", kind="method"),
        fn(11, "help", "file::x/util.rs::help", "x/util.rs"), fn(12, "help", "file::y/misc.rs::help", "y/misc.rs"),
        fn(13, "side", "file::a/q.rs::side", "a/q.rs"), fn(14, "side", "file::z/r.rs::side", "z/r.rs"),
        fn(15, "hot", "file::x/s.rs::hot", "x/s.rs"), fn(16, "hot", "file::y/t.rs::hot", "y/t.rs"),
        fn(17, "lost", "file::x/s.rs::lost", "x/s.rs"), fn(18, "lost", "file::y/t.rs::lost", "y/t.rs"),
        (40, "module", "util", {"qualified_name": "module::crate::util", "source_uri": None}),
        *[(50 + i, "function", n, {"qualified_name": f"call::{n}", "source_uri": None}) for i, n in enumerate(["only", "near", "scoped", "get", "grow", "help", "side", "hot", "lost", "nobody"])],
    ]
    edges = [(1, 50, "calls"), (1, 51, "calls"), (1, 52, "calls", {"call_scope": "Beta"}), (1, 53, "calls", {"call_receiver": "s"}), (1, 54, "calls", {"call_receiver": "t"}), (1, 55, "calls"), (1, 56, "calls"), (1, 57, "calls"), (1, 58, "calls"), (1, 59, "calls"),
             (1, 40, "imports"), (2, 15, "calls"), (3, 15, "calls"), (3, 16, "calls")]
    g = make(spark, nodes, edges)
    got = {r.edge_id: (r.candidate, r.resolved_from) for r in enrich.resolve_calls(g).collect()}
    assert got == {0: (2, "unique"), 1: (3, "same_file"), 2: (6, "scope"), 3: (7, "receiver"), 4: (9, "receiver"), 5: (11, "import"), 6: (13, "same_dir"), 7: (15, "frequency")}
    done = enrich.apply_resolution(g)
    e = {r.edge_id: r for r in done.edges.collect()}
    assert (e[0].dst, e[0].conf_class, e[7].conf_class, e[7].confidence, e[8].conf_class) == (2, "extracted", "inferred", 0.7, "extracted")
    assert done.nodes.where("qualified_name like 'call::%'").count() == 2


def test_mentions_tests_and_births(spark):
    g = make(spark, [(1, "section", "intro", {"properties": json.dumps({"pending_mentions": [["loadGraph", 0.85], ["m::b", 0.7], ["zzz", 0.7]]})}), (2, "function", "load_graph"), (3, "function", "b"), (4, "function", "test_b", {"is_test": True}), (5, "section", "broken", {"properties": '{"pending_mentions":[["b",1'})],
             [(4, 3, "calls"), (4, 3, "calls")])
    assert {(r.section_id, r.token) for r in enrich.pending_mentions(g.nodes).collect()} == {(1, "loadGraph"), (1, "m::b"), (1, "zzz")}
    assert {(r.section_id, r.node_id, r.confidence) for r in enrich.resolve_mentions(enrich.pending_mentions(g.nodes), g).collect()} == {(1, 2, 0.85)}
    assert [tuple(r) for r in enrich.tested_by(g).collect()] == [(3, 4)]
    born = enrich.stamp_birth(g.nodes, "c9", spark.createDataFrame([("m::b", "c1")], "qualified_name string, valid_from string"))
    assert {r.name: r.valid_from for r in born.collect()} == {"intro": "c9", "load_graph": "c9", "b": "c1", "test_b": "c9", "broken": "c9"}


def test_aliases(spark):
    i = spark.createDataFrame([("@/lib/x", "web/app/a.ts"), ("@/lib/y", "other/a.ts"), ("~cfg", "web/app/a.ts")], "import string, importer string")
    a = spark.createDataFrame([("web/", "@/*", "src/*"), ("", "@/*", "root/*"), ("web/", "~cfg", "src/config.ts")], "config_dir string, pattern string, target string")
    f = spark.createDataFrame([("web/src/lib/x.ts",), ("root/lib/y/index.ts",), ("web/src/config.ts",)], "path string")
    assert {r["import"]: r.path for r in enrich.alias_targets(i, a, f).collect()} == {"@/lib/x": "web/src/lib/x.ts", "@/lib/y": "root/lib/y/index.ts", "~cfg": "web/src/config.ts"}


def test_an_alias_configuration_counts_for_its_own_folder_only(spark):
    """``pkg/a`` is no folder above ``pkg/ab/y.ts``; a pattern without a star, and the nearest of two configurations."""
    i = spark.createDataFrame([("@/x", "pkg/ab/y.ts"), ("@/x", "pkg/a/deep/z.ts"), ("@/x", "pkg/a/own/z.ts")], "import string, importer string")
    a = spark.createDataFrame([("pkg/a", "@/*", "src/*"), ("pkg/a/own/", "@/*", "lib/*")], "config_dir string, pattern string, target string")
    f = spark.createDataFrame([("pkg/a/src/x.ts",), ("pkg/a/own/lib/x.ts",)], "path string")
    found = enrich.alias_targets(i, a, f)
    assert {r.importer: r.path for r in found.collect()} == {"pkg/a/deep/z.ts": "pkg/a/src/x.ts", "pkg/a/own/z.ts": "pkg/a/own/lib/x.ts"}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_validity_windows(spark):
    commits = spark.createDataFrame([(f"c{i}", i) for i in range(1, 4)], "sha string, ord int")
    g = make(spark, [(1, "function", "old", {"valid_from": "c1", "valid_to": "c2"}), (2, "function", "new", {"valid_from": "c3"}), (3, "function", "ever"), (4, "function", "odd", {"valid_from": "zz"})], [(1, 3, "calls", {"valid_from": "c1", "valid_to": "c1"})])
    at = lambda c: {r.name for r in temporal.active_at(g.nodes, commits, c).collect()}
    assert at("c2") == {"old", "ever"} and at("c3") == {"new", "ever"}
    d = temporal.temporal_diff(g.nodes, commits, "c2", "c3", "id")
    assert {tuple(r) for r in d.collect()} == {(1, "removed"), (2, "added")}
    e = temporal.temporal_diff(g.edges, commits, "c1", "c2", "edge_id")
    assert {r.id for r in temporal.changed_nodes(d.select("id"), e, g.edges).collect()} == {1, 2, 3}
    assert temporal.linear_ancestry(commits).count() == 6
    both = temporal.with_archive(g.nodes.where("id = 2"), g.nodes.where("id = 1").withColumn("qualified_name", F.lit("m::new")))
    assert [r.id for r in both.collect()] == [2]


def test_dead_code_and_rename(spark):
    g = make(spark, [(1, "function", "plain"), (2, "function", "called"), (3, "function", "main"), (4, "function", "lonely", {"source_uri": "tests/a.rs"}), (5, "function", "imported"), (6, "function", "renew"), (7, "function", "called_twice", {"line_start": 44})], [(3, 2, "calls"), (3, 5, "imports"), (2, 7, "defines")])
    assert {r.name for r in refactor.dead_code(g).collect()} == {"plain", "called_twice"}
    edits = {(r.file, r.line): r.confidence for r in refactor.rename_preview(g, "m::called", "fresh").collect()}
    assert edits == {("src/called.rs", 1): "high", ("src/main.rs", 1): "high", ("src/called_twice.rs", 44): "medium"}


def test_hunks_risk_and_snippets(spark):
    g = make(spark, [(1, "file", "a", {"source_uri": "src/a.rs", "line_end": 100}), (2, "function", "f", {"source_uri": "src/a.rs", "line_start": 10, "line_end": 20}), (3, "function", "g", {"source_uri": "lib/src/a.rs", "line_start": 12, "line_end": 13})], [(3, 2, "calls")])
    h = spark.createDataFrame([("src/a.rs", 12, 1), ("src/a.rs", 50, 0)], "path string, new_start int, new_count int")
    assert {(r.new_start, r.id) for r in review.nodes_of_hunks(g.nodes, h).collect()} == {(12, 2), (12, 3), (50, 1)}
    assert {(r.new_start, tuple(r.symbols)) for r in review.changed_ranges(g.nodes, h).collect()} == {(12, ("m::g", "m::f")), (50, ("m::a",))}
    out = review.review(g, g.nodes.where("id = 2").select("id"))
    assert {r.id for r in out["impacted"].collect()} == {3} and out["risk"].first().missing == 1
    files = spark.createDataFrame([("p", "\n".join(f"l{i}" for i in range(1, 41)))], "path string, text string")
    r = spark.createDataFrame([("p", 10, 10), ("p", 13, 13), ("p", 39, 40)], "path string, line_start int, line_end int")
    assert [x.line_no for x in review.snippets(files, r).orderBy("line_no").collect()] == [*range(6, 18), *range(35, 41)]
    assert review.within_budget([("a", 100), ("b", 1000), ("c", 10)], 150) == (110, ["a", "c"])


def test_similarities():
    assert similarity.levenshtein("kitten", "sitting") == 3
    assert abs(similarity.jaro_winkler("MARTHA", "MARHTA") - 0.9611) < 1e-4 and similarity.jaro_winkler("", "a") == 0.0
    assert similarity.fuzzy_score("grpah", "graph") > 0.58 and similarity.fuzzy_score("gb", "graph builder") == 1.0
    assert similarity.fuzzy_score("", "x") == 0.0
    assert names.identifier_words_text("HTTPServer2_loadGraph") == "http server 2 load graph"
    assert search.query_identifiers("where is loadGraph or HTTPServer and snake_case?") == ["http server", "snake case"]


def test_search(spark):
    g = make(spark, [(1, "function", "load_graph"), (2, "function", "load_graph_file"), (3, "class", "GraphLoader"), (4, "function", "load_graph_test", {"source_uri": "tests/t.rs"}), (5, "function", "unrelated"), (6, "function", "naïve_café")], [(5, 1, "calls")])
    hits = [r.qualified_name for r in search.ranked_search(g, "load graph").collect()]
    assert hits[0] == "m::load_graph" and hits.index("m::load_graph_file") < hits.index("m::load_graph_test") and "m::unrelated" not in hits
    assert search.ranked_search(g, "laod grpah").first().qualified_name == "m::load_graph"
    assert search.ranked_search(g, " ").count() == 0 and search.ranked_search(g, "café").first().qualified_name == "m::naïve_café"
    index = search.build_index(g.nodes, "id", F.col("name"))
    assert {r.id for r in search.bm25(*index, "id", "loa graph").collect()} == {1, 2, 4} and search.bm25(*index, "id", "").count() == 0
    assert {r.id for r in search.bm25(*index, "id", "loa", prefix=False).collect()} == set()
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, [0.0, 0.0])], "id bigint, vector array<double>")
    assert {(r.id, round(r.score, 3)) for r in search.vector_search(v, "id", "vector", [1.0, 0.0]).collect()} == {(1, 1.0), (2, 0.707)}
    assert {r.id for r in search.related(v, "id", "vector", 1).collect()} == {2} and search.related(v, "id", "vector", 99).count() == 0
    e = embedding.embed_nodes(g.nodes)
    assert search.semantic_query(e, "node_id", "vector", "function load graph m").orderBy(F.desc("score")).first().node_id == 1
    fused = search.hybrid_search(g, "load_graph", 3, index, v, [1.0, 0.0]).collect()
    assert fused[0].qualified_name == "m::load_graph" and len(fused) == 3
    assert search.resolve_symbol(g, "m::unrelated") == 5 and search.resolve_symbol(g, "GraphLoader") == 3
    with pytest.raises(search.AmbiguousSymbol):
        search.resolve_symbol(g, "graph")


def test_embeddings(spark):
    a, b, c = embedding.embed("fn load_graph(path) -> Graph"), embedding.embed("fn load_graphs(path) -> Graph"), embedding.embed("delete cookie banner")
    assert abs(float(a @ a) - 1) < 1e-5 and float(a @ b) > 0.8 > float(a @ c) and not embedding.embed("…").any()
    g = make(spark, [(1, "function", "a", {"source_text": "x"}), (2, "function", "x", {"qualified_name": "call::x"})], [])
    assert [(r.node_id, len(r.vector)) for r in embedding.embed_nodes(g.nodes).collect()] == [(1, 384)]
    with pytest.raises(ValueError):
        embedding.embed_nodes(g.nodes, "other")


def test_label_merging(spark):
    cases = {"method v2": "method", "auth_1603": "auth", "a   b--c": "a_b_c", "123": "123", "Café View": "caf_view"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert {r.t: r.n for r in df.select("t", dedup.normalised_label(F.col("t")).alias("n")).collect()} == cases
    gate = spark.createDataFrame([("aaaa", False), ("abcd", True), ("data", False), ("start", True), ("ab", True), ("", True)], "t string, want boolean")
    assert gate.where(dedup.passes_entropy_gate(F.col("t")) != F.col("want")).count() == 0
    g = make(spark, [(1, "concept", "Authentication"), (2, "concept", "Authentification"), (3, "concept", "User"), (4, "concept", "Authentication", {"qualified_name": "m::again"}), (5, "function", "Authentication", {"qualified_name": "m::fn"})], [(3, 2, "mentions"), (3, 1, "mentions"), (1, 2, "similar_to"), (5, 2, "mentions")])
    near = dedup.duplicate_pairs(g, threshold=0.92).collect()
    assert {(r.a, r.b) for r in near} >= {(1, 4)}
    merged = g.merge_nodes(dedup.merge_map(g, spark.createDataFrame([(1, 2), (2, 4)], "a bigint, b bigint")))
    assert {r.id for r in merged.nodes.collect()} == {1, 3, 5} and {(r.src, r.dst) for r in merged.edges.collect()} == {(3, 1), (5, 1)}
    assert dedup.deduplicate(g)[0].nodes.where("id = 4").count() == 0


def test_motifs(spark):
    g = make(spark, [(0, "class", "A"), (1, "class", "B"), (2, "class", "C"), (3, "class", "D"), (4, "function", "run_sql"), (5, "function", "esc")], [(0, 1, "inherits"), (0, 2, "inherits"), (1, 3, "inherits"), (2, 3, "inherits"), (4, 5, "calls"), (4, 5, "calls")])
    assert {tuple(r) for r in motifs.find_motifs(g, motifs.DIAMOND).collect()} == {(0, 1, 2, 3), (0, 2, 1, 3)}
    assert [tuple(r) for r in motifs.find_motifs(g, motifs.SECURITY_AUDIT).collect()] == [(4, 5)]
    one = lambda **x: motifs.find_motifs(g, motifs.Motif().node(0, **x)).count()
    assert one(name="A") == 1 and one(name="SQL", match="contains") == 1 and one(name="*_sql", match="glob") == 1 and one(name="^e.c$", match="regex") == 1 and one(min_degree=2) == 6
    assert motifs.find_motifs(g, motifs.Motif()).count() == 0
    for bad in (motifs.Motif().node(0).node(0), motifs.Motif().node(0).edge(0, 1), motifs.Motif().node(0).node(1)):
        with pytest.raises(ValueError):
            motifs.find_motifs(g, bad)
    m = motifs.Motif.from_json('{"nodes":[{"id":0,"kind":"class"},{"id":1}],"edges":[{"from":0,"to":1,"kind":"inherits"}]}')
    assert motifs.find_motifs(g, m).count() == 4


def test_operations(spark):
    g = make(spark, [(i, "function", n, {"line_end": 100}) for i, n in enumerate(["main", "work", "help", "rest"])], [(0, 1, "calls"), (1, 2, "calls"), (2, 1, "calls"), (0, 3, "calls")])
    vectors = embedding.embed_nodes(g.nodes)
    files = spark.createDataFrame([("src/work.rs", "a\nb\nc")], "path string, text string")
    hunks = spark.createDataFrame([("src/work.rs", 1, 1, 2, 1)], "path string, old_start int, old_count int, new_start int, new_count int")
    commits = spark.createDataFrame([("c1", 1), ("c2", 2)], "sha string, ord int")
    c = ops.Context(g, commits, hunks, vectors, files)
    params = {"paths": {"source": "m::main", "target": "m::help"}, "graph_diff": {"base": "c1", "head": "c2"}, "rename_preview": {"target": "m::work", "new_name": "job"}}
    for name in ops.OPERATIONS:
        need = {"target": "m::work"} if name in ("impact", "callers", "callees", "traverse", "counterfactual", "find_related", "node_card") else {}
        out = ops.respond(c, name, **params.get(name, need))
        assert out["pagination"]["total"] >= len(out["rows"]) and len(out["hints"]["next"]) <= 3
    assert ops.respond(c, "callers", target="m::work", response_limit=1)["pagination"]["next"] == 1
    assert ops.run(c, "k_core").count() == 4
    with pytest.raises(ValueError):
        ops.run(c, "nonsense")


def test_command_line(spark, folder, capsys):
    from knotwork.__main__ import main

    assert main(["hub_nodes", "--folder", folder, "--params", '{"response_limit": 2}']) == 0
    out = json.loads(capsys.readouterr().out)
    assert len(out["rows"]) == 2 and out["rows"][0]["degree"] >= out["rows"][1]["degree"]

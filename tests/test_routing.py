"""The format graph and planning on it."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from foliograph import catalog
from foliograph.operators import routing

BOTH = (catalog.ALWAYS, catalog.MACOS)


def routes_of(spark, caps):
    return {(r.src_fmt, r.dst_fmt): (r.cost, r.route) for r in routing.catalog_routes(spark, caps).collect()}


@pytest.mark.parametrize(
    "caps, edges, nodes, sources, pairs, by_hops",
    [
        ((catalog.ALWAYS,), 157, 31, 30, 295, [157, 82, 41, 15]),
        (BOTH, 170, 32, 31, 322, [170, 93, 44, 15]),
    ],
)
def test_golden_numbers(spark, caps, edges, nodes, sources, pairs, by_hops):
    rows = routing.usable_edges(catalog.edges(spark), list(caps)).collect()
    assert len(rows) == edges
    assert len({r.src_fmt for r in rows} | {r.dst_fmt for r in rows}) == nodes
    assert len({r.src_fmt for r in rows}) == sources
    routes = routes_of(spark, caps)
    assert len(routes) == pairs
    assert [sum(len(r) == n + 1 for _, r in routes.values()) for n in (1, 2, 3, 4)] == by_hops
    assert max(c for c, _ in routes.values()) == 22


def test_known_routes(spark):
    routes = routes_of(spark, (catalog.ALWAYS,))
    assert routes["png", "mobi"] == (14, ["png", "pdf", "mobi"])
    assert routes["png", "txt"] == (18, ["png", "pdf", "md", "txt"])
    assert routes["mp4", "txt"] == (22, ["mp4", "gif", "pdf", "md", "txt"])
    assert routes["json", "yaml"] == (1, ["json", "yaml"])
    assert routes["png", "tiff"] == (2, ["png", "tiff"])
    assert ("csv", "toml") not in routes
    assert routes_of(spark, BOTH)["heic", "webp"][1] == ["heic", "tiff", "webp"]


def test_every_edge_has_one_handler(spark):
    edges, handlers = catalog.edges(spark), catalog.handlers(spark)
    assert routing.uncovered(edges, handlers).isEmpty()
    assert handlers.count() == edges.count()
    pair = edges.select(F.lit("png").alias("src_fmt"), F.lit("zip").alias("dst_fmt")).limit(1)
    assert routing.route_hops(pair, handlers).first().error == "No converter handles .png → zip"


def test_direct_targets_surface(spark):
    image = ["png", "jpg", "webp", "bmp", "tiff", "gif"]
    expected = {
        "png": [*image[1:], "avif", "pdf"], "jpeg": [f for f in image if f != "jpg"] + ["avif", "pdf"],
        "avif": [*image, "pdf"], "mp4": ["mov", "mkv", "webm", "avi", "gif"], "mp3": ["aac", "flac", "ogg", "wav", "opus", "m4a"],
        "json": ["yaml", "toml", "csv"], "yml": ["json", "toml", "csv"], "toml": ["json", "yaml", "csv"], "csv": ["json", "yaml"],
        "markdown": ["txt", "html", "pdf", "tex", "typst"], "latex": ["md", "html", "pdf", "typst"],
        "epub": ["pdf", "mobi", "md", "html"], "mobi": ["epub", "pdf", "html", "md"], "pdf": ["epub", "mobi", "html", "md"],
        "xyz": None, "heic": None, "": None,
    }
    edges = routing.usable_edges(catalog.edges(spark), [catalog.ALWAYS])
    manifest = spark.createDataFrame([(f"/x.{e}", e) for e in expected], "path string, ext string")
    found = {r.ext: r for r in routing.detect(manifest, edges, routing.catalog_routes(spark)).collect()}
    for ext, targets in expected.items():
        assert found[ext].direct == targets, ext
        assert (found[ext].error is None) == (targets is not None)
    assert found["xyz"].error == "Unsupported file type: .xyz"
    chained = found["png"].chained
    assert [(c.hops, c.format) for c in chained] == sorted((c.hops, c.format) for c in chained)
    assert all(c.hops >= 2 and c.format not in found["png"].direct for c in chained)
    assert "mobi" in [c.format for c in chained]
    lost = routing.unsupported(manifest, edges).collect()
    assert {r.ext for r in lost} == {"xyz", "heic", ""}


def test_plan_errors(spark):
    items = spark.createDataFrame(
        [("jpeg", "png"), ("csv", "toml"), ("png", "png"), ("jpg", "jpeg"), ("zip", "png"), ("md", "zip")], "ext string, target string"
    )
    got = {(r.ext, r.target): r for r in routing.plan_routes(items, routing.catalog_routes(spark)).collect()}
    assert got["jpeg", "png"].route == ["jpg", "png"] and got["jpeg", "png"].error is None
    for pair in [("csv", "toml"), ("png", "png"), ("jpg", "jpeg"), ("zip", "png"), ("md", "zip")]:
        assert got[pair].route is None
        assert got[pair].error == f"No conversion path from .{pair[0]} to {pair[1]}"


def test_ties_and_hop_limit(spark):
    edges = spark.createDataFrame(
        [("s", "a", 1), ("s", "b", 2), ("a", "t", 2), ("b", "t", 1), ("s", "c", 2), ("c", "u", 1), ("b", "u", 1)]
        + [(f"n{i}", f"n{i + 1}", 1) for i in range(8)] + [("n0", "n7", 90)],
        "src_fmt string, dst_fmt string, cost int",
    )
    routes = {(r.src_fmt, r.dst_fmt): r for r in routing.min_cost_paths(edges).collect()}
    assert routes["s", "t"].route == ["s", "a", "t"]  # nearer predecessor
    assert routes["s", "u"].route == ["s", "c", "u"]  # equally near: larger name
    assert routes["n0", "n6"].hops == 6
    assert ("n0", "n7") not in routes  # the cheapest path has 7 hops, the dearer direct edge does not count
    with pytest.raises(ValueError):
        routing.min_cost_paths(edges.withColumn("cost", F.lit(0)))
    some = {(r.src_fmt, r.dst_fmt): r for r in routing.min_cost_paths(edges, sources=["s", "n2"]).collect()}
    assert some == {pair: r for pair, r in routes.items() if pair[0] in ("s", "n2")}


def shortest(edges, source):
    """Plain search with the same tie rule, for comparison."""
    dist, prev, heap, order = {source: 0}, {}, [(0, source)], {}
    while heap:
        d, node = heapq.heappop(heap)
        if d > dist[node]:
            continue
        for (a, b), c in edges.items():
            if a == node and d + c < dist.get(b, 10**9):
                dist[b] = d + c
                heapq.heappush(heap, (d + c, b))
    for node in dist:
        if node != source:
            near = min(dist[a] for (a, b), c in edges.items() if b == node and a in dist and dist[a] + c == dist[node])
            prev[node] = max(a for (a, b), c in edges.items() if b == node and dist.get(a) == near and near + c == dist[node])
    return dist, prev


def test_random_graphs(spark):
    rng = random.Random(7)
    for _ in range(3):
        names = [f"v{i:02d}" for i in range(12)]
        edges = {(a, b): rng.randint(1, 4) for a in names for b in names if a != b and rng.random() < 0.2}
        df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src_fmt string, dst_fmt string, cost int")
        got = {(r.src_fmt, r.dst_fmt): (r.cost, r.route) for r in routing.min_cost_paths(df, max_hops=4).collect()}
        want = {}
        for source in {a for a, _ in edges}:
            dist, prev = shortest(edges, source)
            for node in prev:
                route = [node]
                while route[0] != source:
                    route.insert(0, prev[route[0]])
                if len(route) <= 5:
                    want[source, node] = (dist[node], route)
        assert got == want


def test_expand_plan(spark):
    items = spark.createDataFrame([("/in/a.png", "png", "html"), ("/in/b.json", "json", "yaml")], "path string, ext string, target string")
    steps = routing.expand_plan(items, routing.catalog_steps(spark), "/tmp/x", "/out").orderBy("path", "step").collect()
    assert [(s.in_path, s.out_path, s.is_last, s.hop_kind, s.percent) for s in steps] == [
        ("/in/a.png", "/tmp/x/a.pdf", False, "image_to_pdf", 0.0),
        ("/tmp/x/a.pdf", "/out/a.html", True, "pdf_to_html", 50.0),
        ("/in/b.json", "/out/b.yaml", True, "data", 0.0),
    ]


def test_common_targets(spark):
    rows = [(1, "json"), (1, "yml"), (2, "png"), (3, "csv"), (3, "toml"), (4, "mp3"), (4, "png"), (5, "csv"), (5, "xyz"), (5, "csv")]
    manifest = spark.createDataFrame(rows, "batch_id int, ext string")
    edges = routing.usable_edges(catalog.edges(spark), [catalog.ALWAYS])
    got = {(r.batch_id, r.target) for r in routing.common_targets(manifest, edges).collect()}
    assert got == {(1, "toml"), (1, "csv"), (3, "json"), (3, "yaml"), (5, "json"), (5, "yaml")}


def test_format_params(spark):
    plan = spark.createDataFrame([(e,) for e in ["txt", "md", "tex", "latex", "typst", "epub", "pdf", "png"]], "ext string")
    got = {r.ext: (r.reader, r.writer) for r in routing.format_params(plan, catalog.format_params(spark), F.col("ext"), ["reader", "writer"]).collect()}
    assert got["txt"] == ("markdown", "plain") and got["png"] == (None, None)
    assert all(got[e][0] == got[e][1] for e in ["md", "tex", "latex", "typst", "epub", "pdf"])


def test_the_excluded_route_is_known_with_its_tie(spark):
    every = {(r.src_fmt, r.dst_fmt): r.route for r in routing.catalog_all_routes(spark).collect()}
    assert every["csv", "toml"] == ["csv", "yaml", "toml"]
    assert set(every) - set(routes_of(spark, (catalog.ALWAYS,))) == {("csv", "toml")}


def test_rounds_write_only_what_got_cheaper(spark, monkeypatch):
    """A long chain with ever cheaper detours: the same costs as a plain search, and no round writes all pairs again."""
    rng = random.Random(11)
    rows = [(f"n{i}", f"n{i + 1}", rng.randrange(1, 9)) for i in range(24)] + [(f"n{i}", f"n{j}", 3 * (j - i) + 9) for i in range(20) for j in (i + 3, i + 5) if j < 25]
    written = []
    plain = routing.settle_counting

    def counting(df, flag):
        out = plain(df, flag)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(routing, "settle_counting", counting)
    found = routing.min_cost_paths(spark.createDataFrame(rows, "src_fmt string, dst_fmt string, cost int"), max_hops=30)
    costs = {(r.src_fmt, r.dst_fmt): r.cost for r in found.collect()}
    nexts = {}
    for a, b, c in rows:
        nexts.setdefault(a, {})[b] = min(c, nexts.get(a, {}).get(b, c))
    for a in nexts:
        best, queue = {a: 0}, [(0, a)]
        while queue:
            c, at = heapq.heappop(queue)
            for b, step in nexts.get(at, {}).items():
                if c + step < best.get(b, 10**9):
                    best[b] = c + step
                    heapq.heappush(queue, (c + step, b))
        assert {b: c for (s, b), c in costs.items() if s == a} == {b: c for b, c in best.items() if b != a}
    assert len(written) > 10 and written[-1] == 0 and max(written[6:]) < len(costs) / 2

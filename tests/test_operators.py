"""Graph, triples, text, resolution, vectors, evaluation, streaming on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import community, evaluate, graph, report, resolve, text, triples, vectors
from riskloom.operators.components import connected_components
from riskloom.sources import connectors
from riskloom.streaming import risk


def test_components_random(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weights(spark):
    e = spark.createDataFrame([("a", "x", "supplies"), ("a", "b", "alternative_to"), ("a", "c", "alternative_to"), ("b", "a", "located_in")], "src string, dst string, relation string")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.criticality_weights(e).collect()}
    assert got == {("a", "x"): 0.333, ("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "a"): 1.0}


def test_graph_edge_cases(spark):
    nodes = spark.createDataFrame([("a", "Part"), ("b", "Part"), ("lone", "Part")], "name string, entity_type string")
    edges = spark.createDataFrame([("a", "b", "supplies", 1.0)], "src string, dst string, relation string, weight double")
    assert [r["name"] for r in graph.isolated_nodes(nodes, edges).collect()] == ["lone"]
    row = graph.graph_stats(nodes, edges).first()
    assert (row["n_nodes"], row["n_edges"], row["n_components"], row["connected"]) == (3, 1, 2, False)
    assert graph.graph_stats(nodes.limit(0), edges.limit(0)).first()["n_nodes"] == 0
    seeds = spark.createDataFrame([("a",)], "name string")
    assert {(r["name"], r["dist"]) for r in graph.bfs_distances(edges, seeds, 2).collect()} == {("a", 0), ("b", 1)}


def test_leader_clusters_are_greedy(spark):
    items = spark.createDataFrame([(i, i) for i in range(5)], "id int, place int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (3, 4)], "a int, b int")
    got = {r["id"]: r["leader"] for r in vectors.leader_clusters(items, pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}  # 2 leads since 1 does not; 3 follows 2, so 4 leads


def test_sentence_chunks_overlap(spark):
    d = spark.createDataFrame([(1, "Aaaa bb. Cccc dd. Eeee ff. " + "x" * 50 + "."), (2, None), (3, "")], "doc int, t string")
    got = [(r["doc"], r["piece"]) for r in text.sentence_chunks(d, "doc", F.col("t"), 20, 10).orderBy("doc", "chunk").collect()]
    assert got == [(1, "Aaaa bb. Cccc dd."), (1, "Cccc dd. Eeee ff."), (1, "Eeee ff. " + "x" * 50 + ".")] or got[0] == (1, "Aaaa bb. Cccc dd.")
    assert {g[0] for g in got} == {1}


def test_turns_drop_unlabelled_text(spark):
    d = spark.createDataFrame([("intro text\nJohn Smith: hello [x] there\nOperator: next",)], "t string")
    rows = d.select(F.explode(text.turns(F.col("t"))).alias("t")).select("t.*").collect()
    assert [(r["label"], r["content"]) for r in rows] == [("Smith", "hello there"), ("Operator", "next")]


def test_fuzzy_ratio_and_groups(spark):
    q = spark.createDataFrame([("Acme Steel Corp", "steel acme corp"), ("Zed", "zed")], "name string, key string")
    known = spark.createDataFrame([("steel acme corps", "ACME")], "key string, canonical string")
    rows = resolve.fuzzy_matches(q, known, 88.0).collect()
    assert [(r["name"], r["canonical"]) for r in rows] == [("Acme Steel Corp", "ACME")] and rows[0]["ratio"] == pytest.approx(200 * 15 / 31)


def test_located_in_cases(spark):
    rows = [(1, "x", "Part", "located_in", "r", "Region", 1.0), (2, "r", "Region", "located_in", "q", "Region", 1.0), (3, "r", "Region", "located_in", "e", "DisruptionEvent", 1.0)]
    t = spark.createDataFrame(rows, "seq int, head string, head_type string, relation string, tail string, tail_type string, confidence double")
    got = sorted((r["seq"], r["head"], r["tail"]) for r in triples.direct_located_in(t).collect())
    assert got == [(1, "r", "x"), (2, "q", "r"), (2, "r", "q"), (3, "e", "r")]


def test_evaluation_empty(spark):
    t = spark.createDataFrame([], "source string, head string, relation string, tail string, head_type string, tail_type string, seq int, evidence string, confidence string")
    row = evaluate.precision_recall(evaluate.matched(t, t)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert evaluate.validity(t).first()["evidence_share"] == 0.0


def test_communities(spark):
    nodes = spark.createDataFrame([(c, "Part") for c in "abcxyz"], "name string, entity_type string")
    edges = spark.createDataFrame([(p[0], p[1], "supplies", 1.0) for p in ("ab", "bc", "ac", "xy", "yz", "xz")] + [("c", "x", "supplies", 0.1)], "src string, dst string, relation string, weight double")
    part = community.label_propagation(nodes, edges)
    got = {r["name"]: r["community"] for r in part.collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]
    assert community.modularity(part, edges).first()[0] > 0.3
    assert community.describe(part, nodes, edges).count() == 2


def test_report_round_trip(spark):
    e = report.DisruptionEvent("Quake", ("a",), 0.9, "natural", "strikes")
    full = report.template_report(e, ["a [CRITICAL]", "b (alternative available)"])
    row = report.parse_report(spark.createDataFrame([(full,)], "full_text string")).first()
    assert row["resilience_assessment"].startswith("HIGH") and "switch: b" in row["mitigations"] and "a [CRITICAL]" in row["critical_edges"]
    vecs = report.embed_texts(spark.createDataFrame([("steel plant",), (None,)], "t string"), "t").collect()
    assert sum(x * x for x in vecs[0]["vector"]) == pytest.approx(1) and not any(vecs[1]["vector"])
    ans = spark.createDataFrame([('```json\n[{"head": "a"}]\n```',), ('noise [{"head": "b"}] tail',), ("none",)], "t string")
    got = [r[0] for r in ans.select(report.extract_json(F.col("t"), "array<struct<head:string>>")).collect()]
    assert [g and g[0]["head"] for g in got] == ["a", "b", None]


def test_connectors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "s", "text": "t1"}\n{"text": "t2"}\nbroken\n')
    got = sorted((r["source"], r["text"]) for r in connectors.read_documents(spark, str(tmp_path / "a.jsonl"), "jsonl").collect())
    assert got == [("a.jsonl", "t2"), ("s", "t1")]
    row = ["0"] * 58
    row[51], row[30], row[33] = "TW", "-5.5", "4"
    (tmp_path / "day.tsv").write_text("\t".join(row) + "\nshort\trow\n")
    days = connectors.read_event_days(spark, str(tmp_path / "day.tsv"), ["TW"]).collect()
    assert len(days) == 1 and days[0]["goldstein"] == -5.5 and days[0]["articles"] == 4
    (tmp_path / "m.csv").write_text("Country,Prod_2023\nChile1,5300\nCongoe,W\nWorld total,9\n")
    rows = connectors.read_minerals(spark, str(tmp_path / "m.csv"), {"country": ["country", "Country"], "production": ["Prod_2023"]}).collect()
    assert [(r["country"], r["production"]) for r in rows] == [("Chil", "5300"), ("Congoe", None)]
    sub = spark.createDataFrame([(1, ["10-K", "8-K", "10-K"], ["a", "b", "c"], ["x", "y", "z"])], "cik int, forms array<string>, accessions array<string>, documents array<string>")
    assert [r["accession"] for r in connectors.filings(sub, "10-K", 1).collect()] == ["a"]
    nodes = spark.createDataFrame([("a", "Part")], "name string, entity_type string")
    edges = spark.createDataFrame([("b", "a", "supplies"), ("a", "b", "supplies")], "src string, dst string, relation string")
    connectors.write_snapshot(nodes, edges, str(tmp_path / "snap"))
    assert connectors.read_snapshot(spark, str(tmp_path / "snap"))[1].count() == 2
    connectors.append_log(edges, str(tmp_path / "log"))
    connectors.append_log(edges, str(tmp_path / "log"))
    log = spark.read.schema("src string, dst string").json(str(tmp_path / "log"))
    assert log.count() == 4 and triples.unprocessed(edges, log, ["src", "dst"]).count() == 0
    connectors.write_payload(nodes, str(tmp_path / "pay"))
    assert json.loads(spark.read.text(str(tmp_path / "pay")).first()[0]) == {"name": "a", "entity_type": "Part"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = risk.risk_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("risk_counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["d"], r["country"]): r["n"] for r in spark.sql("select date_format(window.start, 'yyyyMMdd') d, country, n from risk_counts").collect()}
    want = {(r["day"], r["country"]): r["count"] for r in risk.risk_events(events).groupBy("day", "country").count().collect()}
    assert got == want


def test_extraction_default(spark):
    from riskloom.operators import extract

    d = spark.createDataFrame([(1, "Acme Corp supplies Bolt Works. Bolt Works depends on Steel Co."), (2, None), (3, "")], "k int, t string")
    got = sorted((r["k"], r["head"], r["relation"], r["tail"]) for r in extract.extract_triples(d, "k", "t").collect())
    assert got == [(1, "Acme Corp", "supplies", "Bolt Works"), (1, "Bolt Works", "depends_on", "Steel Co")]


def test_guide_text(spark):
    d = spark.sql("select array(struct('Open' as title, array(struct('lift lid' as text_raw), struct('turn' as text_raw)) as lines)) as steps")
    assert d.select(connectors.guide_text(F.col("steps"))).first()[0] == "Open lift lid turn"


def test_fuzzy_matching_loses_nothing(spark):
    rng = random.Random(21)
    words = ["steel", "acme", "corp", "works", "north", "ab", "x", "metal", "holding"]
    names = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(60)]
    known = []
    for n in names:
        letters = list(" ".join(rng.sample(n.split(), len(n.split()))))
        for _ in range(rng.randrange(0, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz")
        known.append("".join(letters).strip() or "z")
    q = spark.createDataFrame([(f"{i} {n}", n) for i, n in enumerate(names)], "name string, key string")
    k = spark.createDataFrame([(x, f"{j:02d}") for j, x in enumerate(known)], "key string, canonical string")
    for cutoff in (85.0, 92.0):
        got = {r["name"]: (r["canonical"], r["ratio"]) for r in resolve.fuzzy_matches(q, k, cutoff).collect()}
        want = {}
        for i, n in enumerate(names):
            best = min((-resolve._ratio(n, x), f"{j:02d}") for j, x in enumerate(known))
            if -best[0] >= cutoff:
                want[f"{i} {n}"] = (best[1], -best[0])
        assert got == want
    swapped = resolve.fuzzy_matches(spark.createDataFrame([("a", "acme corp")], "name string, key string"), spark.createDataFrame([("corp acme", "A")], "key string, canonical string"), 88.0)
    assert swapped.first()["ratio"] == 100


def test_equal_triples_have_an_order(spark):
    rows = [(1, 0, "a", "Part", "supplies", "b", t, 0.5) for t in ("Region", "Part", "Customer")]
    for some in (rows, rows[::-1]):
        t = spark.createDataFrame(some, "seq int, chunk int, head string, head_type string, relation string, tail string, tail_type string, confidence double")
        assert triples.dedupe_first(t, ["chunk"]).first()["tail_type"] == triples.merge_best(t).first()["tail_type"] == "Customer"


def test_cache_stores_and_answers(spark, tmp_path):
    from riskloom.operators import analyze

    cache = report.SemanticCache(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([("which parts does a quake stop",), ("something else entirely",)], "query string")
    assert cache.size() == 0 and cache.lookup(asked).count() == 0
    nodes = spark.createDataFrame([("a", "Part"), ("b", "Part")], "name string, entity_type string")
    edges = spark.createDataFrame([("a", "b", "supplies", 1.0)], "src string, dst string, relation string, weight double")
    seeds = spark.createDataFrame([("a", 0.9)], "name string, similarity double")
    event = report.DisruptionEvent("Quake", ("a",), 0.9, "natural", "strikes")
    first = analyze.analyze_cached(cache, "which parts does a quake stop", event, nodes, edges, seeds)
    again = analyze.analyze_cached(cache, "which parts does a quake stop", event, nodes, edges, seeds)
    assert not first[1] and again == (first[0], True) and cache.size() == 1
    assert [r["query"] for r in cache.lookup(asked).collect()] == ["which parts does a quake stop"]
    cache.clear()
    assert cache.size() == 0
    prompt = report.report_prompt(event, ["a [CRITICAL]"])
    assert "a [CRITICAL]" in prompt and all(f"## {t}" in prompt for t in report.SECTIONS.values())


def test_numbering_spreads_a_hot_group(spark):
    from riskloom.functions.numbering import number_rows

    rows = [("hot", f"n{i * 7 % 900:03}") for i in range(900)] + [(None, "b"), (None, "a"), ("one", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["name"]): r["place"] for r in number_rows(spark.createDataFrame(rows, "k string, name string"), "k", ["name"], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, n): i for k in ("hot", None, "one") for i, n in enumerate(sorted(n for q, n in rows if q == k), 1)}
    assert got == want
    assert number_rows(spark.createDataFrame([], "k string, name string"), "k", ["name"], "place").collect() == []


def test_blocks_search_as_pairs_do(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    make = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.5, 0.1]) for _ in range(3)]
    rows = [(i, make()) for i in range(60)] + [(i, [0.1, 0.5, 0.1]) for i in range(60, 80)]
    odd = [None, [1.0, None, 0.0], [1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 1.0, 0.0], [1e200, 1e200, 0.0], []]
    for some in (rows, rows + [(100 + i, x) for i, x in enumerate(odd)], [(i, x) for i, x in enumerate(odd)]):
        index = spark.createDataFrame(some, "id long, vector array<double>").repartition(3)
        queries = index.where("id % 3 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qvec"), F.col("id").alias("but"))
        for k, least in ((1, None), (5, None), (5, 0.26), (200, None)):
            pairs = index.crossJoin(queries).select("query", "id", "but", vectors.dot(F.col("vector"), F.col("qvec")).alias("score"))
            pairs = pairs if least is None else pairs.where(F.col("score") >= least)
            for asked, want in ((queries.drop("but"), pairs), (queries, pairs.where("id <> but"))):
                want = graph.top_per_key(want, ["query"], [F.desc("score"), "id"], k).select("query", "id", "score")
                got = vectors.search(index, asked, k, least)
                assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_leaders_are_found_without_pairs(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(vectors, "BLOCK", 5)
    make = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.5, 0.1]) for _ in range(3)]
    odd = [None, [1.0, None, 0.0], [1.0, 2.0], [2.0, 1.0], [float("nan"), 0.0, 0.0], [float("inf"), 1.0, 0.0]]
    vecs = [make() for _ in range(50)] + [[0.1, 0.5, 0.1]] * 30 + odd
    rng.shuffle(vecs)
    rows = [(i, (i * 37) % 101, x, i % 2 if i % 11 else None) for i, x in enumerate(vecs)]
    items = spark.createDataFrame(rows, "id long, place long, vector array<double>, label int").repartition(3)
    a, b = items.select("label", F.col("id").alias("a"), F.col("vector").alias("va")), items.select("label", F.col("id").alias("b"), F.col("vector").alias("vb"))
    pairs = a.join(b, "label").where("a < b").where(vectors.dot(F.col("va"), F.col("vb")) >= 0.26).select("a", "b")
    want = vectors.leader_clusters(items.select("id", "place"), pairs).collect()
    got = vectors.leader_search(items, 0.26, "label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["leader"] for r in got}) > 10
    assert vectors.leader_search(items.limit(0), 0.26, "label").collect() == []

"""Filters, sparse index, graph, change log, sources, streaming, configuration and queries."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclake import config
from veclake.functions import filters
from veclake.operators import ann, changes, metadata, search, sparse
from veclake.sources import bodies, fvecs


VALUES = [None, True, False, 0, 1, 1.0, -3, 2.5, 1e3, "", "1", "true", "red", [], [1, 2], [1.0, 2.0], [2, 1], {"x": 1}, {"x": 1.0, "y": [None]}, {"y": [None], "x": 1}]


def alike(a, b):
    """Deep equality, numbers by value, nothing else across types."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if number(a) and number(b):
        return float(a) == float(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    return len(a) == len(b) and all(map(alike, a, b)) if isinstance(a, list) else a == b


def test_variant_filter(spark):
    """Every value against every other, a key with dots and blanks, several keys, no metadata: as plain Python, in expressions and in kernels."""
    rows = [(i, json.dumps({"k": v, "a b.c": i % 2})) for i, v in enumerate(VALUES)] + [(98, json.dumps({"other": 1})), (99, None)]
    df = spark.createDataFrame(rows, "i int, m string").select("i", F.parse_json("m").alias("m"))
    wheres = [{"k": v} for v in VALUES] + [{"k": 1, "a b.c": 0}, {"k": 1, "a b.c": 1}, {"none": 1}, {}, None]
    got = df.select("i", *[filters.variant_match(F.col("m"), w).alias(f"w{n}") for n, w in enumerate(wheres)]).collect()
    for r in got:
        meta = json.loads(dict(rows)[r["i"]] or "null")
        for n, w in enumerate(wheres):
            want = all(meta is not None and k in meta and alike(meta[k], v) for k, v in (w or {}).items())
            assert r[f"w{n}"] == want == filters.matches(meta, w), (meta, w)


def test_typed_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "id long, s string, d double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    hit = df.where(filters.typed_match(df.schema, {"s": "y", "id": 2.0}))
    assert hit.count() == 1 and "PushedFilters: [IsNotNull" in hit._jdf.queryExecution().toString()
    assert df.where(filters.typed_match(df.schema, {"s": 2})).isEmpty() and df.where(filters.typed_match(df.schema, {"q": 1})).isEmpty()
    with pytest.raises(ValueError):
        filters.typed_match(df.schema, {"d": float("nan")})


def test_inverted_index(spark):
    """Postings, their numbers, and what is left without some documents, as by dictionaries."""
    rng = np.random.default_rng(13)
    docs = {f"d{i}": {int(t): float(w) for t, w in zip(rng.choice(30, rng.integers(0, 8), replace=False), rng.integers(1, 9, 8))} for i in range(25)}
    df = spark.createDataFrame([(i, (sorted(d), [d[t] for t in sorted(d)]) if d else None) for i, d in docs.items()], "id string, sparse struct<indices:array<bigint>,values:array<float>>")
    p = sparse.postings(df)
    for gone in (set(), {"d3", "d7", "d20"}, set(docs)):
        rest = sparse.without(p, df.where(F.col("id").isin(*gone))) if gone else p
        left = {i: d for i, d in docs.items() if i not in gone}
        assert tuple(sparse.index_stats(rest).first()) == (len({t for d in left.values() for t in d}), sum(map(len, left.values())))
        assert {(r["token"], r["id"], r["weight"]) for r in rest.collect()} == {(t, i, w) for i, d in left.items() for t, w in d.items()}


def test_sparse_and_hybrid_top_k(spark, monkeypatch):
    """Kernels against all pairs in numpy: repeated tokens, negative weights, rows without words, ties, many small blocks."""
    rng = np.random.default_rng(14)
    n, q, width = 120, 30, 5

    def some(m, low):
        out = []
        for _ in range(m):
            t = rng.integers(0, 25, rng.integers(low, 9)).tolist()
            out.append((t, rng.choice([-1.0, 0.5, 1.0, 2.0], len(t)).tolist()) if t else None)
        return out

    def dense(rows):
        out = np.zeros((len(rows), 25))
        for k, r in enumerate(rows):
            for t, w in zip(*(r or ((), ()))):
                out[k, t] += w
        return out

    def present(rows):
        """Tokens that a row has, even with weights that cancel out."""
        out = np.zeros((len(rows), 25), int)
        for k, r in enumerate(rows):
            out[k, (r or ((), ()))[0]] = 1
        return out

    docs, asked = some(n, 0), some(q, 0)
    x, y = rng.normal(size=(n, width)).astype(np.float32), rng.normal(size=(q, width)).astype(np.float32)
    kind = "long, vector array<float>, sparse struct<indices:array<bigint>,values:array<float>>"
    rows = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(x, docs))], f"id {kind}").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(y, asked))], f"query_id {kind}")
    product, met = dense(asked) @ dense(docs).T, (dense(asked) != 0).astype(int) @ present(docs).T > 0
    unit = lambda m: m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    both = 0.7 * unit(y) @ unit(x).T + 0.3 * np.maximum(product, 0)

    def best(score, ok):
        return {(a, r + 1): i for a in range(q) for r, i in enumerate(sorted(np.flatnonzero(ok[a]).tolist(), key=lambda i: (-round(score[a, i], 9), i))[:7])}

    for block, share in ((1 << 25, 64), (600, 64), (600, 0)):
        monkeypatch.setattr(sparse, "BLOCK_BYTES", block)
        monkeypatch.setattr(sparse, "DENSE", share)
        got = {(r["query_id"], r["rank"]): r["id"] for r in sparse.batch_top_k(rows, queries, 7).collect()}
        assert got == best(product, met)
        assert {(r["query_id"], r["rank"]): r["id"] for r in sparse.hybrid_batch_top_k(rows, queries, 7).collect()} == best(both, np.ones_like(met))
    assert sparse.batch_top_k(rows, queries.limit(0), 3).count() == 0 and sparse.hybrid_batch_top_k(rows.limit(0), queries, 3).count() == 0 and sparse.batch_top_k(rows, queries, 0).count() == 0


def test_sparse_scores_match_full_scan(spark):
    rng = np.random.default_rng(3)
    docs = [(i, dict(zip(sorted(rng.choice(50, rng.integers(1, 12), replace=False).tolist()), rng.uniform(-1, 1, 12).astype(np.float32).tolist()))) for i in range(60)]
    df = spark.createDataFrame([(i, (list(d), list(d.values()))) for i, d in docs], "id long, sparse struct<indices:array<bigint>,values:array<float>>")
    q = docs[0][1]
    qd = spark.createDataFrame([("q", t, w) for t, w in q.items()], "query_id string, token long, weight float")
    got = {r["id"]: r["sparse"] for r in sparse.scores(sparse.postings(df), qd).collect()}
    assert got == pytest.approx({i: sum(w * d[t] for t, w in q.items() if t in d) for i, d in docs if set(d) & set(q)})


def test_sparse_top_k_reads_the_records_once(spark, monkeypatch):
    """Many queries of many tokens are one block and one pass over the records, and pruning by lengths leaves no tie and no small score out."""
    rng = np.random.default_rng(16)
    some = [(rng.integers(0, 3000, n).tolist(), [1.0] * int(n)) for n in rng.choice([1, 3, 30, 900], 400, p=[0.3, 0.3, 0.3, 0.1])]
    some += [some[i] for i in range(0, 400, 4)]  # copies
    rows = spark.createDataFrame(list(enumerate(some)), f"id long, sparse {sparse.SPARSE}").repartition(2)
    queries = rows.withColumnRenamed("id", "query_id")
    dense = np.zeros((len(some), 3000))
    for i, (t, w) in enumerate(some):
        np.add.at(dense[i], t, w)
    product = dense @ dense.T
    wanted = {(q, r + 1): (i, product[q, i]) for q in range(len(some)) for r, i in enumerate(sorted(np.flatnonzero(product[q]).tolist(), key=lambda i: (-product[q, i], i))[:7])}
    monkeypatch.setattr(sparse, "BLOCK_BYTES", 2 << 20)
    for size in (128, 5):
        monkeypatch.setattr(sparse, "SLICE", size)
        monkeypatch.setattr(sparse, "CELLS", 4_000_000 if size == 128 else 2000)
        found = sparse.batch_top_k(rows, queries, 7)
        assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()} == wanted
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_sparse_overlaps(spark, monkeypatch):
    """Numbers of records that share a token and sums of products against all pairs, in bitmaps and blocks of any size; no pair is a row of the plan."""
    rng = np.random.default_rng(15)
    some = [(rng.integers(0, 40, rng.integers(0, 9)).tolist(), i) for i in range(150)]
    some = [(t, rng.choice([-1.0, 0.5, 2.0], len(t)).tolist()) if t else None for t, _ in some]
    rows = spark.createDataFrame(list(enumerate(some)), f"id long, sparse {sparse.SPARSE}").repartition(3)
    queries = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    dense, has = np.zeros((150, 40)), np.zeros((150, 40), int)
    for i, r in enumerate(some):
        for t, w in zip(*(r or ((), ()))):
            dense[i, t], has[i, t] = dense[i, t] + w, 1
    met, total = (dense != 0).astype(int) @ has.T > 0, dense @ dense.T
    wanted = {q: (int(met[q].sum()), pytest.approx(float(total[q].sum()))) for q in range(0, 150, 5) if met[q].any()}
    for block, marked, cells in ((1 << 25, 8192, 1 << 22), (600, 7, 64)):
        monkeypatch.setattr(sparse, "BLOCK_BYTES", block)
        monkeypatch.setattr(sparse, "MARKED", marked)
        monkeypatch.setattr(sparse, "CELLS", cells)
        found = sparse.overlaps(rows, queries)
        assert {r["query_id"]: (r["n"], r["total"]) for r in found.collect()} == wanted
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sparse.overlaps(rows, queries.limit(0)).isEmpty() and sparse.overlaps(rows.limit(0), queries).isEmpty()


def test_allowlist(spark):
    """Ids by several fields at once, as by a loop over the records."""
    rng = np.random.default_rng(15)
    docs = [(i, str(rng.choice(["oak", "elm", "yew"])), int(rng.integers(0, 4)), None if i % 5 == 0 else str(rng.choice(["low", "high"]))) for i in range(60)]
    fields = ["tree", "height", "place"]
    p = metadata.meta_postings(spark.createDataFrame(docs, "id long, tree string, height int, place string"), fields)
    for where in ({}, {"tree": "elm"}, {"tree": "oak", "height": "2"}, {"tree": "yew", "height": "1", "place": "low"}, {"tree": "ash"}, {"place": "high", "tree": "ash"}):
        want = {d[0] for d in docs if all(str(d[1 + fields.index(f)]) == v for f, v in where.items())}
        assert {r["id"] for r in metadata.allowlist(p, where).collect()} == want


def test_arrow_plan_equals_expressions(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]  # a tie
    v[9] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(5)
    q = rows.where("id % 50 = 3 or id = 9").select(F.col("id").alias("query_id"), "vector")
    for metric in ("cosine", "euclidean"):
        a, b = ({(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in f(rows, q, 10, metric).collect()} for f in (search.batch_top_k, search.batch_top_k_native))
        assert a == b and len(a) == 70
    assert search.batch_top_k(rows, q.limit(0), 5).count() == 0 and search.batch_top_k(rows.limit(0), q, 5).count() == 0


def test_kept_norms(spark):
    """A column of norms saves their computation and changes no score."""
    from veclake.functions import vectors as V

    x = np.random.default_rng(8).normal(size=(50, 6)).astype(np.float32)
    x[4] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").withColumn("norm", V.norm(F.col("vector")))
    q = x[0].tolist()
    assert [tuple(r) for r in search.top_k(rows, q, 50, norm_col="norm").select("id", "score").collect()] == [tuple(r) for r in search.top_k(rows, q, 50).select("id", "score").collect()]


def test_many_stated_queries(spark):
    """More queries than one block holds: all are answered, each once."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1100, 4)).astype(np.float32))], "id long, vector array<float>").repartition(2)
    q = rows.select(F.col("id").alias("query_id"), "vector")
    few = rows.where("id < 20")
    a, b = ({(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in f(few, q, 3).collect()} for f in (search.batch_top_k, search.batch_top_k_native))
    assert a == b and len(b) == 3300
    assert search.batch_scores(few, q).count() == 22_000


def clustered(n, width=24, seed=0, centres=20):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, width))[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, width))).astype(np.float32)


def sound(g):
    """Layers nest, links lead to other nodes of their layer, none repeats or exceeds the limit."""
    for depth, (nodes, links) in enumerate(g.layers):
        assert (np.diff(nodes) > 0).all() and links.shape[1] == g.c.m * (2 if depth == 0 else 1)
        assert depth == 0 or np.isin(nodes, g.layers[depth - 1][0]).all()
        for node, near in zip(nodes.tolist(), links.tolist()):
            near = [x for x in near if x >= 0]
            assert node not in near and len(set(near)) == len(near) and np.isin(near, nodes).all()
    assert len(g.layers[0][0]) == len(g.x)


def hits(g, asked, k=10, ef=100, allowed=None):
    every = np.arange(len(g.x)) if allowed is None else np.flatnonzero(allowed)
    truth = g.nearest(g.query(asked), every, k)[1]
    found = ann.found_in(g, asked, k, ef, allowed)
    assert found.shape == truth.shape and (found >= 0).all()
    return np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), truth.tolist())]) / truth.shape[1]


def test_diverse_links_point_in_different_directions():
    """Of candidates in one direction the nearest is linked; those in another as well; all if they are fewer than asked for."""
    x = np.array([[0, 0], [2, 0], [2.5, 0.1], [3, 0], [0, -4], [-5, 0.2]], np.float32)
    g = ann.Graph(x, "euclidean", config.EngineConfig(metric="euclidean"))
    row = lambda *n: np.array([n])
    assert g.diverse(row(1, 2, 3, 4, 5), 3, x[:1]).tolist() == [[1, 4, 5]]
    assert g.diverse(row(1, 2, 3), 2, x[:1]).tolist() == [[1, -1]]
    assert g.diverse(row(1, 2, -1), 4, x[:1]).tolist() == [[1, 2, -1, -1]]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_graph_recall_add_and_remove(metric):
    x = clustered(3000)
    c = config.EngineConfig(metric=metric)
    g = ann.Graph(x, metric, c).build()
    again = ann.Graph(x, metric, c).build()
    assert all((a == b).all() for one, two in zip(g.layers, again.layers) for a, b in zip(one, two))
    sound(g)
    assert hits(g, x[::30]) >= 0.97
    for share in (0.95, 0.3, 0.01):
        assert hits(g, x[::60], allowed=np.random.default_rng(1).random(len(x)) < share) >= 0.97
    walked, ann.SCAN = ann.SCAN, 0  # walk to the matches, however few
    try:
        assert hits(g, x[::60], allowed=np.random.default_rng(1).random(len(x)) < 0.3) >= 0.97
    finally:
        ann.SCAN = walked
    gone = np.random.default_rng(2).random(len(x)) < 0.25
    g.remove(gone)
    sound(g)
    assert hits(g, x[::30]) >= 0.95
    g = ann.Graph(np.concatenate([x[~gone], x[gone]]), metric, c, g.layers).add(int((~gone).sum()))
    sound(g)
    assert hits(g, x[::30]) >= 0.97
    one = ann.Graph(x[:1], metric, c).build()
    assert one.search(x[:2], 3, 10)[1].tolist() == [[0, -1, -1]] * 2 and ann.Graph(x[:0], metric, c).build().search(x[:2], 3, 10)[1].shape == (2, 0)


def test_index_in_shards(spark, tmp_path):
    """Graphs around centroids: few of them give most of what all give; kept ones answer alike; filters of several keys; changes."""
    x = clustered(2400, 16, 2, 12)
    rows = spark.createDataFrame([(i, v.tolist(), json.dumps({"tag": "ab"[i % 2], "n": i % 3})) for i, v in enumerate(x)], "id long, vector array<float>, meta string").repartition(3)
    c = config.EngineConfig(index_type="hnsw", shard_size=400, probes=3)
    ann.build(rows, c, meta=F.col("meta")).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.count() >= 6 and index.where("size(ids) > 800").isEmpty() and index.select(F.explode("ids")).distinct().count() == 2400
    q = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    share = lambda found, truth: search.recall(found, truth, 10).agg(F.avg("recall")).first()[0]
    truth = search.batch_top_k(rows, q, 10)
    assert share(ann.search(index, q, 10, c), truth) >= 0.97
    both = rows.where("get_json_object(meta, '$.tag') = 'a' and get_json_object(meta, '$.n') = '1'")
    every = replace(c, probes=0)
    found = ann.search(index, q, 10, every, where={"tag": "a", "n": 1.0})
    assert found.where("id % 2 <> 0 or id % 3 <> 1").isEmpty() and found.count() == 600 and share(found, search.batch_top_k(both, q, 10)) >= 0.97
    assert ann.search(index, q, 10, c, where={"tag": 1}).isEmpty() and ann.search(index, q.limit(0), 10, c).isEmpty()
    moved = spark.createDataFrame([(5, x[9].tolist(), None), (9001, x[11].tolist(), None)], "id long, vector array<float>, meta string")
    later = ann.update(index, c, moved, spark.createDataFrame([(k,) for k in range(100, 700)], "id long"), meta=F.col("meta"))
    left = rows.where("(id < 100 or id >= 700) and id <> 5").select("id", "vector").union(moved.select("id", "vector"))
    assert share(ann.search(later, q, 10, every), search.batch_top_k(left, q, 10)) >= 0.97
    assert ann.layer_stats(later, c).where("n_dangling > 0").isEmpty() and ann.edges(later, c).where("layer = 0").count() == 1801
    assert tuple(ann.size(later).first())[:2] == (1801, 16)
    assert {r["id"]: r["vector"] for r in ann.lookup(later, [5, 9001, 300, -1]).collect()} == {5: x[9].tolist(), 9001: x[11].tolist()}
    empty = ann.update(index, c, removed=rows.select("id"))
    assert empty.isEmpty() and ann.search(empty, q, 5, c).isEmpty()
    assert tuple(ann.size(ann.update(empty, c, moved)).first()) == (2, 16, 1)


@pytest.fixture(scope="module")
def scattered(spark):
    """Vectors without clusters, whose neighbours lie in any graph."""
    x = np.random.default_rng(21).normal(size=(3000, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), json.dumps({"tag": i % 10})) for i, v in enumerate(x)], "id long, vector array<float>, meta string").repartition(3).persist()
    return rows, rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")


def mean_recall(found, truth):
    return search.recall(found, truth, 10).agg(F.avg("recall")).first()[0]


def test_routes_and_walks_are_widened(spark, scattered):
    """Three of many graphs hold few of the neighbours, and a walk of width 10 finds few of a graph's: a batch measures both."""
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=300, ef_search=10)
    index = ann.build(rows, c).persist()
    assert index.count() >= 10
    assert mean_recall(ann.search(index, q, 10, c), search.batch_top_k(rows, q, 10)) >= 0.97


def test_filtered_search_sees_all_graphs(spark, scattered):
    """Matches lie in any graph, also for a single query: min(k, matches) of them, the nearest ones."""
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=300)
    index = ann.build(rows, c, meta=F.col("meta")).persist()
    truth = search.batch_top_k(rows.where("id % 10 = 3"), q, 10)
    for some in (q, q.where("query_id = 500")):
        wanted = {(r["query_id"], r["id"]) for r in truth.join(some.select("query_id"), "query_id", "left_semi").collect()}
        assert {(r["query_id"], r["id"]) for r in ann.search(index, some, 10, c, where={"tag": 3}).collect()} == wanted


def test_changed_index_keeps_its_recall(spark, scattered):
    """Records added to and removed from several graphs, against exact search of what is left."""
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=300)
    index = ann.update(ann.build(rows.where("id % 5 <> 1"), c), c, rows.where("id % 5 = 1").select("id", "vector"), rows.where("id % 7 = 2").select("id")).persist()
    left = rows.where("id % 7 <> 2 or id % 5 = 1")
    assert mean_recall(ann.search(index, q, 10, c), search.batch_top_k(left, q, 10)) >= 0.97


def test_int8_routes_are_widened(spark, scattered):
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=300, quantization="scalar")
    stored = ann.encoded_records(rows, c)
    assert mean_recall(ann.search(ann.build(stored, c).persist(), q, 10, c), search.batch_top_k(stored, q, 10, quantization="scalar")) >= 0.97


def test_euclidean_routes_are_widened(spark, scattered):
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=300, metric="euclidean")
    assert mean_recall(ann.search(ann.build(rows, c).persist(), q, 10, c), search.batch_top_k(rows, q, 10, "euclidean")) >= 0.97


def test_routes_over_many_small_graphs(spark, scattered):
    """Three of some hundred graphs are a start only, and those visited find what all of them do."""
    rows, q = scattered
    c = config.EngineConfig(index_type="hnsw", shard_size=30)
    index = ann.build(rows, c).persist()
    assert index.count() >= 100
    assert mean_recall(ann.search(index, q, 10, c), ann.search(index, q, 10, replace(c, probes=0))) >= 0.97


@pytest.fixture(scope="module")
def copied(spark):
    """50 vectors, 60 copies of each: more than k are equally near, of which those with the smallest ids count."""
    x = np.random.default_rng(22).normal(size=(50, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, x[i % 50].tolist()) for i in range(3000)], "id long, vector array<float>").repartition(3).persist()
    return rows, rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")


def test_changed_index_of_copies(spark, copied):
    rows, q = copied
    c = config.EngineConfig(index_type="hnsw", ef_search=20)
    index = ann.update(ann.build(rows.where("id % 5 <> 1"), c), c, rows.where("id % 5 = 1"), rows.where("id % 7 = 2").select("id")).persist()
    left = rows.where("id % 7 <> 2 or id % 5 = 1")
    assert mean_recall(ann.search(index, q, 10, c), search.batch_top_k(left, q, 10)) >= 0.97


def test_int8_copies(spark, copied):
    rows, q = copied
    c = config.EngineConfig(index_type="hnsw", ef_search=20, quantization="scalar")
    stored = ann.encoded_records(rows, c)
    assert mean_recall(ann.search(ann.build(stored, c).persist(), q, 10, c), search.batch_top_k(stored, q, 10, quantization="scalar")) >= 0.97


def test_euclidean_copies(spark, copied):
    rows, q = copied
    c = config.EngineConfig(index_type="hnsw", ef_search=20, metric="euclidean")
    assert mean_recall(ann.search(ann.build(rows, c).persist(), q, 10, c), search.batch_top_k(rows, q, 10, "euclidean")) >= 0.97


def test_copies_over_many_small_graphs(spark, copied):
    """Copies dealt to several graphs score alike in all of them."""
    rows, q = copied
    c = config.EngineConfig(index_type="hnsw", shard_size=300, ef_search=20)
    index = ann.build(rows, c).persist()
    assert mean_recall(ann.search(index, q, 10, replace(c, probes=0)), search.batch_top_k(rows, q, 10)) >= 0.97


@pytest.fixture(scope="module")
def nearly_copied(spark):
    """50 vectors, 60 of each that differ by less than single precision tells apart."""
    rng = np.random.default_rng(23)
    x = np.tile(rng.normal(size=(50, 24)), (60, 1)) + rng.normal(size=(3000, 24)) * 1e-4
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "id long, vector array<float>").repartition(3).persist()
    return rows, rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")


def test_euclidean_near_copies(spark, nearly_copied):
    """What single precision does not tell apart is ranked in double."""
    rows, q = nearly_copied
    c = config.EngineConfig(index_type="hnsw", ef_search=100, metric="euclidean")
    assert mean_recall(ann.search(ann.build(rows, c).persist(), q, 10, c), search.batch_top_k(rows, q, 10, "euclidean")) >= 0.99


def test_near_copies_over_many_small_graphs(spark, nearly_copied):
    rows, q = nearly_copied
    c = config.EngineConfig(index_type="hnsw", shard_size=160, probes=0)
    assert mean_recall(ann.search(ann.build(rows, c).persist(), q, 10, c), search.batch_top_k(rows, q, 10)) >= 0.99


def test_exact_search_ranks_copies_by_id(spark):
    """Equal vectors score alike wherever they lie in a batch, so the smallest ids are returned, as in the SQL."""
    rng = np.random.default_rng(24)
    x = rng.normal(size=(1003, 64)).astype(np.float32)
    x[500:] = x[500]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<float>").coalesce(1)
    q = rows.where("id >= 500 and id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    for metric in ("cosine", "euclidean"):
        found = search.batch_top_k(rows, q, 10, metric).collect()
        assert {(r["rank"], r["id"]) for r in found} == {(k + 1, 500 + k) for k in range(10)}


def test_int8_search_returns_each_id_once(spark):
    x = np.random.default_rng(22).normal(size=(3000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<float>").persist()
    c = config.EngineConfig(index_type="hnsw", quantization="scalar")
    q = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), "vector")
    found = ann.search(ann.build(ann.encoded_records(rows, c), c), q, 10, c)
    assert found.select("query_id", "id").distinct().count() == found.count() == 6000


def test_plan_and_strategy_agree(spark):
    from veclake.plans.strategy import plan, strategy

    shares = [0.0, 0.004, 0.1, 0.31, 0.5, 0.51, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", strategy(F.col("s"), 100, 10).alias("x")).collect()
    assert {r["s"]: tuple(r["x"]) for r in rows} == {s: plan(s, 100, 10) for s in shares}


def test_change_log(spark):
    log = spark.createDataFrame([(0, "INSERT", "v1", 1), (1, "INSERT", "v2", 2), (2, "INSERT", "v1", 7), (3, "DELETE", "v2", None), (4, "DELETE", "no", None)], "seq long, action string, id string, x int")
    assert [tuple(r) for r in changes.fold(log).select("id", "x").collect()] == [("v1", 7)]
    saved = changes.fold(log.where("seq < 2"))
    again = changes.recover(saved, log)  # entries that the snapshot has already
    assert [tuple(r) for r in again.select("id", "x").collect()] == [("v1", 7)]
    with pytest.raises(Exception, match="unknown action"):
        changes.fold(log.withColumn("action", F.lit("PATCH"))).collect()


def test_bodies(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id":"a","vector":[1,2],"sparse_vector":{"indices":[3],"values":[0.5]},"metadata":{"k":1}}\n')
    (tmp_path / "many.json").write_text('{"vectors":[{"id":"a","vector":[1,2]},{"id":"b","vector":[3,4]}]}\n')
    assert bodies.inserts(spark, f"{tmp_path}/one.json").first()["sparse"]["indices"] == [3]
    assert bodies.batches(spark, f"{tmp_path}/many.json").count() == 2
    (tmp_path / "none.json").write_text('{"vectors":[]}\n')
    with pytest.raises(Exception, match="must not be empty"):
        bodies.batches(spark, f"{tmp_path}/none.json").collect()
    assert '"meta"' not in bodies.results_json(spark.createDataFrame([("a", 1.0, None)], "id string, score double, meta string")).first()["value"]


def test_vecs_source(spark, tmp_path):
    from veclake.session import on_workers

    on_workers(spark).dataSource.register(fvecs.VecsSource)
    data = np.arange(12, dtype=np.float32).reshape(4, 3)
    raw = np.empty((4, 4), "<i4")
    raw[:, 0], raw[:, 1:] = 3, data.view("<i4")
    raw.tofile(tmp_path / "x.fvecs")
    rows = spark.read.format("vecs").option("rows", 3).load(f"{tmp_path}/x.fvecs").orderBy("row").collect()
    assert [r["vector"] for r in rows] == data.tolist() and [r["row"] for r in rows] == [0, 1, 2, 3]


def test_streaming_ingest(spark, tmp_path):
    from veclake.operators.validate import error_column
    from veclake.sources.store import Store
    from veclake.streaming.ingest import ingest

    store = Store(spark, f"file://{tmp_path}/s")
    schema = store.log_schema
    for part in ([(0, "INSERT", "a", [1.0, 2.0], None, None), (1, "INSERT", "b", [1.0], None, None)], [(2, "INSERT", "c", [3.0, 4.0], None, None), (3, "DELETE", "a", None, None, None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
    failures = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(stream, store, f"{tmp_path}/ck", lambda df, n: failures.extend(df.collect()), error_column(2)).awaitTermination()
    assert [r["id"] for r in store.recover().collect()] == ["c"] and [r["id"] for r in failures] == ["b"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("engine:\n  metric: euclidean # comment\n  m: 8\n  seed: odd\n")
    with pytest.warns(UserWarning, match="seed='odd'|EF_SEARCH='many'"):
        c = config.load(f"{tmp_path}/c.yaml", {"VECLAKE_M": "12", "VECLAKE_EF_SEARCH": "many"})
    assert (c.metric, c.m, c.ef_search) == ("euclidean", 12, 100)
    for bad in ({"index_type": "x"}, {"metric": "dot"}, {"quantization": "pq"}, {"ef_construction": 8}, {"auto_save_seconds": 0}, {"dimensions": -1}):
        with pytest.raises(ValueError):
            config.EngineConfig(**bad).checked()


def test_query_catalogue():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "knn_cosine_top10" in e.queries()

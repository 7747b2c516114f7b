"""The facade against plain Python over a generated shop: search, filters, hybrid, validation, log, snapshot and graph."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclake.collection import ROW, Collection
from veclake.config import EngineConfig
from veclake.functions.filters import matches
from veclake.operators.validate import InvalidVectorError
from veclake.sources.store import StoreError

WIDTH, N = 6, 90


def shop(seed=21):
    """(id, vector, sparse, meta) of goods: some without words, without a price or without metadata, one all zeros."""
    rng, out = np.random.default_rng(seed), []
    for i in range(N):
        words = sorted(rng.choice(40, rng.integers(0, 6), replace=False).tolist())
        meta = {"shelf": ["tea", "ink", "rope"][i % 3], "row": int(rng.integers(1, 5)), "open": bool(i % 2)}
        if i % 4 == 0:
            meta["price"] = float(rng.integers(1, 9)) / 2
        vector = np.zeros(WIDTH) if i == 17 else rng.normal(size=WIDTH)
        out.append((f"g{i:02d}", vector.astype(np.float32).tolist(), (words, rng.uniform(-1, 2, len(words)).astype(np.float32).tolist()) if words else None, None if i == 5 else meta))
    return out


GOODS = shop()
ASKED = np.random.default_rng(3).normal(size=WIDTH).tolist()


def frame(spark, goods, place=0):
    rows = [(place + k, i, v, s, None if m is None else json.dumps(m)) for k, (i, v, s, m) in enumerate(goods)]
    return spark.createDataFrame(rows, ROW).withColumn("meta", F.parse_json("meta"))


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def expected(goods, k, where=None, words=None):
    scored = []
    for i, v, s, m in goods:
        if matches(m, where):
            score = cosine(np.float32(ASKED), v)
            if words:
                own = dict(zip(*s)) if s else {}
                score = 0.7 * score + 0.3 * max(sum(w * own.get(t, 0) for t, w in words.items()), 0)
            scored.append((-score, i))
    return [i for _, i in sorted(scored)[:k]]


def ids(found):
    return [r["id"] for r in found.collect()]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    c = Collection(spark, f"file://{tmp_path_factory.mktemp('shop')}/c")
    out = c.batch_insert(frame(spark, GOODS))
    assert out["inserted_count"] == N and out["failures"].count() == 0
    return c


WHERES = [None, {}, {"shelf": "ink"}, {"shelf": "rope", "row": 3}, {"row": 2.0}, {"open": False}, {"price": 2}, {"price": 2.5, "open": False}, {"shelf": "wool"}, {"row": "2"}, {"colour": None}]


@pytest.mark.parametrize("where", WHERES)
def test_search_is_that_of_plain_python(filled, where):
    for k in (2, 7, 500):
        assert ids(filled.search(ASKED, k, where)) == expected(GOODS, k, where)


def test_hybrid_is_that_of_plain_python(filled):
    for where in (None, {"shelf": "tea"}):
        for words in ({3: 1.5, 9: 0.5, 30: 2.0}, {1: -1.0}, {99: 4.0}):
            query = (list(words), list(words.values()))
            assert ids(filled.search(ASKED, 12, where, query)) == expected(GOODS, 12, where, words)
    off = filled.with_config(hybrid=False)
    assert ids(off.search(ASKED, 12, None, ([3, 9], [1.5, 0.5]))) == expected(GOODS, 12)


def test_edges(filled):
    assert ids(filled.search(ASKED, 0)) == [] and ids(filled.search(ASKED, -3)) == []
    own = GOODS[30]
    first = filled.search(own[1], 1).first()
    assert first["id"] == own[0] and first["score"] == pytest.approx(1)
    assert {r["score"] for r in filled.search([0.0] * WIDTH, 4).collect()} == {0.0}
    for bad in ([0.5] * (WIDTH - 1), [], [float("nan")] + [0.0] * (WIDTH - 1), [float("inf")] * WIDTH):
        with pytest.raises(InvalidVectorError):
            filled.search(bad, 3)
    with pytest.raises(ValueError):
        filled.search(ASKED, 3, {"row": [1, {"x": float("inf")}]})
    with pytest.raises(InvalidVectorError):
        filled.search(ASKED, 3, None, ([4, 4], [1.0, 1.0]))
    assert filled.info() == {"metric": "cosine", "quantization": "none", "index_type": "brute", "dimensions": WIDTH, "count": N}


def test_validation_leaves_no_trace(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame(
        [(0, "ok", [1.0, 2.0], None, None), (1, "wide", [1.0, 2.0, 3.0], None, None), (2, "late", [0.5, 2.0], None, None), (3, "words", [1.0, 1.0], ([8, 2], [1.0, 1.0]), None), (4, "uneven", [1.0, 1.0], ([2, 8], [1.0]), None), (5, "", [1.0, 1.0], None, None), (6, "inf", [1.0, float("inf")], None, None)], ROW
    )
    out = c.batch_insert(rows.withColumn("meta", F.parse_json("meta")))
    assert out["inserted_count"] == 2 and c.count() == 2 and c.get("wide") is None
    assert {r["id"]: r["error"] for r in out["failures"].collect()} == {
        "wide": "vector has 3 dimensions", "words": "sparse indices must ascend strictly", "uneven": "sparse indices and values differ in length", "": "id is required", "inf": "vector[1] is not finite",
    }
    with pytest.raises(InvalidVectorError, match=r"vector\[0\] is not finite"):
        c.insert("n", [float("nan"), 0.0])
    scalar = Collection(spark, f"file://{tmp_path}/q", EngineConfig(quantization="scalar", metric="euclidean"))
    with pytest.raises(InvalidVectorError, match="dimension 1"):
        scalar.insert("p", [0.5, -1.5, 0.0])
    assert scalar.width == 0


def test_chunks_and_last_write(spark, tmp_path):
    """Chunks of batch_size, of which each tells its failures; the last of several writes of an id stays."""
    c = Collection(spark, f"file://{tmp_path}/m", EngineConfig(batch_size=4))
    items = [(f"i{k % 7}", [float(k), 1.0] if k != 6 else [1.0], None, {"k": k}) for k in range(10)]
    out = c.insert_many(items)
    assert out["inserted_count"] == 9 and [r["id"] for r in out["failures"].collect()] == ["i6"]
    assert c.count() == 6 and c.get("i2")["vector"] == [9.0, 1.0] and len(c.store._names("log")) == 3


def test_log_and_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    c = Collection(spark, path)
    c.insert("one", [0.0, 2.0], meta={"n": {"x": [1, 2]}})
    c.insert("two", [4.0, 5.0])
    c.insert("one", [3.0, 1.0], meta={"n": {"x": [7]}})
    assert c.delete("two") and not c.delete("two") and not c.delete("never")
    again = Collection(spark, path)
    assert again.count() == 1 and again.get("one")["vector"] == [3.0, 1.0] and again.width == 2
    again.flush()
    assert again.store._names("log") == []
    again.insert("three", [1.0, 1.0])
    third = Collection(spark, path)
    assert third.count() == 2 and ids(third.search([3.0, 1.0], 1, {"n": {"x": [7]}})) == ["one"]
    for wrong in ({"metric": "euclidean"}, {"quantization": "scalar"}, {"index_type": "hnsw"}, {"dimensions": 9}):
        with pytest.raises(StoreError):
            Collection(spark, path, EngineConfig(**wrong))
    third.reset()
    assert third.count() == 0 and Collection(spark, path).width == 0


def test_publishing_survives_a_stop_anywhere(spark, tmp_path, monkeypatch):
    """A version or batch that was not finished does not count, and what counted before still does."""
    path = f"file://{tmp_path}/p"
    c = Collection(spark, path)
    c.insert_many(GOODS[:20])
    c.flush()
    c.insert_many(GOODS[20:30])
    monkeypatch.setattr(c.store, "_rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    for change in (c.flush, lambda: c.insert("x", [1.0] * WIDTH)):
        with pytest.raises(KeyboardInterrupt):
            change()
    after = Collection(spark, path)
    assert after.count() == 30 and after.get("x") is None and after.seq == 29
    after.flush()
    assert Collection(spark, path).count() == 30 and len(after.store._names("versions")) == 2  # the unfinished one is never read


def test_damaged_files_are_errors(spark, tmp_path):
    path = tmp_path / "d"
    c = Collection(spark, f"file://{path}")
    c.insert_many(GOODS[:10])
    (part,) = (path / "log" / c.store._names("log")[0]).glob("part-*.parquet") if len(list((path / "log").glob("b-*/part-*.parquet"))) == 1 else list((path / "log").glob("b-*/part-*.parquet"))[:1]
    part.write_bytes(part.read_bytes()[:-40])
    for hidden in path.glob("log/b-*/.*.crc"):
        hidden.unlink()
    with pytest.raises(Exception, match="(?i)corrupt|footer|not a parquet|magic|parquet"):
        Collection(spark, f"file://{path}").count()


def test_log_is_cut_at_a_sequence_number(spark, tmp_path):
    """What comes after the snapshot's number stays when the log before it goes."""
    c = Collection(spark, f"file://{tmp_path}/t")
    c.insert_many(GOODS[:5])
    live, seq = c.records(), c.seq
    c.insert_many(GOODS[5:8])
    c.store.save(live.where("id < 'g05'"), c._header(), seq)
    assert len(c.store._names("log")) == 1 and c.count() == 8 and c.store.last_seq() == 7


def test_auto_save(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/a", EngineConfig(auto_save_seconds=1))
    c.saved -= 5
    c.insert("x", [1.0, 2.0])
    assert c.store.header()["seq"] == 0 and c.store._names("log") == []
    named = Collection(spark, None, EngineConfig(storage_path=f"file://{tmp_path}/a"))
    assert named.count() == 1
    with pytest.raises(ValueError):
        Collection(spark)


def test_envelope(spark, tmp_path):
    """Answers and the caller's mistakes in one form; the call's jobs carry its id."""
    c = Collection(spark, f"file://{tmp_path}/e")
    assert c.call("insert", "a-1", id="x", vector=[1.0, 2.0], meta={"k": 1}) == {"success": True, "data": None, "error": None}
    done = c.call("insert_many", items=[("y", [2.0, 1.0], None, None), ("z", [1.0], None, None)])
    assert done["data"] == {"inserted_count": 1, "failures": [{"id": "z", "error": "vector has 1 dimensions"}]}
    assert [(r["id"], r["meta"]) for r in c.call("search", vector=[1.0, 2.0], k=2)["data"]] == [("x", '{"k":1}'), ("y", None)]
    for verb, arguments, error in (("search", {"vector": [1.0], "k": 2}, "vector has 1 dimensions, expected 2"), ("insert", {"id": "n", "vector": []}, "vector is empty"), ("records", {}, "unknown verb 'records'")):
        assert c.call(verb, **arguments) == {"success": False, "data": None, "error": error}
    assert spark.getTags() == set() and c.call("count")["data"] == 2


def test_scalar_storage(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/s", EngineConfig(quantization="scalar"))
    v = np.array([0.3, -1.1, 0.6])
    c.insert("a", v.tolist())
    unit = (v / np.linalg.norm(v)).astype(np.float32)
    assert c.get("a")["vector"] == pytest.approx(np.trunc(unit * 127) / 127)
    assert c.search(v.tolist(), 1).first()["score"] == pytest.approx(1)


@pytest.mark.parametrize("quantization", ["none", "scalar"])
def test_graph_collection(spark, tmp_path, quantization):
    """All searches of a graph collection, before and after changes, and from its snapshot."""
    path, config = f"file://{tmp_path}/w", EngineConfig(index_type="hnsw", quantization=quantization)
    c = Collection(spark, path, config)
    c.insert_many(GOODS[:60])
    scan = lambda x: Collection(spark, path, config).with_config(metadata_index=False)

    def same(x, goods):
        for where in (None, {"shelf": "ink", "row": 3}):
            found = ids(x.search(ASKED, 8, where))
            if quantization == "none":
                assert found == expected(goods, 8, where)
            elif where:
                assert found == ids(scan(x).search(ASKED, 8, where))
        words = {3: 1.5, 9: 0.5}
        if quantization == "none":
            assert ids(x.search(ASKED, 6, {"open": True}, (list(words), list(words.values())))) == expected(goods, 6, {"open": True}, words)
            queries = spark.createDataFrame([("q", ASKED)], "query_id string, vector array<float>")
            assert ids(x.search_batch(queries, 5, {"open": True}).orderBy("rank")) == expected(goods, 5, {"open": True})

    same(c, GOODS[:60])
    moved = [(GOODS[k][0], GOODS[k + 30][1], *GOODS[k][2:]) for k in range(3)]
    c.insert_many([*GOODS[60:], *moved])
    assert c.delete("g40") and c.delete("g71")
    now = [*moved, *(g for g in GOODS[3:] if g[0] not in ("g40", "g71"))]
    same(c, now)
    c.flush()
    c.delete("g50")
    c.insert("new", ASKED, meta={"shelf": "tea", "row": 1, "open": True})
    later = Collection(spark, path, config)
    assert later.store.graph() is not None
    same(later, [*(g for g in now if g[0] != "g50"), ("new", ASKED, None, {"shelf": "tea", "row": 1, "open": True})])
    later.reset()
    assert ids(later.search(ASKED, 3)) == []

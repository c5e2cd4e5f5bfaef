import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.llm import neighbours as nn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_all(rows, k=5):
    """Best of all by cosine in double precision, per query."""
    used = {}
    for vec_id, vector in rows:
        ok = vec_id is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if ok:
            used.setdefault(vec_id, np.array(vector, dtype=float))
    out = {}
    for query, q in used.items():
        if query % 50 == 0:
            scored = [
                (-(v * q).sum() / np.sqrt((v * v).sum()) / np.sqrt((q * q).sum()), other)
                for other, v in used.items()
                if other != query and len(v) == len(q)
            ]
            out[query] = sorted(scored)[:k]
    return out


def found(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = by_all([(r.vec_id, r.embedding) for r in rows.collect()])
    got = found(nn.neighbours(rows, F.col("vec_id") % 50 == 0))
    assert set(got) == set(want)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("least", [nn.LEAST_SHARD, 8])
def test_awkward_vectors(spark, monkeypatch, least):
    monkeypatch.setattr(nn, "LEAST_SHARD", least)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).astype("float32").tolist(), 0) for k in range(0, 400, 5)]
    rows += [(k, rows[3][1], 0) for k in (1001, 1003, 1050)] + [(1007, [2 * x for x in rows[3][1]], 0)]
    rows += [(2000, None, 0), (2050, [0.0] * 6, 0), (2100, [float("nan")] + [1.0] * 5, 0), (2150, [None] + [1.0] * 5, 0)]
    rows += [(2200, [float("inf")] * 6, 0), (2250, [], 0), (None, [1.0] * 6, 0), (3000, [1.0, 2.0], 1), (3001, [2.0, 1.0], 1)]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "score": F.lit(2), "shard": F.lit(3)})
    got = found(nn.neighbours(frame, F.col("vec_id") % 50 == 0))
    want = by_all([row[:2] for row in rows])
    assert set(got) == set(want)
    for query in want:
        assert [v for _, v in got[query]] == [v for _, v in want[query]], query
        assert np.allclose([s for s, _ in got[query]], [s for s, _ in want[query]], atol=1e-14)
    assert nn.neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_agreement_is_the_footrule():
    rng = np.random.default_rng(5)
    vectors, pivots = rng.normal(size=(50, 8)), nn.unit(rng.normal(size=(200, 8)))
    orders = nn.nearest_pivots(vectors, pivots)
    prefix = orders.shape[1]
    places = np.full((50, 200), prefix)
    np.put_along_axis(places, orders, np.arange(prefix)[None, :], axis=1)
    footrule = np.abs(places[7] - places).sum(axis=1)
    agreed = nn.Postings(vectors, pivots).agreement(orders[7])
    assert (footrule == prefix * (prefix + 1) - 2 * agreed).all()

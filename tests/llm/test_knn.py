import numpy as np
import pyspark.sql.functions as F

from lexiloom.llm import knn


def brute(rows, k):
    """Every usable row against every other; {query id: its rows' answers}."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, v) in enumerate(ok):
        if q % 10 == 0:
            out.setdefault(q, []).append(sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for m, (i, x) in enumerate(ok) if m != n)[:k])
    return out


def test_recall_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(16) + (i % 5) * 2]) for i in range(1, 900)]
    rows += [(i, rows[9][1]) for i in range(2000, 2400)]
    rows += [(5000, None), (5010, [0.0] * 16), (5020, [float("nan")] * 16), (5030, [None] + [1.0] * 15), (5040, [float("inf")] * 16), (None, [1.0] * 16), (5050, [1.0]), rows[4], rows[9]]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, query_id string")
    monkeypatch.setattr(knn, "BLOCK", 100)
    got, twice = {}, {}
    for r in knn.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
        twice.setdefault(r.query_id, []).append(r.rank)
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 5050], 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        ids = {i for _, i in found.values()}
        hits += len(ids & {i for _, i in want[q][0]})
    assert hits >= 0.95 * sum(len({i for _, i in w[0]}) for w in want.values())
    # Id 10 stands twice: both rows ask, and each finds the other.
    assert sorted(twice[10]) == sorted([*range(1, 11)] * 2) and [i for _, i in (got[10][k] for k in range(1, 11))] == [10, *range(2000, 2009)]


def test_rows_of_one_id_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0), (0, 2, 1, 2.0), (0, 3, 2, 4.0)]


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert knn.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_kth_distance_is_the_largest_of_exactly_k(monkeypatch):
    monkeypatch.setattr(knn, "BUCKET", 2)
    ids, distance, point = np.arange(4), np.array([[5.0], [1.0], [3.0], [9.0]]), np.array([[0.1], [0.2], [0.3], [9.0]])
    block = knn.Block(ids, distance, point)
    assert block.search(-1, np.zeros(1), np.zeros(1), 2, 6.0) == [(1.0, 1), (3.0, 2)]  # 5 and 1 come first, in that order


def test_bounded_search_finds_what_full_scan_finds(monkeypatch):
    monkeypatch.setattr(knn, "BUCKET", 4)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 3))
    block = knn.Block(np.arange(400), vectors, vectors)  # points are the vectors: the stopping test loses nothing
    for q in rng.normal(size=(100, 3)):
        scan = sorted((float(d), i) for i, d in enumerate(np.sqrt(((vectors - q) ** 2).sum(1))))[:10]
        assert [i for _, i in block.search(-1, q, q, 10, scan[-1][0] * 1.3)] == [i for _, i in scan]

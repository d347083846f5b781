import random

import pytest

from lexiloom.operators.asof import asof


def plain(rows, marks):
    out = []
    for k, t, x in rows:
        best = max(((mt, m) for mk, mt, m in marks if mk is not None and mt is not None and k is not None and t is not None and mk == k and mt <= t), default=None)
        out.append((k, t, x, None if best is None else best[1]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 7])
def test_against_every_pair(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(40)]), i) for i in range(500)] + [("z", 5, 900), ("only rows", 1, 901)] * 2
    marks = [(rng.choice(["b", "hot", "hot", "c", None]), rng.choice([None, *range(40)]), i) for i in range(80)] + [("z", 5, 1), ("z", 5, 3), ("z", 5, 2), ("z", 6, 4)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        left = spark.createDataFrame(rows, "k string, t int, mark_row int").repartition(3)
        right = spark.createDataFrame(marks, "k string, at int, m int").repartition(3)
        found = asof(left, right, "k", "t", "at")
        assert sorted(repr((r.k, r.t, r.mark_row, r.mark and r.mark.m)) for r in found.collect()) == plain(rows, marks)
        assert asof(left, right.limit(0), "k", "t", "at").where("mark IS NOT NULL").count() == 0
        assert asof(left.limit(0), right, "k", "t", "at").count() == 0
    finally:
        for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    from lexiloom.operators import asof as module

    tables = []
    monkeypatch.setattr(module, "written", lambda df, name, keep=module.written: tables.append(keep(df, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("'k' AS k", "id AS t")
        marks = spark.range(0, 20_000, 6_000).selectExpr("'k' AS k", "id AS t", "id AS m")
        found = asof(rows, marks, "k", "t")
        assert found.where("mark.m != t - t % 6000 OR mark IS NULL").count() == 0
        assert found.count() == 20_000 and tables[0].where("NOT _end").select("_part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

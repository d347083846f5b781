import json

import pytest

from lexiloom.functions import table_functions
from lexiloom.operators import chunking, rule_sets

RULES = [{"rule_id": "a", "text_pattern": ["甲方", {"kind": "regex", "pattern": "p.y"}]}, {"rule_id": "b", "section_match": "责任", "window_blocks": 1, "text_pattern": ["pay"]}]


@pytest.fixture()
def blocks(spark):
    table_functions.register(spark)
    rows = [(d, i, k, t) for d in range(4) for i, (k, t) in enumerate([("heading", "责任"), ("paragraph", "pay 甲方"), ("paragraph", "pay"), ("heading", "x"), ("table", None), ("paragraph", "pry pay" * d)])]
    df = spark.createDataFrame(rows, "doc_id long, block_index int, type string, text string").repartition(5)
    df.createOrReplaceTempView("blocks")
    return df


def test_chunks_beside_their_rows(spark, blocks):
    got = spark.sql("SELECT doc_id, block_index, c.* FROM blocks, LATERAL chunk_text(text, 5, 2) c").collect()
    want = [(r.doc_id, r.block_index, n, c) for r in blocks.collect() for n, c in enumerate(chunking.sentence_windows(r.text or "", 5, 2))]
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="overlap < most"):
        spark.sql("SELECT * FROM chunk_text('x', 3, 3)").collect()


def test_rules_in_sql_equal_the_data_frame_form(spark, blocks):
    got = spark.sql(f"SELECT * FROM rule_hits(TABLE(blocks), '{json.dumps(RULES)}')")
    want = rule_sets.rule_hits(blocks, rule_sets.RuleSet(RULES))
    assert got.columns == want.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) and want.count() > 0
    with pytest.raises(Exception, match="blocks without"):
        spark.sql(f"SELECT * FROM rule_hits(TABLE(SELECT 1 AS doc_id), '{json.dumps(RULES)}')").collect()

"""The pipeline against its operators' plain versions, stage by stage."""

import os

import numpy as np
import pytest
from test_bpe import expected
from test_corpus_operators import brute_components

import corpus_pipeline
from lexiloom.llm import decontam

FOLDER = "/root/testdata/sf0.001"


def plain_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" "):
                gone |= set(range(k, k + 3)) if w in seen else set()
                seen.add(w)
        kept = [x for k, x in enumerate(lines) if k not in gone]
        if kept:
            out[i] = "\n".join(kept)
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
        if name == "line dedup":
            assert after == plain_lines(before)
        elif name == "near duplicates":
            assert set(after) == {i for i, c in brute_components(list(before.items())).items() if i == c}
        elif name == "decontamination":
            items = [decontam.tokens(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            text = {i: b" ".join(decontam.tokens(t)) for i, t in before.items()}
            held = {i for i, t in text.items() if any(b" ".join(x) in t for x in items)}
            assert held and not held & set(after) and len(after) >= len(before) - len(held) - 2
        elif name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            judged = [i for i in before if i in labels]
            assert np.mean([(i in after) == (labels[i] == 0) for i in judged]) > 0.85
        elif name == "encoding":
            for r in docs.collect():
                ids, _ = expected(before[r.doc_id])
                assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, extra columns with clashing names; every stage keeps what it should."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    plain = "\n".join(f"zu{k} la{k} mo{k}" for k in range(9))
    rows = [(None, None), (None, item), (1, None), (2, ""), (2, "only one line"), (3, plain), (3, plain), (4, plain + " end"), (5, "b " * 40_000), (6, item), (6, "other text of six"), (7, "\n\n\n\n"), (8, f"{plain}\nmore")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone_id long, ids string, kept_text string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, "x", "k") for i, t in rows], schema)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert corpus_pipeline.written(stage(spark, docs.limit(0), FOLDER)).count() == 0
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        if k < 4:
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
            kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert len(kept["toxicity"]) == len(rows)
    lines = kept["line dedup"]
    assert (3, plain) in lines and (None, None) in lines and (2, "") in lines and (8, "more") in lines and (4, "zu8 la8 mo8 end") in lines
    near = kept["near duplicates"]
    assert near.count((3, plain)) == 2 and (1, None) in near and (2, "only one line") in near
    clean = kept["decontamination"]
    assert (6, "other text of six") in clean and not [1 for _, t in clean if t == item] and len(clean) >= len(near) - 2
    assert docs.count() == len(clean)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_tables_between_stages_are_emptied(spark):
    """What the last stage reads stays, nothing else."""
    from lexiloom.llm import common

    before = list(common.TABLES)
    out = corpus_pipeline.run(spark, FOLDER)
    left = common.TABLES[len(before) :]
    assert out.count() > 0 and len(left) == 1 and spark.read.parquet(left[0]).count() == out.count()

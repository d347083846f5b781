import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm.bpe import Codec, bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    e = LIBRARY.encode(text or "", add_special_tokens=False)
    return e.ids, LIBRARY.decode(e.ids, skip_special_tokens=False)


def texts():
    rng = random.Random(5)
    alphabets = ["abcdefghij", "aab", "é'st're!?-", "abc123 \n", "ß漢字кириллица", "!'s'll", "éäx", "<|endoftext|>", "\x1c\x85\xa0 ab"]
    out = ["", "  ", "It's a test.", "a<|endoftext|>b <|startoftext|>", "́x é", "İstanbul ΣΑΣ", "x" * 300]
    for k in range(120):
        a = alphabets[k % len(alphabets)]
        out.append("".join(rng.choice([a] if a[0] == "<" and rng.random() < 0.3 else list(a)) for _ in range(rng.choice([5, 90, 700]))))
    return out


def test_runs_and_tree_equal_the_library():
    codec = Codec(PATH)
    for t in texts():
        ids, decoded = expected(t)
        got = codec.texts([t])[0]
        assert np.frombuffer(got[0], "<u4").tolist() == ids and got[1] == decoded, t
        for leaf in (7, 40, 111):
            nodes = [codec.leaf(t[i : i + leaf]) for i in range(0, len(t), leaf)] or [codec.leaf("")]
            assert np.frombuffer(codec.together(nodes), "<u4").tolist() == ids, (leaf, t)


@pytest.mark.parametrize("leaf", [50, 32768])
def test_operator(spark, leaf):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (3, "It's a test.", "y"), (3, "It's a test.", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r._row.doc_id, r._row.text, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe(df, PATH, leaf_chars=leaf).collect()]
    want = [(i, t, *expected(t)) for i, t, _ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe(df.limit(0), PATH).count() == 0


def test_other_vocabularies_take_the_plain_way(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r._row.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe(spark.createDataFrame(rows, "doc_id long, text string"), path, leaf_chars=50).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))

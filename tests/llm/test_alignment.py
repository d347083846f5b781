"""Alignment against a plain reading of the rule, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexiloom.llm import alignment
from lexiloom.llm.alignment import align, aligned

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
CHARS = alignment._byte_of_char()


def grouped(text):
    """Groups (A ids, B ids) of one text, read off byte by byte; none where the bytes do not come back."""
    if not text:
        return []
    raw = (" " + text).encode()
    a_ids, b_ids = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sides = []
    for ids, of in ((a_ids, lambda i: bytes(CHARS[c] for c in A.id_to_token(i))), (b_ids, lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        parts = [of(i) for i in ids]
        if b"".join(parts) != raw:
            return []
        sides.append((ids, [sum(map(len, parts[: k + 1])) for k in range(len(parts))]))
    shared = sorted(set(sides[0][1]) & set(sides[1][1]))
    return [tuple([i for i, e in zip(ids, ends) if begin < e <= end] for ids, ends in sides) for begin, end in zip([0, *shared], shared)]


def expected(texts):
    groups = [grouped(t) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    for g, c in zip(groups, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""


def texts():
    rng = random.Random(2)
    alphabets = ["abcdefgh ij", "aab  ", "é'st're!?- ", "abc123 \n", "ß漢字кириллица ", " ", "<|endoftext|> <s>", "\x00▁ a", "ﬁ😀x 　", "\x1c\x85\xa0 ab"]
    out = [None, "", " ", "It's a test.", "<|endoftext|>", "a<s>b </s> <unk>", " x", "x ", "▁", "a ▁b c", "It's a test.", "漢字" * 400, " " * 3000, "\x80" * 50]
    for k in range(80):
        a = alphabets[k % len(alphabets)]
        out.append("".join(rng.choice(a) for _ in range(rng.choice([5, 60, 300]))))
    return out


@pytest.mark.parametrize("stretch", [1 << 20, 20])
def test_operator(spark, monkeypatch, stretch):
    """Whatever is cut and forgotten."""
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "It's a test.", 8), (3, "It's a test.", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    want = sorted(map(repr, ((r[0], *w) for r, w in zip(rows, expected([r[1] for r in rows])))))
    found = align(df, A_PATH, B_PATH, groups=True).collect()
    assert sorted(repr((r._row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in found) == want
    assert all(hashlib.sha256(r.groups).hexdigest() == r.groups_sha256 for r in found if r.n_a)
    assert align(df.limit(0), A_PATH, B_PATH).count() == 0


def test_large_groups_by_their_ids(monkeypatch):
    """Products beyond the bound give the same links as those below it."""
    rng = np.random.default_rng(1)
    a_ends, b_ends = np.cumsum(rng.integers(1, 5, 60)), np.cumsum(rng.integers(1, 7, 60))
    end = max(a_ends[-1], b_ends[-1])
    a_ends, b_ends = np.append(a_ends[a_ends < end], end), np.append(b_ends[b_ends < end] , end)
    a, b = rng.integers(0, 4, len(a_ends)), rng.integers(0, 3, len(b_ends))

    def links():
        groups, pairs, times, _, _ = aligned(a, b, a_ends, b_ends)
        total = Counter()
        for g, p, t in zip(groups.tolist(), pairs.tolist(), times.tolist()):
            total[g, p] += t
        return total

    want = links()
    for bound in (1, 3):
        monkeypatch.setattr(alignment, "PRODUCT", bound)
        assert links() == want


def test_forgotten_runs_change_nothing(monkeypatch):
    import pyarrow as pa

    some = [t or "" for t in texts()] * 2
    pair = alignment.Pair(A_PATH, B_PATH)
    want = [b.to_pylist() for k in range(0, len(some), 7) for b in alignment._batch(pair, pa.array(range(len(some[k : k + 7]))), some[k : k + 7], k, True)]
    monkeypatch.setattr(alignment, "RUNS", 30)
    small = alignment.Pair(A_PATH, B_PATH)
    assert [b.to_pylist() for k in range(0, len(some), 7) for b in alignment._batch(small, pa.array(range(len(some[k : k + 7]))), some[k : k + 7], k, True)] == want
    assert len(small.said) < len(pair.said)

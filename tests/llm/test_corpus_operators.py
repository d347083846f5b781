"""Odd rows and brute force for the operators that have no file of their own."""

import random
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import common, ctw, decontam, graph, line_dedup, near_dup, sharding, toxicity
from lexiloom.llm.shingles import shingle_set, words

DDL = "doc_id long, text string, n_lines string, score string, _key int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in rows], DDL)


ODD = [(None, None), (1, None), (2, ""), (3, "x " * 30_000), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (4, "other"), (None, "a\nb\nc"), (5, "a\nb\nc\nd\ne"), (6, "\n\n\n\n"), (7, "\n\n\n\n")]


def test_line_dedup(spark):
    got = line_dedup.line_dedup(table(spark, ODD))
    by = {}
    for r in got.collect():
        by.setdefault((r._row.doc_id, r._row.text), set()).add((r.kept_text, r.n_lines, r.n_removed))
    assert all(len(v) == 1 for v in by.values()) and got.count() == len(ODD)
    assert by[(None, None)] == {(None, 0, 0)} and by[(2, "")] == {("", 1, 0)}
    assert by[(None, "a\nb\nc")] == {("a\nb\nc", 3, 0)}  # a null id sorts first
    assert by[(4, "a\nb\nc\nd")] == {("d", 4, 3)}
    assert by[(5, "a\nb\nc\nd\ne")] == {("e", 5, 4)}
    assert by[(7, "\n\n\n\n")] == {("\n\n\n\n", 5, 0)}
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(3000)] + [(77, "same")] * 1500 + ODD
    got = sharding.byte_shards(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(24)) <= 2 * largest and set(sizes) <= set(range(24))
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    assert [r.shard for r in order] == sorted(r.shard for r in got)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.byte_shards(table(spark, [])).count() == 0


def test_copies_of_a_row_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 1000)
    got = sharding.byte_shards(spark.range(20_500).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")))
    slots = {}
    for r in got.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 20_500 and len(slots) == 24
    expand = [x for x in got._jdf.queryExecution().toString().split("== Physical Plan ==")[0].split("\n") if "RepartitionByExpression" in x and "run#" in x]
    assert expand


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(set(shingle_set(t).tolist()))
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 500)) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(260):
        w = list(base[i % 6 if i % 2 else 0])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += ODD + [(4, "a b c d"), (8, "A B\tc  d"), (4, "a b c d"), (9, "a b c e"), (4, None), (10, "other"), (11, ""), (11, "A b c e")]
    rows += [(2000, rows[0][1]), (2000, rows[1][1]), (2001, rows[1][1])]  # one doc_id joins two groups
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.id] if r.id is not None else None) and r.kept == (r.id is None or r.id == r.component_id)
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [4_000_000, 400])
def test_decontamination_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    count = 120 if shard > 400 else 14
    items = [(k, say(rng.randint(8, 30)) + ".", say(rng.randint(1, 10))) for k in range(count)]
    items += [(500, "", ""), (501, None, "x"), (None, "only me here now", "yes sure fine"), (7, say(12), say(4)), (None, say(9), say(3)), (502, say(200), say(150)), (503, say(64), say(1))]
    rows = []
    for i in range(150):
        _, q, a = rng.choice(items)
        q, a = q or "", a or ""
        if i % 3 == 0:
            t = f"{say(rng.randint(0, 300))} {q} {a} {say(rng.randint(0, 300))}"
        elif i % 3 == 1:
            t = f"{say(100)} {q} {say(50)}"
        else:
            t = say(200)
        rows.append((i, t))
    rows += ODD + [(900, "ONLY me, here now: yes sure fine")]
    bench = spark.createDataFrame(items + items[:2], "item_id long, question string, answer string")
    found = decontam.decontaminate(table(spark, rows), bench, keep=["doc_id"]).collect()
    got = {(r._row.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in found}
    assert len(got) == len(found)  # one row for a text and an item id
    tokens = [decontam.tokens(q) + (decontam.tokens(a) if a != q else []) for _, q, a in items]
    n = len(items)
    df = Counter(t for v in tokens for t in set(v))
    mean = np.mean([len(v) for v in tokens if v])
    want = {}
    for i, t in rows:
        words_ = decontam.tokens(t)
        for own, (k, q, a) in zip(tokens, items):
            length = len(decontam.tokens(q)) + len(decontam.tokens(a))
            size = 128
            while size < 2 * length:
                size *= 2
            impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, c in Counter(own).items()}
            for s in range(0, max(1, len(words_) - size // 2), size // 2):
                piece = words_[s : s + size]
                held = decontam.shingles(piece)
                score = sum(impact[w] for w in set(piece) & impact.keys()) / (sum(impact.values()) or 1)
                shares = [decontam.Index._share(decontam.shingles(decontam.tokens(x)), held, piece) for x in (q, a)]
                if score >= decontam.MIN_SCORE and min(shares) >= decontam.MIN_OVERLAP:
                    want[(i, k)] = tuple(map(max, want.get((i, k), (0, 0, 0)), (round(score, 9), *shares)))
    assert want and got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert {502, 503} <= {k for _, k in want}
    assert decontam.decontaminate(table(spark, rows), bench.limit(0)).count() == 0 and decontam.decontaminate(table(spark, []), bench).count() == 0


def naive_ctw(train, text, depth):
    """log10 probability of a coded text by the recursion itself, every context a node."""
    counts = {}
    for t in train:
        padded = b"\n" * depth + t
        for k in range(depth, len(padded)):
            for d in range(depth + 1):
                ctx = padded[k - d : k]
                for bit in range(8):
                    prefix = (1 << bit) | (padded[k] >> (8 - bit))
                    c = counts.setdefault((ctx, prefix), [0, 0])
                    c[(padded[k] >> (7 - bit)) & 1] += 1
    from functools import lru_cache
    from math import lgamma, pi

    def kt(c):
        return lgamma(c[0] + 0.5) + lgamma(c[1] + 0.5) - lgamma(sum(c) + 1) - np.log(pi)

    @lru_cache(None)
    def pw(ctx, prefix):
        c = counts.get((ctx, prefix), [0, 0])
        if len(ctx) == depth:
            return kt(c)
        below = sum(pw(bytes([x]) + ctx, prefix) for x in range(256) if (bytes([x]) + ctx, prefix) in counts)
        return np.logaddexp(kt(c), below) - np.log(2)

    def predict(ctx, prefix):
        """Probability of a one, from the deepest context up."""
        c = counts.get((ctx[-depth:] if depth else b"", prefix), [0, 0])
        p = (c[1] + 0.5) / (sum(c) + 1)
        for d in range(depth - 1, -1, -1):
            node = ctx[len(ctx) - d :] if d else b""
            c = counts.get((node, prefix), [0, 0])
            w = np.exp(kt(c) - np.log(2) - pw(node, prefix))
            p = w * (c[1] + 0.5) / (sum(c) + 1) + (1 - w) * p
        return p

    padded, total = b"\n" * depth + text, 0.0
    for k in range(depth, len(padded)):
        for bit in range(8):
            p = predict(padded[k - depth : k], (1 << bit) | (padded[k] >> (8 - bit)))
            total += log10(p if (padded[k] >> (7 - bit)) & 1 else 1 - p)
    return total


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(ctw, "WORD_SHARE", 0.02)  # so that most words take the joined way
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("the of and Cat dog x1 é ß".split() + [f"r{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + ODD
    df = table(spark, rows)
    train = [(i, t) for i, t in rows if i is not None and i % 4]
    model = ctw.train(df.where("doc_id % 4 <> 0"))
    got = ctw.score(df, model, keep=["doc_id", "text"]).collect()
    counts = Counter(w for _, t in train for w in words(t))
    counts[None] = len(train)
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        own = [*words(r._row.text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own))
        assert r.score < 0 and r.bits_per_byte > 0
    none = ctw.train(df.limit(0))
    assert all(r.base_score == pytest.approx(0) and r.n_known == 0 for r in ctw.score(df, none).collect())


def test_trained_scores_keep_every_context(spark, monkeypatch):
    """Scores through train() and score() are the recursion's on the whole tree, rare and unseen contexts included, for every way of dealing."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "b", "ca"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, "qu"), (101, "quartz vex"), (102, "ab quartz"), (103, None), (104, "zzzz new")]
    learned = [ctw.coded(words(t)) for i, t in rows if i <= 101]
    for size in (40, 6_000_000):
        monkeypatch.setattr(ctw, "SLICE_BYTES", size)
        model = ctw.train(table(spark, rows).where("doc_id <= 101"))
        assert model.grams.count() == len(ctw.gram_counts(learned)[0])
        got = {r._row.doc_id: r.score for r in ctw.score(table(spark, rows), model, keep=["doc_id"]).collect()}
        assert len(got) == len(rows)
        for i in (0, 7, 100, 101, 102, 103, 104):
            assert got[i] == pytest.approx(naive_ctw(learned, ctw.coded(words(dict(rows)[i])), ctw.DEPTH), rel=1e-5)


def test_values_are_found_for_every_gram():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 48, 3000)[rng.integers(0, 3000, 200_000)]
    distinct = ctw._distinct(code)
    assert (ctw._values(code, distinct, np.arange(len(distinct))) == np.searchsorted(distinct, code)).all()


def test_rare_contexts_stay_beside_a_large_text(spark):
    rows = [(1, "ab abc " * 20_000), (2, "quartz vex")]  # each context of the second is under 1 / 65,536 of all bytes
    got = {r._row.doc_id: r.score for r in ctw.score(table(spark, rows), ctw.train(table(spark, rows)), keep=["doc_id"]).collect()}
    assert got[2] == pytest.approx(naive_ctw([ctw.coded(words(t)) for _, t in rows], ctw.coded(words(rows[1][1])), ctw.DEPTH), rel=1e-4)


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice(["ra", "to", "mi", "len", "so", "pu"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    bad = ["grunkol", "blastev", "fropzi"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        if i % 5 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0), "x"))
    df = table(spark, rows + [(r[0], r[1]) for r in ODD])
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.train(df, known.where("doc_id % 3 <> 0"))
    got = toxicity.toxicity(df, model, keep=["doc_id", "text"]).collect()
    assert len(got) == 900 + len(ODD)
    fresh = [r for r in got if r._row.doc_id is not None and r._row.doc_id % 3 == 0 and r._row.doc_id > 10]
    assert np.mean([r.predicted == int(r._row.doc_id % 5 == 0) for r in fresh]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # Texts without blanks, at any place in them.
    joined = ["".join(rng.choice(plain) for _ in range(20_000)) for _ in range(2)]
    for at in (0, 5_000, 40_000, 80_000):
        spoiled = [t[:at] + "".join(rng.choice(bad) + rng.choice(plain) for _ in range(30)) + t[at:] for t in joined]
        scored = toxicity.toxicity(table(spark, list(enumerate(joined + spoiled))), model, keep=["doc_id"]).collect()
        assert [r.predicted for r in sorted(scored, key=lambda r: r._row.doc_id)] == [0, 0, 1, 1], at
    assert b"".join(w[: 224 if len(w) > 224 else None] for w in toxicity.windows("x" * 5_000))[:4_000].strip() == b"x" * 3_999
    none = toxicity.train(df, known.limit(0))
    assert {r.score for r in toxicity.toxicity(df, none).collect()} == {0.5}
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def test_dictionaries_are_trained_apart_and_on_the_whole_sample(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_trained", lambda samples, size, segment: seen.append(samples) or b" ".join(samples)[:size])
    ordinary = [" ".join(f"w{i}x{k}" for k in range(8 * 3_000)) for i in range(8)]
    toxic = [f"w{i}x1 w{i}x2 grunkol {'q' * i} w{i}x3 w{i}x4" for i in range(0, 16)]
    toxicity.fit(toxic, ordinary)
    assert len(seen[0]) == 4 * 3_000
    assert seen[1] and all(b"grunkol" in x for x in seen[1])


def test_savings_are_those_of_the_library():
    """Each window's saving is the difference of its two compressed lengths."""
    rng = random.Random(3)
    say = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    plain, bad = [f"mi{k}lo" for k in range(300)], ["grunkol", "blastev", "fropzi"]
    model = toxicity.fit([f"{say(plain, 20)} {rng.choice(bad)} {say(plain, 9)} {rng.choice(bad)} {say(plain, 9)}" for _ in range(60)], [say(plain, 60) for _ in range(60)])
    tools = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic)
    text = f"Grunkol {say(plain, 18)} fropzi"
    (saved,) = toxicity.savings([text], *tools)
    pieces = text.lower().split()
    assert len(saved) == 3
    for k, x in enumerate(saved):
        window = f" {' '.join(pieces[8 * k : 8 * k + 8])} ".encode()
        assert x == len(toxicity._compressor(model.ordinary)(window)) - len(toxicity._compressor(model.toxic)(window))
    assert saved[0] > 0 >= saved[1]


def test_sample_keeps_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_SAMPLE_BYTES", 2000)
    df = table(spark, [(1, f"{k} " * 50) for k in range(500)] + [(2, "x" * 90)] * 50 + [(k, "y" * 90) for k in range(3, 90)])
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(90)], "doc_id long, toxic int")
    found = toxicity.sample(df, labels)
    assert all(0 < sum(map(len, found[c])) <= 1000 for c in (0, 1)) and found[0].count("x" * 90) <= 1


def test_grams_of_a_slice_take_little_memory():
    """Nothing but the grams themselves is held at eight bytes a byte: two workers share an executor."""
    rng = np.random.default_rng(3)
    bodies = [rng.integers(97, 123, 50_000).astype(np.uint8).tobytes() + b"\n" for _ in range(40)]
    code = ctw.positions(bodies)[0]
    tracemalloc.start()
    try:
        ctw.positions(bodies)
        assert tracemalloc.get_traced_memory()[1] < 16 * len(code)
        tracemalloc.reset_peak()
        grams, n = ctw.gram_counts(bodies)
        assert tracemalloc.get_traced_memory()[1] < 40 * len(code)
    finally:
        tracemalloc.stop()
    want, times = np.unique(code, return_counts=True)
    assert (grams == want).all() and (n == times).all()


def test_telling_stretches_of_a_sample_take_little_memory():
    """Copies and telling grams are found without a Python object for every shingle or all ordinary grams at once."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    ordinary = [" ".join(word() for _ in range(400)) for _ in range(150)]
    toxic = [o + " vile zyxwvut slur " for o in ordinary[:20]]
    size = sum(map(len, ordinary))
    tracemalloc.start()
    try:
        kept = toxicity._apart(ordinary + ordinary[:30] + toxic)
        assert kept == ordinary and tracemalloc.get_traced_memory()[1] < 10 * size
        tracemalloc.reset_peak()
        assert all(b"zyxwvut" in x for x in toxicity.stretches(toxic, ordinary))
        assert tracemalloc.get_traced_memory()[1] < 10 * size
    finally:
        tracemalloc.stop()
    assert toxicity._apart([]) == [] and toxicity._apart(["", "", "a"]) == ["", "a"]


def test_further_links_join_components(spark):
    links = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    at = lambda df: {r.node: r.component for r in df.collect()}
    first = [(5, 6), (6, 7), (1, 2), (20, 21), (30, 31)]
    found = graph.components(links(*first))
    assert at(graph.components_with(found, links((7, 21), (40, 41), (40, 31), (2, 1)))) == {1: 1, 2: 1} | dict.fromkeys([5, 6, 7, 20, 21], 5) | dict.fromkeys([30, 31, 40, 41], 30)
    assert at(graph.components_with(graph.components(links()), links((3, 9)))) == {3: 3, 9: 3}


def test_rows_are_counted_as_they_are_written(spark):
    began = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    table, n = common.counted(spark.range(0, 1000, 1, 3))
    assert n == 1000 and spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - began == 1
    assert table.count() == 1000 and common.counted(spark.range(0))[1] == 0

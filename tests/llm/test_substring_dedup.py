import random

import numpy as np
import pytest

from lexiloom.llm import substring_dedup as S


def brute(rows):
    """(id, text) rows in any order: kept bytes of each."""
    out = []
    for i, t in rows:
        body = (t or "").encode()
        flags = [False] * len(body)
        if i is not None:
            smaller = set()
            for j, u in rows:
                if j is not None and j < i and u:
                    v = u.encode()
                    smaller.update(v[p : p + S.LENGTH] for p in range(len(v) - S.LENGTH + 1))
            for p in range(len(body) - S.LENGTH + 1):
                if body[p : p + S.LENGTH] in smaller:
                    flags[p : p + S.LENGTH] = [True] * S.LENGTH
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        out.append((i, len(body), sum(flags), spans, bytes(c for c, f in zip(body, flags) if not f)))
    return out


def corpus(rng, n=60):
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 160))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 6))]
        t = "".join(parts)
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + "X" + t[k + 1 :]
        rows.append((i, t))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 2, rows[3][1]), (n + 3, None), (n + 4, ""), (n + 5, "a" * 300), (n + 6, "a" * 500), (n + 7, "ab" * 100), (n + 8, "b" + "ab" * 90), (None, rows[2][1]), (5, rows[2][1]), (n + 9, "x" * 49)]
    return rows


@pytest.mark.parametrize("hot", [0, 2, 16])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HOT_CELLS", 1 << 12)
    monkeypatch.setattr(S, "RUN_ENTRIES", 300)
    monkeypatch.setattr(S, "PART_ENTRIES", 20)
    monkeypatch.setattr(S, "SPLITS", 16)
    monkeypatch.setattr(S, "DEAL_BYTES", 3000)
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    for seed in (range(2) if hot else range(2, 3)):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r._row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.substring_dedup(df, keep=["doc_id"]).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert S.substring_dedup(df.limit(0)).count() == 0


def test_merge_gives_every_suffix_in_order_with_common_prefixes():
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs, want = [], []
        for r in range(k):
            strings = [bytes(rng.choice(b"ab") for _ in range(S.LENGTH - 6)) + bytes(rng.choice(b"ab") for _ in range(6)) if rng.random() < 0.5 else b"a" * 44 + bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(40)]
            want += strings
            n = np.arange(40)
            rows = {"suffix": np.frombuffer(b"".join(strings), np.uint8).reshape(-1, S.LENGTH), "ids": r * 100 + n, "crcs": n, "places": n, "sizes": n, "befores": n, "before": np.zeros((40, S.REACH), np.uint8)}
            rows = S.in_order(rows)
            runs.append((S.Run(S.front_coded(rows)), rows))
        got = list(S.merged([run for run, _ in runs]))
        strings = [runs[r][1]["suffix"][i].tobytes() for r, i, _ in got]
        assert strings == sorted(want)
        for a, b, (_, _, shared) in zip(strings, strings[1:], got[1:]):
            assert shared == next((i for i in range(S.LENGTH) if a[i] != b[i]), S.LENGTH)


def test_copies_in_other_tasks_take_no_part_in_anchors(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(4)]
    rows = [(i, texts[i % 4] if i < 80 else texts[0][:120] + "zz" + texts[1][40:]) for i in range(90)]
    plain = S.packed_anchors

    def told(buckets):
        run = plain(buckets)

        def noted(batches):
            def passed():
                for b in batches:
                    for i in b.column("id").to_pylist():
                        (tmp_path / f"seen{i}").touch()
                    yield b

            yield from run(passed())

        return noted

    monkeypatch.setattr(S, "packed_anchors", told)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = [(r._row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.substring_dedup(df, keep=["doc_id"]).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"seen{i}" for i in [0, 1, 2, 3, 80])

"""License scans against plain searches: places of phrases, longest runs, and chains found by trying every pair."""

import random
import re

import pytest

from lexiloom.llm import licenses
from lexiloom.llm.licenses import PHRASES, TEMPLATES, Automaton, Scan, license_scan, scan, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def base(text):
    w = words(text)
    found = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, sorted({x for _, x in found})


def longest(text, templates):
    """At each word the longest run of words ending there that a template or phrase has."""
    sides = [words(t) for _, t in templates] + [p.split() for p in PHRASES]
    w, out = words(text), []
    for i in range(len(w)):
        run = 0
        while run <= i and any(w[i - run : i + 1] == s[k : k + run + 1] for s in sides for k in range(len(s))):
            run += 1
        out.append(run)
    return out


def runs(text, templates, least, automaton):
    """The matches that the scan hands to its chains: (last word, length)."""
    found = []

    class Seen(Scan):
        def _match(self, last, run, state):
            found.append((last, run, sorted(automaton.places[state])))

    one = Seen(automaton)
    one.feed(words_of(text))
    one.close()
    return found


def texts():
    rng = random.Random(4)
    out = [None, "", "MIT License", "mit-license, Apache\nLICENSE v2; GNU General Public License!", "The MİT license. mit licenses MIT\x7flicense", "apache license apache license " * 5, "general public general public license"]
    pool = [w for _, t in TEMPLATES for w in t.split()] + ["mit", "license", "zz", "é"]
    out += [" ".join(rng.choice(pool) for _ in range(rng.choice([5, 60]))) for _ in range(30)]
    for label, t in TEMPLATES:
        w = t.split()
        out.append("Noise here. " + t + " More noise.")
        out.append("\n * ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)))  # as comments
    return out


def test_base_and_longest_runs():
    rng = random.Random(9)
    small = [("x", "a b a b c a b"), ("y", "b c a a b a"), ("z", "c c c a")]
    one = Automaton(small, {"a b": "p", "c a": "q"}, min_match=2)
    for _ in range(200):
        text = " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 20])))
        w = text.split()
        sides = [t.split() for _, t in small]
        best = [max((k for k in range(i + 2) if any(w[i + 1 - k : i + 1] == s[j : j + k] for s in [*sides, ["a", "b"], ["c", "a"]] for j in range(len(s)))), default=0) for i in range(len(w))]
        want = [(i, best[i]) for i in range(len(w)) if best[i] >= 2 and (i + 1 == len(w) or best[i + 1] != best[i] + 1)]
        got = runs(text, small, 2, one)
        assert [(i, n) for i, n, _ in got] == want
        for i, n, places in got:  # a run may also be a phrase's alone
            assert places == sorted((t, j + n - 1) for t, s in enumerate(sides) for j in range(len(s)) if s[j : j + n] == w[i + 1 - n : i + 1])
    automaton = Automaton(TEMPLATES, PHRASES)
    for t in texts():
        got = scan(t or "", automaton)
        assert got[:5] == base(t), t


def test_labels_and_spans():
    automaton = Automaton(TEMPLATES, PHRASES)
    for label, t in TEMPLATES:
        n, *_, labels, score, spans = scan("Noise here. " + t + " More noise.", automaton)
        mine = [s for s in spans if words(TEMPLATES[s["template"]][1]) == words(t)]
        assert label in labels and score == 1.0 and [(s["first_word"], s["last_word"], s["covered"]) for s in mine] == [(2, n - 3, n - 4)]
    mit = TEMPLATES[0][1].split()
    holes = [w for k, w in enumerate(mit) if k % 30 != 17]  # every thirtieth word is lost
    *_, labels, score, spans = scan(" ".join(holes), automaton)
    assert labels == ["mit"] and 0.9 < score < 1 and spans[0]["covered"] == len(words(" ".join(holes)))
    assert scan(" ".join(mit[: len(mit) // 3]), automaton)[5] == []
    assert scan(" ".join(mit[::-1]), automaton)[5] == []
    twice = scan(" ".join(mit) + " x" * 60 + " " + " ".join(mit), automaton)
    assert [s["covered"] for s in twice[7]] == [len(words(" ".join(mit)))] * 2


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_operator(spark, monkeypatch, stretch):
    automaton = Automaton(TEMPLATES, PHRASES)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "MIT License", "y"), (2, "MIT License", "y"), (2, "MIT License", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    want = sorted(repr((i, *scan(t or "", automaton)[:7])) for i, t, _ in rows)
    monkeypatch.setattr(licenses, "STRETCH", stretch)
    assert sorted(repr((i, *scan(t or "", automaton)[:7])) for i, t, _ in rows) == want
    found = license_scan(df).collect()
    assert sorted(repr((r._row.doc_id, *r[1:8])) for r in found) == want
    assert license_scan(df.limit(0)).count() == 0

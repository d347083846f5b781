"""Rule sets against every rule run on every block."""

import random
import re
from decimal import Decimal

import pytest

from lexiloom.operators import rule_sets as S
from lexiloom.operators.rules import AMOUNT, SCALES, UNITS

CONTEXT = {"cap": "1,000", "odd": "many"}
RULES = [
    {"rule_id": "a", "text_pattern": ["Penalty", {"pattern": "违约", "kind": "phrase"}]},
    {"rule_id": "b", "text_pattern": [{"pattern": "aa", "whole_word": True}, {"pattern": "aa"}]},
    {"rule_id": "c", "text_pattern": [{"pattern": "CNY", "case_sensitive": True}], "numeric": {"compare": "gt", "threshold": 500, "unit": "元"}},
    {"rule_id": "d", "text_pattern": [{"kind": "regex", "pattern": r"pay\w*|违(约|法)"}], "section_match": "责任|dut", "window_blocks": 1},
    {"rule_id": "e", "numeric": {"compare": "lte", "threshold_ref": "cap", "unit": "day", "field": "notice_period"}},
    {"rule_id": "f", "numeric": {"compare": "gt", "threshold_ref": "none"}, "text_pattern": ["penalty"]},
    {"rule_id": "g", "numeric": {"compare": "gt", "threshold_ref": "odd"}, "section_match": "责任"},
    {"rule_id": "h", "section_match": "责任", "window_blocks": 0},
    {"rule_id": "i", "text_pattern": [{"kind": "regex", "pattern": r"x*"}, {"kind": "regex", "pattern": r"(?:no)tice (\d+)", "case_sensitive": True}]},
    {"rule_id": "j", "text_pattern": ["KELVIN", "straße", "ıx", "ſo"]},
    {"rule_id": "k", "numeric": {"compare": "eq", "threshold": "30", "unit": "items"}},
]


def plain(blocks, rule):
    """{(block, matcher, start, end)} and status of one rule on a document, read off the rule."""
    def in_scope(i):
        e = rule.get("section_match")
        if not e:
            return True
        if re.search(e, blocks[i][2] or "", re.I):
            return True
        heads = [j for j in range(i + 1) if blocks[j][0] == "heading"]
        return bool(heads) and i - heads[-1] <= rule.get("window_blocks", 0) and bool(re.search(e, blocks[heads[-1]][1] or "", re.I))

    scoped = [i for i in range(len(blocks)) if in_scope(i)]
    blocks = [(k, t or "", s) for k, t, s in blocks]
    if not scoped:
        return set(), "no_match"
    text = {i: set() for i in scoped}
    for i in scoped:
        for p in rule.get("text_pattern", ()):
            p = {"pattern": p} if isinstance(p, str) else p
            source = p["pattern"] if p.get("kind") == "regex" else re.escape(p["pattern"])
            if p.get("whole_word"):
                source = rf"(?<!\w){source}(?!\w)"
            text[i] |= {(i, "regex" if p.get("kind") == "regex" else "keyword", m.start(), m.end()) for m in re.finditer(source, blocks[i][1], 0 if p.get("case_sensitive") else re.I) if m[0]}
    if rule.get("text_pattern"):
        scoped = [i for i in scoped if text[i]]
        if not scoped:
            return set(), "no_match"
    number = rule.get("numeric")
    if not number:
        return (set().union(*text.values()), "matched") if rule.get("text_pattern") else (set(), "indeterminate")
    limit = number.get("threshold", CONTEXT.get(number.get("threshold_ref")))
    if limit is None or not re.fullmatch(r"[\d,.]+", str(limit)):
        return set(), "indeterminate"
    limit, found = Decimal(str(limit).replace(",", "")), set()
    wanted = UNITS.get(str(number.get("unit", "")).lower(), str(number.get("unit", "")).lower())
    for i in scoped:
        low = blocks[i][1].lower()
        for m in re.finditer(AMOUNT, blocks[i][1], re.I):
            unit = (m["prefix"] or m["suffix"] or "").lower()
            unit = UNITS.get(unit, unit)
            names = [number["field"].lower(), number["field"].lower().replace("_", " ")] if number.get("field") else []
            if wanted and not (unit == wanted or not unit and wanted not in UNITS.values()):
                continue
            if any(x in low for x in names) and not any(x in low[max(0, m.start() - 48) : m.end() + 48] for x in names):
                continue
            value = Decimal(re.sub("[,，]", "", m["number"])) * SCALES.get(m["scale"], 1)
            if {"gt": value > limit, "lte": value <= limit, "eq": value == limit}[number["compare"]]:
                found.add((i, "numeric", m.start(), m.end()))
    return found, "matched" if found else "no_match"


def documents():
    rng = random.Random(6)
    words = ["penalty", "PENALTY", "违约", "责任", "duty", "aa", "aaa", "CNY 600元", "cny 700", "paying", "notice 30", "30 days", "notice period", "2万元", "xx", "ſo", "So", "straße", "STRASSE", "ix", "İx", "Kelvin", "30", "。", "违法"]
    return {d: [(rng.choice(["heading", "paragraph", "paragraph", "table"]), rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.choice([1, 2, 4]))), rng.choice(["责任", "", None])) for _ in range(rng.choice([1, 4, 9]))] for d in range(60)}


@pytest.mark.parametrize("scoped", [True, False])
def test_every_rule_on_every_block(spark, scoped):
    rules = [r for r in RULES if scoped or "section_match" not in r]
    docs = documents()
    rows = [(d, i, *b) for d, blocks in docs.items() for i, b in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_index int, type string, text string, section_path string").repartition(3)
    hits = S.rule_hits(blocks, S.RuleSet(rules, CONTEXT))
    got = {}
    for r in hits.where("matcher <> 'indeterminate'").collect():
        assert docs[r.doc_id][r.block_index][1][r.start : r.end] == r.quote
        got.setdefault((r.doc_id, r.rule_id), set()).add((r.block_index, r.matcher, r.start, r.end))
    status = {(r.doc_id, r.rule_id): r.status for r in S.rule_statuses(hits).collect()}
    for d, b in docs.items():
        for r in rules:
            want, said = plain(b, r)
            assert got.get((d, r["rule_id"]), set()) == want, (d, r, b)
            assert status.get((d, r["rule_id"]), "no_match") == said, (d, r)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("Exchange hash" in plan) == scoped


def test_ten_thousand_rules(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rules = [{"rule_id": str(k), "text_pattern": [word()]} for k in range(10_000)]
    texts = [" ".join(word() for _ in range(50)) for _ in range(200)]
    blocks = spark.createDataFrame([(i, 0, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, block_index int, type string, text string")
    got = {(r.doc_id, r.rule_id) for r in S.rule_hits(blocks, S.RuleSet(rules)).collect()}
    assert got == {(i, r["rule_id"]) for i, t in enumerate(texts) for r in rules if r["text_pattern"][0] in t}


def test_rules_are_checked_when_compiled():
    for bad in ({"text_pattern": [""]}, {"text_pattern": [{"pattern": "x", "kind": "glob"}]}, {"section_match": "("}, {"section_match": "x", "window_blocks": -1}, {"numeric": {"compare": "near"}}):
        with pytest.raises((ValueError, KeyError, re.error)):
            S.RuleSet([{"rule_id": "x", **bad}])
    assert S.needed_literal(r"^ab+c") == "a" or S.needed_literal(r"^ab+cd$") == "cd"
    assert S.needed_literal("a|b") == "" and S.needed_literal("notice (no)?") == "notice "

"""Scoring against gold: association, confusion, calibration, coverage, refusal, gates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.0))
MIN_SIMILARITY, MAX_DROP = 0.55, 0.02
ASSOCIATION_KEY = ["doc_id", "rule_id", "severity", "doc_type"]


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to tp, fp and fn."""
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": rate(2 * p * r, p + r)})


def confusion(outcomes: DataFrame, strata: list[str]) -> DataFrame:
    """tp, fp, fn and scores for each stratum, for the last stratum column alone and over all, in one aggregate.

    ``outcomes`` has the strata and a column ``outcome`` (tp, fp or fn).
    """
    count = lambda x: F.count(F.when(F.col("outcome") == x, 1)).alias(x)
    sets = [[F.col(c) for c in strata], [F.col(strata[-1])], []]
    grouped = outcomes.groupingSets(sets, *[F.col(c) for c in strata]).agg(count("tp"), count("fp"), count("fn"), F.grouping_id().cast("long").alias("level"))
    return with_scores(grouped)


def calibration(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Size, mean confidence and actual precision by confidence bin; what is no number is ``missing``."""
    c = F.col(confidence).try_cast("double")
    c = F.when(c.isNull() | F.isnan(c), None).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    bin_ = F.when(c.isNull(), "missing")
    for low, high in BINS:
        bin_ = bin_.when((c >= low) & ((c < high) | F.lit(high == 1.0)), f"{low:.2f}-{high:.2f}")
    return rows.withColumns({"bin": bin_, "_c": c}).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("actual_precision"))


def text_score(a: str | None, b: str | None) -> float:
    """1 for equal texts; containment at least 0.8; else the ratio of matching blocks. Case and white space do not count."""
    a, b = ("".join((x or "").lower().split()) for x in (a, b))
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return max(0.8, min(len(a), len(b)) / max(len(a), len(b)))
    return difflib.SequenceMatcher(None, a, b).ratio()


def associated(gold: DataFrame, predictions: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Gold and prediction ids in one-to-one pairs by descending score, within document, rule, severity and type.

    Both sides need ASSOCIATION_KEY, ``id``, ``text`` and ``issue_id``. The key splits the matching exactly,
    so each key's few rows are matched greedily on their own.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs, left, right = [], left.sort_values("id"), right.sort_values("id")  # ties go to the smaller ids
        for i, g in enumerate(left.itertuples()):
            for j, p in enumerate(right.itertuples()):
                if g.issue_id and g.issue_id == p.issue_id:
                    score = 1.0
                else:
                    score = text_score(g.text, p.text) if g.text and p.text else 1.0
                if score >= least:
                    pairs.append((-score, i, j, g.id, p.id))
        used_g, used_p, out = set(), set(), []
        for s, i, j, g, p in sorted(pairs):
            if i not in used_g and j not in used_p:
                used_g.add(i), used_p.add(j)
                out.append((g, p, -s))
        return pd.DataFrame(out, columns=["gold_id", "prediction_id", "score"])

    own = lambda df: df.select(*ASSOCIATION_KEY, "id", "text", "issue_id")
    return own(gold).groupBy(ASSOCIATION_KEY).cogroup(own(predictions).groupBy(ASSOCIATION_KEY)).applyInPandas(match, "gold_id long, prediction_id long, score double")


def coverage(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Executed among enabled rules for each document, and whether the run was degraded."""
    both = gold.join(runs, "doc_id", "left")
    done = F.size(F.array_intersect("enabled", F.coalesce("executed", F.array().cast("array<string>")))).cast("long")
    total = F.size(F.array_distinct("enabled")).cast("long")
    out = both.select("doc_id", done.alias("done"), total.alias("total"), F.array_sort(F.array_except("enabled", F.coalesce("executed", F.array().cast("array<string>")))).alias("missing"))
    return out.withColumns({"coverage": rate(F.col("done"), F.col("total"), 1.0), "state": F.when(F.col("done") == F.col("total"), "complete").otherwise("complete_degraded")})


def refusals(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: questions, expected and correct, missed and false refusals, both accuracies."""
    expected = F.coalesce(F.col("expected_refusal"), ~F.col("answerable"))
    rows = questions.join(answers, "question_id", "left").select(expected.alias("e"), F.coalesce("refused", F.lit(False)).alias("r"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    e, r = F.col("e"), F.col("r")
    sums = rows.agg(F.count(F.lit(1)).alias("questions"), count(e).alias("expected"), count(e & r).alias("correct"), count(e & ~r).alias("missed"), count(~e & r).alias("false_refusals"), count(e == r).alias("right"))
    return sums.withColumns({"refusal_accuracy": rate(F.col("correct"), F.col("expected")), "answerability_accuracy": rate(F.col("right"), F.col("questions"))})


def regression_gate(baseline: DataFrame, current: DataFrame, most: float = MAX_DROP) -> DataFrame:
    """Drop of each metric against its baseline and whether it blocks (strictly more than ``most``)."""
    both = baseline.select("metric", F.col("value").alias("before")).join(current.select("metric", F.col("value").alias("after")), "metric")
    return both.withColumn("drop", F.col("before") - F.col("after")).withColumn("blocked", F.col("drop") > most)


CITATION = "struct<block_id: string, document_id: string, version_id: string, quote_start: int, quote_end: int, quote: string, locator: string>"
#: Least (or, for false refusals, most) of each gated rate.
QA_GATES = {"answer_accuracy": 0.90, "citation_exact_match_rate": 1.0, "citation_location_accuracy": 0.95, "refusal_correct_rate": 0.95, "non_refusal_citation_coverage": 1.0, "sse_unique_terminal_rate": 1.0}
MOST_FALSE_REFUSALS = 0.05


def answer_quality(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Each case with what its answer does: terminal event, refusal, facts, citations exact and located, and the failures by name.

    A case has question_id, answerable, document_id, version_id, required_facts and blocks (block_id, text,
    locator); an answer question_id, refused, answer, citations (CITATION) and events. A missing answer is an empty one.
    """
    both = cases.join(answers, "question_id", "left").withColumns(
        {"refused": F.coalesce("refused", F.lit(False)), "answer": F.coalesce("answer", F.lit("")), "citations": F.coalesce("citations", F.array().cast(f"array<{CITATION}>")), "events": F.coalesce("events", F.array().cast("array<string>"))}
    )
    terminal = lambda e: F.coalesce(e.isin("done", "error"), F.lit(False))

    def block(c: Column) -> Column:
        return F.get(F.filter("blocks", lambda b: b["block_id"] == c["block_id"]), F.lit(0))

    def exact(c: Column) -> Column:
        own, size = block(c), c["quote_end"] - c["quote_start"]
        said = F.substring(own["text"], c["quote_start"] + 1, F.greatest(size, F.lit(0)))
        return F.coalesce((c["document_id"] == F.col("document_id")) & (c["version_id"] == F.col("version_id")) & (c["quote"] == said), F.lit(False))

    located = lambda c: exact(c) & F.coalesce(block(c)["locator"].eqNullSafe(c["locator"]), F.lit(False))
    count = lambda f: F.size(F.filter("citations", f)).cast("long")
    checked = both.withColumns(
        {
            "one_terminal": (F.size(F.filter("events", terminal)) == 1) & terminal(F.try_element_at("events", F.lit(-1))),
            "correct": F.forall("required_facts", lambda f: F.contains(F.col("answer"), f)),
            "cited": F.size("citations").cast("long"),
            "exact": count(exact),
            "located": count(located),
        }
    )
    a, r = F.col("answerable"), F.col("refused")
    names = {
        "answer_fact_mismatch": a & ~r & ~F.col("correct"),
        "false_refusal": a & r,
        "invalid_terminal_count": ~F.col("one_terminal"),
        "locator_mismatch": F.col("located") < F.col("cited"),
        "missed_refusal": ~a & ~r,
        "missing_citation": a & ~r & (F.col("cited") == 0),
        "quote_mismatch": F.col("exact") < F.col("cited"),
    }
    return checked.select("question_id", "answerable", "refused", "one_terminal", "correct", "cited", "exact", "located", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names.items()])).alias("failures"))


def qa_metrics(checked: DataFrame) -> DataFrame:
    """One row of eight rates, each with its value for no cases, and whether all gates are passed."""
    a, r = F.col("answerable"), F.col("refused")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = checked.agg(
        F.count(F.lit(1)).alias("cases"), n(a).alias("answerable"), n(~a).alias("refusable"), n(a & ~r & F.col("correct")).alias("correct"), n(F.col("cited")).alias("cited"), n(F.col("exact")).alias("exact"),
        n(F.col("located")).alias("located"), n(r).alias("refused"), n(~a & r).alias("refused_rightly"), n(a & r).alias("refused_wrongly"), n(a & ~r).alias("answered"), n(a & ~r & (F.col("cited") > 0)).alias("grounded"), n(F.col("one_terminal")).alias("ended"),
    )
    part = lambda x, y, empty=0.0: rate(F.col(x), F.col(y), empty)
    out = sums.select(
        "cases",
        part("correct", "answerable").alias("answer_accuracy"),
        part("exact", "cited", 1.0).alias("citation_exact_match_rate"),
        part("located", "cited", 1.0).alias("citation_location_accuracy"),
        part("refused", "cases").alias("refusal_rate"),
        part("refused_rightly", "refusable", 1.0).alias("refusal_correct_rate"),
        part("refused_wrongly", "answerable").alias("false_refusal_rate"),
        part("grounded", "answered", 1.0).alias("non_refusal_citation_coverage"),
        part("ended", "cases").alias("sse_unique_terminal_rate"),
    )
    passed = F.col("false_refusal_rate") <= MOST_FALSE_REFUSALS
    for c, least in QA_GATES.items():
        passed = passed & (F.col(c) >= least)
    return out.withColumn("passed", passed)


def gated_metrics(confused: DataFrame, strata: int) -> DataFrame:
    """The four gated metrics (metric, value) of ``confusion`` with so many strata, severity last: precision and recall over all and of high severity."""
    everything, last = (1 << strata) - 1, (1 << strata) - 2
    kept = confused.where((F.col("level") == everything) | ((F.col("level") == last) & (F.col("severity") == "high")))
    named = kept.select(F.when(F.col("level") == everything, "overall").otherwise("by_severity.high").alias("series"), "precision", "recall")
    return named.unpivot("series", ["precision", "recall"], "kind", "value").select(F.concat_ws(".", "series", "kind").alias("metric"), "value")


def gold_rows(documents: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """Gold files (one JSON object each) as issues, refusal questions and enabled rules, with their document's id and type."""
    schema = (
        "doc_id string, doc_type string, enabled_rules array<string>, issues array<struct<issue_id: string, rule_id: string, severity: string, text: string>>, refusal_questions array<struct<question_id: string, question: string, expected_refusal: boolean>>"
    )
    doc = documents.select(F.from_json(text, schema).alias("d")).select("d.*").withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown")))
    return {
        "issues": doc.select("doc_id", "doc_type", F.explode("issues").alias("x")).select("doc_id", "doc_type", "x.*"),
        "questions": doc.select("doc_id", "doc_type", F.explode("refusal_questions").alias("x")).select("doc_id", "doc_type", "x.*"),
        "rules": doc.select("doc_id", F.explode("enabled_rules").alias("rule_id")),
    }


def qa_report(metrics: DataFrame, dataset: str) -> DataFrame:
    """The metrics row as JSON and as a Markdown table of percentages with its gates."""
    percent = lambda c: F.format_string("%.2f%%", F.round(F.col(c) * 100, 2))
    gates = {c: f">={x:.0%}" if x < 1 else "100%" for c, x in QA_GATES.items()} | {"false_refusal_rate": f"<={MOST_FALSE_REFUSALS:.0%}", "refusal_rate": "-"}
    rates = [c for c in metrics.columns if c in gates]
    lines = [F.concat(F.lit(f"| {c} | "), percent(c), F.lit(f" | {gates[c]} |")) for c in rates]
    text = F.concat_ws("\n", F.lit(f"# {dataset}"), F.lit(""), F.lit("| metric | result | gate |"), F.lit("| --- | ---: | ---: |"), *lines, F.lit(""), F.when(F.col("passed"), "passed").otherwise("failed"))
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"), text.alias("markdown"))

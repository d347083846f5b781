"""Rules over blocks: scope, keywords, regular expressions, numeric thresholds, findings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T

MAX_BLOCKS, CHUNK_BLOCKS, NEAR_CHARS = 5, 32, 48

# Canonical units and their names, scales, and the form of an amount.
UNIT_NAMES = {
    "cny": ("cny", "rmb", "人民币", "元", "￥", "¥"),
    "usd": ("usd", "美元", "$", "us$"),
    "day": ("day", "days", "天", "日"),
    "month": ("month", "months", "个月", "月"),
    "year": ("year", "years", "年"),
    "percent": ("percent", "%", "％", "百分比"),
}
SCALES = {"万": 10_000, "亿": 100_000_000}
AMOUNT = (
    r"(?P<prefix>人民币|RMB|CNY|USD|US\$|美元|[$￥¥])?\s*"
    r"(?P<number>[+-]?(?:\d{1,3}(?:[,，]\d{3})+|\d+)(?:\.\d+)?)\s*"
    r"(?P<scale>[万亿])?\s*"
    r"(?P<suffix>人民币|RMB|CNY|USD|美元|元|天|日|个月|月|年|%|％)?"
)

UNITS = {name: unit for unit, names in UNIT_NAMES.items() for name in names}
_NUMBER = re.compile(AMOUNT, re.IGNORECASE)
HIT = "array<struct<start: int, end: int, quote: string>>"
NUMBER = "array<struct<start: int, end: int, quote: string, value: decimal(38,6), unit: string>>"


def keyword_hits(text, keyword: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """All literal matches, without Python: (start, end, quote) of the text as it stands."""
    at = T.literal_offsets(text, keyword, case_sensitive, whole_word)
    return F.transform(at, lambda s: F.struct(s.alias("start"), (s + len(keyword)).alias("end"), F.substring(T.col(text), s + 1, F.lit(len(keyword))).alias("quote")))


def pattern_hits(text, pattern: str, case_sensitive: bool = False, whole_word: bool = False, literal: bool = False) -> Column:
    """All non-empty matches of a pattern in Python's dialect, in Arrow batches behind a plain filter."""
    source = re.escape(pattern) if literal else pattern
    rule = re.compile(rf"(?<!\w)(?:{source})(?!\w)" if whole_word else source, 0 if case_sensitive else re.IGNORECASE)

    @F.pandas_udf(HIT)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "quote": m[0]} for m in rule.finditer(t or "") if m[0]])

    return find(T.col(text))


def amounts(text) -> Column:
    """Numbers with currency, thousands separators, scale and unit, left to right."""

    @F.pandas_udf(NUMBER)
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            out = []
            for m in _NUMBER.finditer(t or ""):
                value = Decimal(re.sub("[,，]", "", m["number"])) * SCALES.get(m["scale"], 1)
                unit = m["prefix"] or m["suffix"] or ""
                if abs(value) < Decimal(10) ** 31:
                    out.append({"start": m.start(), "end": m.end(), "quote": m[0].strip(), "value": value, "unit": UNITS.get(unit.lower(), unit.lower())})
            return out

        return texts.map(one)

    return find(T.col(text))


def canonical_unit(unit) -> Column:
    """A unit by its canonical name; others lower-cased."""
    low = F.lower(T.stripped(unit))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[low], low)


def compared(value: Column, how: str, threshold: Column) -> Column:
    return {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold, "eq": value == threshold}[how]


def unit_fits(wanted: str | None, actual: Column) -> Column:
    """A known unit must be the same; a bare number does only for units that are not known."""
    if not wanted:
        return F.lit(True)
    name = UNITS.get(wanted.lower(), wanted.lower())
    return actual == name if name in set(UNITS.values()) else (actual == name) | (actual == "")


def field_near(text: Column, start: Column, end: Column, field: str | None) -> Column:
    """The field's name, or it with blanks for underscores, within NEAR_CHARS of the number, if the text has it at all."""
    if not field:
        return F.lit(True)
    names = dict.fromkeys((field.lower(), field.lower().replace("_", " ")))
    begin = F.greatest(F.lit(0), start - NEAR_CHARS)
    holds = lambda c: reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(n)) for n in names])
    return ~holds(text) | holds(F.substring(text, begin + 1, end + NEAR_CHARS - begin))


def in_scope(blocks: DataFrame, section: str, window: int, key: str = "doc_id") -> DataFrame:
    """Adds ``in_scope``: a heading that matches, and up to ``window`` blocks after it before the next heading."""
    before = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.last(F.when(F.col("type") == "heading", F.struct("block_index", F.col("text").alias("title"))), ignorenulls=True).over(before)
    return blocks.withColumn("_head", head).withColumn("in_scope", F.coalesce(F.col("_head.title").rlike(f"(?i){section}") & (F.col("block_index") - F.col("_head.block_index") <= window), F.lit(False))).drop("_head")


def section_paths(blocks: DataFrame, level: Column, depth: int = 2, key: str = "doc_id") -> DataFrame:
    """Adds ``section_path``: the nearest heading of each level that no later heading of a higher level ends."""
    before = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, heads = blocks.withColumn("_level", F.when(F.col("type") == "heading", level)), []
    for k in range(1, depth + 1):
        out = out.withColumn(f"_h{k}", F.last(F.when(F.col("_level") == k, F.struct("block_index", "text")), ignorenulls=True).over(before))
    for k in range(1, depth + 1):
        later = [F.col(f"_h{j}.block_index") > F.col(f"_h{k}.block_index") for j in range(1, k)]
        ended = F.lit(False)
        for x in later:
            ended = ended | F.coalesce(x, F.lit(False))
        heads.append(F.when(~ended, F.col(f"_h{k}.text")))
    return out.withColumn("section_path", F.array_compact(F.array(*heads))).drop("_level", *[f"_h{k}" for k in range(1, depth + 1)])


def first_hits(blocks: DataFrame, rules: list[dict]) -> DataFrame:
    """For each block and rule the first keyword match that is no false positive; rules are compiled into one pass."""
    found = []
    for r in rules:
        hits = F.filter(keyword_hits("text", r["keyword"]), lambda h: T.false_positive_reason(h["quote"]).isNull())
        found.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.get(hits, F.lit(0)).alias("hit")))
    rows = blocks.withColumn("_f", F.explode(F.filter(F.array(*found), lambda f: f["hit"].isNotNull())))
    return rows.select(*blocks.columns, "_f.rule_id", "_f.severity", F.col("_f.hit.start").alias("start"), F.col("_f.hit.end").alias("end"), F.col("_f.hit.quote").alias("quote")).drop("_f")


def capped(hits: DataFrame, cap: int = MAX_BLOCKS, key: str = "doc_id") -> DataFrame:
    """The first ``cap`` blocks of each rule and document."""
    order = Window.partitionBy(key, "rule_id").orderBy("block_index")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def finding_id(document, version, block, rule, quote) -> Column:
    """First half of the SHA-256 over compact JSON with sorted keys."""
    parts = F.struct(block.alias("block_id"), document.alias("document_id"), F.sha2(quote, 256).alias("quote_hash"), rule.alias("rule_id"), version.alias("version_id"))
    return F.left(F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256), F.lit(32))


def chunk_id(document, block_index) -> Column:
    return F.concat(document, F.lit(":"), F.lpad(F.floor(block_index / CHUNK_BLOCKS).cast("string"), 4, "0"))


def statuses(blocks: DataFrame, keyword: str | None = None, numeric: dict | None = None, section: str | None = None, window: int = 10, key: str = "doc_id") -> DataFrame:
    """matched, no_match or indeterminate for each document: scope, then text, then number.

    ``numeric``: how, threshold (None: missing), and ``value``, the array of the block's numbers.
    """
    rows = in_scope(blocks, section, window, key) if section else blocks.withColumn("in_scope", F.lit(True))
    text = F.contains(F.lower("text"), F.lit(keyword.lower())) if keyword else F.lit(True)
    number = F.lit(False)
    if numeric and numeric["threshold"] is not None:
        number = F.exists(numeric["value"], lambda v: compared(v, numeric["how"], F.lit(numeric["threshold"])))
    flags = rows.groupBy(key).agg(
        F.sum(F.col("in_scope").cast("int")).alias("scoped"),
        F.sum((F.col("in_scope") & text).cast("int")).alias("hits"),
        F.sum((F.col("in_scope") & text & number).cast("int")).alias("numbers"),
    )
    status = F.when(F.col("scoped") == 0, "no_match")
    if keyword:
        status = status.when(F.col("hits") == 0, "no_match")
    if not numeric:
        status = status.otherwise("matched" if keyword else "indeterminate")
    elif numeric["threshold"] is None:
        status = status.otherwise("indeterminate")
    else:
        status = status.otherwise(F.when(F.col("numbers") > 0, "matched").otherwise("no_match"))
    return flags.select(key, status.alias("status"))


def reviewed(blocks: DataFrame, complete, rule_prompt: str, batch: int = CHUNK_BLOCKS) -> DataFrame:
    """Blocks past a pluggable model: ``complete(prompt, texts)`` answers a batch of texts; one Arrow batch at a time."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([a for i in range(0, len(texts), batch) for a in complete(rule_prompt, texts.iloc[i : i + batch].tolist())], dtype="object")

    return blocks.withColumn("answer", ask("text"))

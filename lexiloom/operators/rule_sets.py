"""Many compiled rules over many blocks at once: scope, then words and patterns, then numbers.

A rule has an id and, all optional, ``section_match`` with ``window_blocks``, ``text_pattern`` (words or
``{kind: keyword | phrase | regex, pattern, case_sensitive, whole_word}``) and ``numeric`` (compare, threshold or
``threshold_ref``, unit, field). All words of all rules, and the longest literal that each expression needs, stand
in one Aho-Corasick automaton; a block passes it once, whatever the number of rules, and only what it finds
is looked at rule by rule. There is no join of blocks and rules. A block carries its section and the heading above it, so scopes
are decided block by block too, once for each expression and heading of a batch.

Rules are configuration: they travel with the tasks, and a set of over ``MAX_RULES`` is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import _NUMBER, NEAR_CHARS, SCALES, UNITS

MAX_RULES = 200_000
COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}
HITS = "rule_id string, matcher string, pattern string, start int, end int, quote string"


@lru_cache(1 << 16)
def _folded(c: str) -> str:
    """A character as patterns that ignore case see it, always one."""
    if c in "İı":
        return "i"
    return next((x for x in (c.casefold(), c.lower()) if len(x) == 1), c)


def folded(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_folded, text))


def needed_literal(pattern: str) -> str:
    """The longest run of characters that every match of an expression has; empty if none is certain."""
    best = run = ""
    for op, value in parser.parse(pattern):
        if op is sre.LITERAL:
            run += chr(value)
            best = max(best, run, key=len)
        elif op is not sre.AT:
            run = ""
    return best


class _Number:
    def __init__(self, config: dict, context: dict):
        self.compare = COMPARE[str(config["compare"]).lower()]
        source = config.get("threshold")
        if source is None and config.get("threshold_ref"):
            source = context.get(str(config["threshold_ref"]))
        try:
            self.threshold = None if source is None else Decimal(re.sub("[,，]", "", str(source)))
        except InvalidOperation:
            self.threshold = None
        unit = str(config.get("unit") or "").strip().lower()
        self.unit = UNITS.get(unit, unit)
        self.known = self.unit in set(UNITS.values())
        field = str(config.get("field") or "").strip().lower()
        self.names = tuple(dict.fromkeys((field, field.replace("_", " ")))) if field else ()

    def hits(self, low: str, numbers: list[tuple]) -> Iterator[tuple]:
        spoken = any(n in low for n in self.names)
        for start, end, quote, value, unit in numbers:
            if self.unit and not (unit == self.unit if unit or self.known else True):
                continue
            if spoken and not any(n in low[max(0, start - NEAR_CHARS) : end + NEAR_CHARS] for n in self.names):
                continue
            if self.compare(value, self.threshold):
                yield "numeric", None, start, end, quote


class RuleSet:
    """Rules ready to run; an invalid one is an error here, not in a task."""

    def __init__(self, rules: list[dict], context: dict | None = None):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with a task")
        self.ids = [str(r["rule_id"]) for r in rules]
        self.scopes: list[tuple[str, int] | None] = []
        self.numbers: list[_Number | None] = []
        self.worded: list[bool] = []
        #: (rule, kind, pattern as given, compiled, whole word)
        self.patterns: list[tuple[int, str, str, re.Pattern]] = []
        words: dict[str, list[int]] = {}
        self.always: list[int] = []
        for n, r in enumerate(rules):
            section, window = r.get("section_match"), r.get("window_blocks", 0)
            if not isinstance(window, int) or isinstance(window, bool) or window < 0:
                raise ValueError("window_blocks is a number from 0")
            if section:
                re.compile(section)
            self.scopes.append((section, window) if section else None)
            self.numbers.append(_Number(r["numeric"], context or {}) if r.get("numeric") else None)
            self.worded.append(bool(r.get("text_pattern")))
            for p in r.get("text_pattern") or ():
                config = {"pattern": p} if isinstance(p, str) else p
                kind, pattern = str(config.get("kind") or "keyword").lower(), config["pattern"]
                if not pattern or kind not in ("keyword", "phrase", "regex"):
                    raise ValueError(f"no pattern of a known kind: {config}")
                source = pattern if kind == "regex" else re.escape(pattern)
                if config.get("whole_word") and kind != "regex":
                    source = rf"(?<!\w){source}(?!\w)"
                rule = re.compile(source, 0 if config.get("case_sensitive") else re.IGNORECASE)
                literal = needed_literal(pattern) if kind == "regex" else pattern
                (words.setdefault(folded(literal), []) if literal else self.always).append(len(self.patterns))
                self.patterns.append((n, "regex" if kind == "regex" else "keyword", pattern, rule))
        #: Rules that are not led by words: numbers alone, or nothing at all.
        self.wordless = [n for n, w in enumerate(self.worded) if not w]
        self.automaton = ahocorasick.Automaton()
        for w, patterns in words.items():
            self.automaton.add_word(w, tuple(patterns))
        if words:
            self.automaton.make_automaton()
        self.searched: dict[tuple[str, str], bool] = {}

    def _says(self, expression: str, text: str) -> bool:
        if len(self.searched) > 200_000:
            self.searched.clear()
        key = expression, text
        if key not in self.searched:
            self.searched[key] = bool(re.search(expression, text, re.IGNORECASE))
        return self.searched[key]

    def _in_scope(self, n: int, section: str, heading: str, distance: int | None) -> bool:
        """By the block's section, or by the heading that it is or that stands at most the window above."""
        scope = self.scopes[n]
        return scope is None or self._says(scope[0], section) or distance is not None and distance <= scope[1] and self._says(scope[0], heading)

    def block(self, text: str, section: str, heading: str, distance: int | None) -> list[tuple]:
        """(rule, matcher, pattern, start, end, quote) of a block; ``indeterminate`` where a rule's threshold or condition is missing."""
        low = folded(text)
        # Where each pattern may begin: a word ends where the automaton says so, an expression is looked for.
        due: dict[int, None] = dict.fromkeys(self.always)
        if len(self.automaton):
            for _, patterns in self.automaton.iter(low):
                due.update(dict.fromkeys(patterns))
        found: dict[int, list[tuple]] = {}
        for p in due:
            n, matcher, pattern, rule = self.patterns[p]
            if self._in_scope(n, section, heading, distance):
                hits = [(matcher, pattern, m.start(), m.end(), m[0]) for m in rule.finditer(text) if m[0]]
                if hits:
                    found.setdefault(n, []).extend(hits)
        numbers = None
        out = []
        for n in [*found, *(n for n in self.wordless if self._in_scope(n, section, heading, distance))]:
            number = self.numbers[n]
            if number is None:
                out += [(self.ids[n], *h) for h in found.get(n, [("indeterminate", None, None, None, None)])]
            elif number.threshold is None:
                out.append((self.ids[n], "indeterminate", None, None, None, None))
            else:
                numbers = _numbers(text) if numbers is None else numbers
                out += [(self.ids[n], *h) for h in number.hits(low, numbers)]
        # A place that one matcher names twice is one hit.
        return list({(h[0], h[1], h[3], h[4], h[5]): h for h in reversed(out)}.values())[::-1]


def _numbers(text: str) -> list[tuple]:
    out = []
    for m in _NUMBER.finditer(text):
        raw = (m["prefix"] or m["suffix"] or "").strip().lower()
        out.append((m.start(), m.end(), m[0], Decimal(re.sub("[,，]", "", m["number"])) * SCALES.get(m["scale"], 1), UNITS.get(raw, raw)))
    return out


def with_headings(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``heading`` (of the block itself, if it is one, else the nearest above) and ``distance`` to it in blocks."""
    before = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.last(F.when(F.col("type") == "heading", F.struct("block_index", "text")), ignorenulls=True).over(before)
    return blocks.withColumn("_head", head).withColumns({"heading": F.coalesce("_head.text", F.lit("")), "distance": (F.col("block_index") - F.col("_head.block_index")).cast("int")}).drop("_head")


def rule_hits(blocks: DataFrame, rules: RuleSet, key: str = "doc_id") -> DataFrame:
    """Hits of all rules: ``doc_id``, ``block_index``, rule, matcher, pattern, place and quote. Null texts are empty ones.

    Blocks have block_index, type, text and, where there are sections, section_path (a string). A set without scopes needs no exchange.
    """
    section = F.coalesce(F.col("section_path"), F.lit("")) if "section_path" in blocks.columns else F.lit("")
    scoped = any(rules.scopes)
    placed = with_headings(blocks, key) if scoped else blocks.withColumns({"heading": F.lit(""), "distance": F.lit(None).cast("int")})
    rows = placed.select(F.col(key).alias("_key"), "block_index", F.coalesce("text", F.lit("")).alias("_text"), section.alias("_section"), "heading", "distance")
    key_type = rows.schema["_key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            at, out = [], []
            for i, (text, where, head, distance) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_section", "heading", "distance")))):
                hits = rules.block(text, where, head, distance)
                at += [i] * len(hits)
                out += hits
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_key").take(place), b.column("block_index").take(place), *[pa.array([h[k] for h in out], t) for k, t in enumerate(kinds)]], names=["_key", "block_index", "rule_id", "matcher", "pattern", "start", "end", "quote"])

    index_type = rows.schema["block_index"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_key {key_type}, block_index {index_type}, {HITS}").withColumnRenamed("_key", key)


def rule_statuses(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``matched`` or ``indeterminate`` for each document and rule that has hits; all others are ``no_match``. Counted where they are before the exchange."""
    told = hits.groupBy(key, "rule_id").agg(F.count(F.when(F.col("matcher") != "indeterminate", 1)).alias("hits"), F.min(F.when(F.col("matcher") != "indeterminate", F.struct("block_index", "start", "end", "quote"))).alias("first"))
    return told.select(key, "rule_id", F.when(F.col("hits") > 0, "matched").otherwise("indeterminate").alias("status"), "hits", "first")

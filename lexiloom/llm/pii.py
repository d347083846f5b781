"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; these are the
seeds. The words around a seed give lexical patterns (word before; two words before; word before with
word after). A pattern of a kind is kept if it holds at least ``MIN_SHARE`` of the kind's seeds and
``MIN_SUPPORT`` distinct ones, so there are at most 3 / MIN_SHARE patterns a kind at any corpus size.
One more pass goes to every place where a kept pattern occurs: it counts the places, and where the words
that the pattern points at have a wider form of the kind (``FORMS``; several words, spaced digits or
addresses that the fixed patterns refuse among them) they become an instance. On the graph of patterns
and instances Spark then scores both in turn: an instance is as sure as its patterns together (noisy
or), a pattern as its seeds and instances over all its places. Instances of sure patterns are added as
spans; of overlapping ones the first and longest.

Defined results: null and empty texts have no spans; rows that repeat a doc_id and text get the same
spans; a null doc_id is an id like any other; ties between kinds go to the surer pattern, then to the
kind listed first; an empty table gives no rows; columns in ``keep`` pass through in ``_row``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, written

KINDS = ("email", "ip", "card", "phone")
MIN_SHARE, MIN_SUPPORT, ROUNDS, SURE = 2.0**-12, 4, 3, 0.5
LONG_WORD, CACHED_WORDS = 40, 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, from its start: from further in it would fail the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = "\"'()[]{}<>,.;:!?*#$%&|=~`"
_LIKE = re.compile(r"[0-9@]|::")
_WORD = re.compile(r"\S+")
#: What a pattern may point at, by kind.
FORMS = (
    re.compile(r"[^\s@<>()\[\]{},;:\"']++@[^\s@<>()\[\]{},;:\"']*[^\s@<>()\[\]{},;:\"'.!?]"),
    re.compile(r"[0-9]++(?:\.[0-9]++){3,}+|(?=[0-9A-Fa-f:]*(?:::|(?::[0-9A-Fa-f]+){3}))[0-9A-Fa-f:]*[0-9A-Fa-f]"),
    re.compile(r"[0-9](?:[ -]?[0-9]){11,}+"),
    re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,}+"),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


def word_form(word: str) -> str:
    """A context word: lower-cased, digits alike, marks at its edges off unless it is all marks; long words go by their digest."""
    if len(word) > LONG_WORD:
        return f"{len(word)}:{blake2b(word.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"
    word = word.lower()
    return _DIGITS.sub("0", word.strip(_EDGE) or word)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, instance, two words before, word after) of each span."""
    words = [m.span() for m in _WORD.finditer(text)] if spans else []
    starts = [s for s, _ in words]
    form = lambda k: word_form(text[slice(*words[k])]) if 0 <= k < len(words) else None
    out = []
    for kind, s, e in spans:
        first, last = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
        out.append((kind, text[s:e], form(first - 2), form(first - 1), form(last + 1)))
    return out


def pointed_at(text: str, kind: int, at: int, end: int) -> tuple[int, int] | None:
    """The instance of a kind that begins with the word at ``at``, after marks; the words of it that follow are its own."""
    while at < end:
        if m := FORMS[kind].match(text, at):
            return m.span()
        if text[at] not in _EDGE:
            return None
        at += 1
    return None


_UNIT = pa.struct([("kind", pa.int32()), ("instance", pa.string()), ("before2", pa.string()), ("before1", pa.string()), ("after", pa.string())])
_FOUND = [("_id", pa.int64()), ("_crc", pa.int64()), ("form", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("kind", pa.int32()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("places", pa.int64())]


def occurrences(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two sorts: how often each pattern's words occur with anything between or behind them (``places``; instance null), and the instances found there."""
    wanted: dict[tuple, list[int]] = {}
    for r in patterns.select("pattern.*", "kind").collect():  # 3 / MIN_SHARE a kind at most
        wanted.setdefault((r.form, r.a, r.b), []).append(r.kind)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of = shared.value
        alone = {a for form, a, _ in kinds_of if form == 1}
        led, around = ({p[1:] for p in kinds_of if p[0] == form} for form in (2, 3))
        before = {a for a, _ in around}
        forms: dict[str, tuple[str, bool]] = {}
        seen: Counter = Counter()

        def known(w: str) -> tuple[str, bool]:
            if w not in forms:
                if len(forms) > CACHED_WORDS:
                    forms.clear()
                if len(w) > LONG_WORD:
                    return word_form(w), bool(_LIKE.search(w))
                forms[w] = word_form(w), bool(_LIKE.search(w))
            return forms[w]

        def instances(text: str, said: list[tuple[str, bool]]) -> Iterator[tuple]:
            slots = []
            for k, (_, like) in enumerate(said):
                if like and k:
                    w = said[k - 1][0]
                    if w in alone:
                        slots.append((k, (1, w, "")))
                    if k > 1 and (said[k - 2][0], w) in led:
                        slots.append((k, (2, said[k - 2][0], w)))
                    if w in before:
                        slots.append((k, (3, w, None)))
            if not slots:
                return
            words = [m.span() for m in _WORD.finditer(text)]
            starts, taken = [s for s, _ in words], sorted((s, e) for _, s, e in base_spans(text))
            for k, (form, a, b) in slots:
                for kind in range(len(KINDS)):
                    if form < 3 and kind not in kinds_of[form, a, b]:
                        continue
                    if not (span := pointed_at(text, kind, *words[k])):
                        continue
                    if form == 3:
                        last = bisect_right(starts, span[1] - 1)
                        b = said[last][0] if last < len(said) else None
                        if kind not in kinds_of.get((form, a, b), ()):
                            continue
                    near = bisect_right(taken, span)
                    if all(e <= span[0] or s >= span[1] for s, e in taken[max(0, near - 4) : near + 1]):
                        yield form, a, b, kind, text[slice(*span)], *span

        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                said = [known(w) for w in (text or "").split()]
                shaped = [w for w, _ in said]
                seen.update((1, w, "") for w in filter(alone.__contains__, shaped[:-1]))
                seen.update((2, *p) for p in filter(led.__contains__, zip(shaped, shaped[1:-1])))
                seen.update((3, *p) for p in filter(around.__contains__, zip(shaped, shaped[2:])))
                found = list(instances(text, said)) if text else []
                if found:
                    crc = zlib.crc32(text.encode("utf-8", "replace"))
                    rows += [(i, crc, *x, None) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 10, _FOUND)], names=[n for n, _ in _FOUND])
        columns = [*zip(*seen)] or [[]] * 3
        none = [None] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((none, none, *columns, none, none, none, none, list(seen.values())), _FOUND)], names=[n for n, _ in _FOUND])

    framed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = framed.mapInArrow(run, "_id long, _crc long, form int, a string, b string, kind int, instance string, start long, end long, places long")
    return found.select("_id", "_crc", F.struct("form", "a", "b").alias("pattern"), "kind", "instance", "start", "end", "places")


def personal_data(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``_row``, ``base`` and ``spans``: arrays of (kind number, start, end) in code points, by kind, then start."""
    bounded_batches(docs.sparkSession)
    framed = docs.select(packed(docs, keep=keep), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _UNIT]
        for b in batches:
            crc, base, own = [], [], []
            for text in b.column("_text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                crc.append(zlib.crc32(text.encode("utf-8", "replace")))
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                own.append([dict(zip(names, u)) for u in contexts(text, spans)])
            span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_id"), pa.array(crc, pa.int64()), pa.array(base, pa.list_(span)), pa.array(own, pa.list_(_UNIT))], names=["_row", "_id", "_crc", "base", "units"])

    span = "struct<kind: int, start: bigint, end: bigint>"
    unit = "struct<kind: int, instance: string, before2: string, before1: string, after: string>"
    found = written(framed.mapInArrow(extract, f"_row {framed.schema['_row'].dataType.simpleString()}, _id long, _crc long, base array<{span}>, units array<{unit}>"))
    u = F.col("u")
    pattern = lambda form, a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(form).alias("form"), a.alias("a"), b.alias("b")))
    forms = F.array(pattern(1, u["before1"], F.lit("")), pattern(2, u["before2"], u["before1"]), pattern(3, u["before1"], u["after"]))
    seeds = found.select(F.explode("units").alias("u")).select("u.kind", "u.instance", F.explode(forms).alias("pattern")).where("pattern IS NOT NULL")
    sizes = found.select(F.explode("base.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("seeds"))
    patterns = written(
        seeds.groupBy("pattern", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instance").alias("support"))
        .join(F.broadcast(sizes), "kind")
        .where((F.col("support") >= MIN_SUPPORT) & (F.col("n") >= F.col("seeds") * MIN_SHARE))
        .select("pattern", "kind", "n")
    )
    places = written(occurrences(docs, patterns, id_col, text_col))
    totals = places.where("places IS NOT NULL").groupBy("pattern").agg(F.sum("places").alias("total"))
    known = written(patterns.join(totals, "pattern", "left").select("pattern", "kind", "n", F.greatest("total", "n").alias("total")))
    links = places.where("places IS NULL").drop("places")
    # Each pair once, so a frequent instance has a row for each of its patterns and no more.
    pairs = written(links.groupBy("pattern", "kind", "instance").agg(F.count(F.lit(1)).alias("times")))
    scored = known.select("pattern", "kind", F.least(F.lit(1.0), F.col("n") / F.col("total")).alias("sure"))
    for _ in range(ROUNDS):
        # Instances from their patterns, then patterns from seeds (sure) and instances over all places.
        weighed = pairs.join(F.broadcast(scored), ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("sure")))))).alias("weight"))
        gains = pairs.join(weighed, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("weight") * F.col("times")).alias("gain"))
        scored = written(known.join(gains, ["pattern", "kind"], "left").select("pattern", "kind", F.least(F.lit(1.0), (F.col("n") + F.coalesce("gain", F.lit(0.0))) / F.col("total")).alias("sure")))
    by_start = F.struct("start", (-F.col("end")).alias("back"), (-F.col("best.sure")).alias("doubt"), (-F.col("best.first")).alias("kind"))
    bare = "array<struct<kind: int, start: bigint, end: bigint>>"
    apart = F.aggregate(
        F.sort_array("candidates"),
        F.struct(F.lit(-1).cast("long").alias("end"), F.lit(None).cast(bare).alias("kept")),
        lambda acc, x: F.when(
            x["start"] >= acc["end"],
            F.struct((-x["back"]).alias("end"), F.concat(F.coalesce(acc["kept"], F.array().cast(bare)), F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    added = (
        links.join(F.broadcast(scored.where(F.col("sure") >= SURE)), ["pattern", "kind"])
        .groupBy("_id", "_crc", "start", "end")
        .agg(F.max(F.struct("sure", (-F.col("kind")).alias("first"))).alias("best"))
        .groupBy(F.col("_id").alias("_aid"), F.col("_crc").alias("_acrc"))
        .agg(F.collect_set(by_start).alias("candidates"))
        .select("_aid", "_acrc", apart.alias("added"))
    )
    both = found.join(added, F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_crc") == F.col("_acrc")), "left")
    return both.select("_row", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("spans"))

"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND.

Items are tokenised (lower-cased runs of letters and digits) into an inverted index whose postings
hold BM25 impacts relative to the item's own full score, in blocks of items with their largest impact. Every
text is cut into half-overlapping passages at least twice as long as an item, so each item that a text
holds lies whole in some passage; the length depends on the item alone (``passage_words``), and items
that ask for equal passages are indexed together. A passage is a query: block-max WAND retrieves every
item that scores at least ``MIN_SCORE`` of its own full score. The block maxima of a passage's terms
are added up for many passages at once, blocks that cannot reach the score are passed over, and in the
others WAND moves its cursors from pivot to pivot. A retrieved item counts if the
passage also holds at least ``MIN_OVERLAP`` of the three-word shingles of its question and of its
answer.

Statistics are those of all items. The items are dealt by id to shards of about ``SHARD_BYTES``, so what
a task holds is bounded; each further shard is another pass over the texts and changes no result.

Defined results: null and empty texts and items match nothing; repeated rows give repeated results; of
items with equal ids (null is one) a text gets one row with the largest values; an empty table on either
side gives no rows; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, written

K1, B = 1.2, 0.75
MIN_SCORE, MIN_OVERLAP = 0.5, 0.5
PASSAGE, SHINGLE = 128, 3
BLOCK = 4
CELLS, SLICE_BYTES = 2_000_000, 1_000_000
SHARD_BYTES = 4_000_000
LAST_SENTENCE = r"(?s)^(.*[.!?\n])\s*([^.!?\n]+[.!?]*)\z"
_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def shingles(found: list[bytes]) -> set:
    """Three-word shingles; of fewer words the sequence itself."""
    return set(zip(*[found[k:] for k in range(SHINGLE)])) if len(found) >= SHINGLE else ({tuple(found)} if found else set())


def passage_words(n: int) -> int:
    """Words in a passage for an item of n words: at least twice as many, a power of two."""
    return max(PASSAGE, 2 << (n - 1).bit_length()) if n > 0 else PASSAGE


def question_answer(text_col: str = "text") -> list:
    """An item's last sentence or line as the answer, all before as the question; one sentence is both."""
    text = F.trim(F.col(f"`{text_col}`"))
    part = lambda k: F.when(text.rlike(LAST_SENTENCE), F.regexp_extract(text, LAST_SENTENCE, k)).otherwise(text)
    return [part(1).alias("question"), part(2).alias("answer")]


class Index:
    """Postings of the items that ask for passages of ``size`` words, ready to be queried."""

    def __init__(self, items: list[tuple], idf: dict[bytes, float], mean: float, size: int):
        self.size, self.ids, self.parts = size, [], []
        by_term: dict[bytes, list] = {}
        for number, (item, question, answer) in enumerate(items):
            q, a = tokens(question), tokens(answer)
            self.ids.append(item)
            self.parts.append((shingles(q), shingles(a)))
            found = q + (a if answer != question else [])
            norm = K1 * (1 - B + B * len(found) / mean)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(found).items()}
            full = sum(impact.values())
            for t, w in impact.items():
                by_term.setdefault(t, []).append((number, w / full))
        self.number = {t: k for k, t in enumerate(by_term)}
        self.lists = []
        first, block, high = [0], [], []
        for found in by_term.values():
            tops: dict[int, float] = {}
            for item, impact in found:
                tops[item // BLOCK] = max(tops.get(item // BLOCK, 0.0), impact)
            self.lists.append(([d for d, _ in found], [w for _, w in found], tops))
            block += tops
            high += tops.values()
            first.append(len(block))
        # The same block maxima of all terms, end to end.
        self.first, self.block, self.high = np.array(first), np.array(block, np.int64), np.array(high)
        self.blocks = -(-len(items) // BLOCK)

    def hopeful(self, terms: np.ndarray, passage: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(passage, block) pairs whose block maxima add up to ``least``; terms are distinct within a passage."""
        out = []
        step = max(1, CELLS // self.blocks)
        for low in range(0, int(passage[-1]) + 1 if len(passage) else 0, step):
            a, b = np.searchsorted(passage, [low, low + step])
            t = terms[a:b]
            n = self.first[t + 1] - self.first[t]
            at = np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(passage[a:b] - low, n) * self.blocks + self.block[at]
            bound = np.bincount(cell, self.high[at])
            out += [(low + int(c) // self.blocks, int(c) % self.blocks) for c in np.flatnonzero(bound >= least - 1e-6)]
        return out

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """The block's items that score at least ``least``, by WAND with the block's maxima as bounds."""
        least -= 1e-9
        begin, end = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            docs, _, tops = self.lists[t]
            if block in tops:
                k = bisect_left(docs, begin)
                cursors.append([docs[k], k, tops[block], t])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] == item:
                score = sum(self.lists[c[3]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                item += 1
            for c in cursors[: pivot + 1]:
                docs = self.lists[c[3]][0]
                c[1] = bisect_left(docs, item, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) and docs[c[1]] < end else end
            cursors = [c for c in cursors if c[0] < end]
        return out

    def matches(self, found: list[list[bytes]], least: float, overlap: float, out: list[dict]) -> None:
        """Adds for each text (its tokens) and each item id that some passage holds: largest score, question and answer overlap."""
        size, step = self.size, self.size // 2
        get = self.number.get
        term = np.fromiter((get(t, -1) for f in found for t in f), np.int64)
        lengths = np.array([len(f) for f in found], np.int64)
        # Passage p of a text starts at its word p * step; a word lies in its own step's passage and the one before.
        counts = np.maximum(1, -(-(lengths - step) // step))
        offset = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(found)), lengths)
        own = (np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // step
        passage, words = [], []
        for back in (0, 1):
            p = own - back
            ok = (term >= 0) & (p >= 0) & (p < counts[text])
            passage.append(offset[text[ok]] + p[ok])
            words.append(term[ok])
        key = np.unique(np.concatenate(passage) * len(self.number) + np.concatenate(words)) if self.number else np.zeros(0, np.int64)
        passage, words = key // max(1, len(self.number)), key % max(1, len(self.number))
        for p, block in self.hopeful(words, passage, least):
            a, b = np.searchsorted(passage, [p, p + 1])
            hits = self.search(words[a:b].tolist(), block, least)
            if not hits:
                continue
            k = int(np.searchsorted(offset, p, "right")) - 1
            start = (p - int(offset[k])) * step
            piece = found[k][start : start + size]
            held = shingles(piece)
            for item, score in hits:
                q, a = (self._share(x, held, piece) for x in self.parts[item])
                if q >= overlap and a >= overlap:
                    best = out[k].get(self.ids[item], (0.0, 0.0, 0.0))
                    out[k][self.ids[item]] = tuple(map(max, best, (score, q, a)))

    @staticmethod
    def _share(part: set, own: set, passage: list[bytes]) -> float:
        if not part:
            return 0.0
        if len(part) == 1 and len(one := next(iter(part))) < SHINGLE:
            return float(any(tuple(passage[k : k + len(one)]) == one for k in range(len(passage))))
        return len(part & own) / len(part)


def shards(items: DataFrame, id_col: str, question_col: str, answer_col: str) -> Iterator[list[Index]]:
    """The items' inverted indexes, a shard at a time, so the driver holds one."""
    part = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = written(items.select(F.col(f"`{id_col}`").cast("long").alias("item"), part(question_col).alias("q"), part(answer_col).alias("a")).distinct())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(q) + (tokens(a) if a != q else []) for q, a in zip(b.column("q").to_pylist(), b.column("a").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array([list(set(f)) for f in found], pa.list_(pa.binary())), pa.array([len(f) for f in found], pa.int64())], names=["item", "terms", "len"])

    terms = rows.mapInArrow(split, "item long, terms array<binary>, len long")
    sums = rows.agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("q") + F.octet_length("a")).alias("bytes")).first()
    mean = terms.where("len > 0").agg(F.avg("len")).first()[0]
    if not mean:
        return
    count = -(-sums.bytes // SHARD_BYTES)
    shard = F.pmod(F.xxhash64("item"), F.lit(count))
    frequent = written(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for k in range(count):
        own = rows.where(shard == k).collect()
        known = frequent if count == 1 else frequent.join(terms.where(shard == k).select(F.explode("terms").alias("term")).distinct(), "term")
        idf = {bytes(r.term): float(np.log(1 + (sums.items - r.df + 0.5) / (r.df + 0.5))) for r in known.collect()}
        by_size: dict[int, list] = {}
        for r in sorted(own, key=lambda r: (r.item is not None, r.item or 0, r.q, r.a)):
            by_size.setdefault(passage_words(len(tokens(r.q)) + len(tokens(r.a))), []).append((r.item, r.q, r.a))
        yield [Index(found, idf, mean, size) for size, found in by_size.items()]


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """One row for each text and item that it holds: ``_row``, item_id, score, question_overlap, answer_overlap."""
    bounded_batches(docs.sparkSession)
    framed = docs.select(packed(docs, keep=keep), F.col(f"`{text_col}`").alias("_text"))
    schema = f"_row {framed.schema['_row'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for indexes in shards(items, item_col, question_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)  # of about SHARD_BYTES of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text, begin = b.column("_text"), 0
                lengths = pc.fill_null(pc.binary_length(text), 0).to_pylist()
                while begin < len(lengths):
                    end, size = begin, 0
                    while end < len(lengths) and (size < SLICE_BYTES or end == begin):
                        size += lengths[end]
                        end += 1
                    own = [tokens(t) for t in text.slice(begin, end - begin).to_pylist()]
                    best: list[dict] = [{} for _ in own]
                    for index in shared.value:
                        index.matches(own, MIN_SCORE, MIN_OVERLAP, best)
                    rows = [(k, item, *x) for k, x in enumerate(best, begin) for item, x in x.items()]
                    if rows:
                        at, item, *values = zip(*rows)
                        yield pa.RecordBatch.from_arrays([b.column("_row").take(pa.array(at, pa.int32())), pa.array(item, pa.int64()), *(pa.array(c, pa.float64()) for c in values)], names=["_row", "item_id", "score", "question_overlap", "answer_overlap"])
                    begin = end

        part = framed.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], framed.select("_row").schema.add("item_id", "long").add("score", "double").add("question_overlap", "double").add("answer_overlap", "double"))


def _sql() -> str:
    """The same results in plain SQL: every passage against every item by its terms, without index or bounds."""
    words = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    threes = lambda c: (
        f"list_distinct(CASE WHEN len({c}) >= 3 THEN list_transform(range(1, len({c}) - 1), lambda i: {c}[i] || ' ' || {c}[i + 1] || ' ' || {c}[i + 2])"
        f" WHEN len({c}) > 0 THEN [array_to_string({c}, ' ')] ELSE []::VARCHAR[] END)"
    )
    share = lambda c, own: (
        f"CASE WHEN len({c}) = 0 THEN 0.0 WHEN len({c}) < 3 THEN contains(said, ' ' || {own}[1] || ' ')::INT ELSE len(list_intersect({own}, held)) / len({own}) END"
    )
    part = lambda k: f"CASE WHEN regexp_matches(t, '{LAST_SENTENCE}') THEN regexp_extract(t, '{LAST_SENTENCE}', {k}) ELSE t END"
    return f"""
WITH qa AS (SELECT item_id, {part(1)} AS q, {part(2)} AS a FROM (SELECT item_id, trim(text) AS t FROM benchmark)),
items AS (SELECT DISTINCT item_id, coalesce(q, '') AS q, coalesce(a, '') AS a FROM qa),
two AS (SELECT *, {words("q")} AS tq, {words("a")} AS ta FROM items),
al AS (SELECT *, CASE WHEN a <> q THEN tq || ta ELSE tq END AS tt, greatest({PASSAGE}, CASE WHEN len(tq) + len(ta) > 1 THEN 2 << length(bin(len(tq) + len(ta) - 1)) ELSE 0 END) AS size FROM two),
tf AS (SELECT item_id, q, a, size, len(tt) AS n, t, count(*) AS tf FROM (SELECT item_id, q, a, size, tt, unnest(tt) AS t FROM al) GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM items) AS items, (SELECT avg(len(tt)) FROM al WHERE len(tt) > 0) AS mean),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
im AS (SELECT item_id, q, a, size, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / mean)) AS w FROM tf JOIN df USING (t), st),
re AS (SELECT *, w / sum(w) OVER (PARTITION BY item_id, q, a) AS part FROM im),
sh AS (SELECT item_id, q, a, tq, ta, {threes("tq")} AS sq, {threes("ta")} AS sa FROM al),
w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
pa AS (SELECT doc_id, size, p, list_slice(ws, p * step + 1, p * step + size) AS piece FROM (
  SELECT doc_id, ws, size, step, unnest(range(0, greatest(1, ceil((len(ws) - step) / step)::BIGINT))) AS p FROM w, (SELECT DISTINCT size, size // 2 AS step FROM al))),
sc AS (SELECT doc_id, size, p, item_id, q, a, sum(part) AS score FROM (SELECT doc_id, size, p, unnest(list_distinct(piece)) AS t FROM pa) JOIN re USING (t, size) GROUP BY ALL HAVING sum(part) >= {MIN_SCORE} - 1e-9),
hi AS (SELECT sc.*, piece, tq, ta, sq, sa, {threes("piece")} AS held, ' ' || array_to_string(piece, ' ') || ' ' AS said FROM sc JOIN pa USING (doc_id, size, p) JOIN sh USING (item_id, q, a)),
ov AS (SELECT doc_id, item_id, score, {share("tq", "sq")} AS oq, {share("ta", "sa")} AS oa FROM hi)
SELECT doc_id, item_id, round(max(score), 6) AS score, round(max(oq), 6) AS question_overlap, round(max(oa), 6) AS answer_overlap
FROM ov WHERE oq >= {MIN_OVERLAP} AND oa >= {MIN_OVERLAP} GROUP BY doc_id, item_id
"""


SQL = _sql()

"""Boxes on pages, in thousandths of the page: arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import text as T

SPAN = 1000.0


def normalized_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in points as thousandths, cut to the page; null if flat, off the page or not finite."""
    scale = lambda v, size: F.least(F.greatest(v / size * SPAN, F.lit(0.0)), F.lit(SPAN))
    box = F.struct(scale(x0, width).alias("x0"), scale(y0, height).alias("y0"), scale(x1, width).alias("x1"), scale(y1, height).alias("y1"))
    finite = ~(F.isnan(x0) | F.isnan(y0) | F.isnan(x1) | F.isnan(y1))
    return F.when(finite & (width > 0) & (height > 0) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def quad_points(box: Column) -> Column:
    """Eight numbers, corners from the upper left, with y upwards."""
    top, bottom = SPAN - box["y0"], SPAN - box["y1"]
    return F.array(box["x0"], top, box["x1"], top, box["x0"], bottom, box["x1"], bottom)


def area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def wide(box: Column) -> Column:
    return box["x1"] - box["x0"]


def overlap(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def sub_rect(box: Column, start: Column, end: Column, length: Column) -> Column:
    """The part of a one-line box between two character offsets."""
    wide = box["x1"] - box["x0"]
    return F.struct((box["x0"] + wide * start / length).alias("x0"), box["y0"].alias("y0"), (box["x0"] + wide * end / length).alias("x1"), box["y1"].alias("y1"))


def within(inner: Column, outer: Column, most: float = 0.2, side: float = 0.5) -> Column:
    """Whether a box lies in another but for a share ``most`` of its area, and for at most ``side`` of either side."""
    beyond = lambda low, high: F.greatest(F.lit(0.0), outer[low] - inner[low]) + F.greatest(F.lit(0.0), inner[high] - outer[high])
    wide, high = (F.greatest(F.lit(1e-9), inner[b] - inner[a]) for a, b in (("x0", "x1"), ("y0", "y1")))
    dx, dy = beyond("x0", "x1"), beyond("y0", "y1")
    return (dx <= wide * side) & (dy <= high * side) & ((dx * high + dy * wide) / (wide * high) <= most)


CHARS = "array<struct<text: string, x0: double, x1: double, top: double, bottom: double>>"


def quote_boxes(chars: Column, quote: Column, width: Column, height: Column) -> Column:
    """Boxes, in thousandths of the page, of every place where a page's characters (CHARS) say the quote on one line; white space does not count."""

    def places(w: Column) -> Column:
        n = F.length(w["q"])
        starts = F.when((n >= 2) & (F.size(w["solid"]) >= n) & (width > 0) & (height > 0), F.sequence(F.lit(0), F.size(w["solid"]) - n)).otherwise(F.array().cast("array<int>"))
        part = lambda v, size: F.least(F.greatest(v / size * SPAN, F.lit(0.0)), F.lit(SPAN))
        tall = lambda c: F.greatest(F.lit(0.1), c["bottom"] - c["top"])
        ends = F.transform(F.filter(starts, lambda i: (F.get(w["letters"], i) == w["first"]) & (F.substring(w["flat"], i + 1, n) == w["q"])), lambda i: F.struct(F.get(w["solid"], i).alias("a"), F.get(w["solid"], i + n - 1).alias("z")))
        level = F.filter(ends, lambda e: F.abs((e["z"]["top"] + e["z"]["bottom"]) / 2 - (e["a"]["top"] + e["a"]["bottom"]) / 2) <= (tall(e["a"]) + tall(e["z"])) / 2 + 1)
        return F.transform(
            level,
            lambda e: F.struct(
                part(e["a"]["x0"], width).alias("x0"), part(F.least(e["a"]["top"], e["z"]["top"]), height).alias("y0"), part(e["z"]["x1"], width).alias("x1"), part(F.greatest(e["a"]["bottom"], e["z"]["bottom"]), height).alias("y1")
            ),
        )

    # Characters are many and short: each is translated, and only places with the quote's first character are compared whole.
    said = F.transform(chars, lambda c: F.struct(F.translate(c["text"], T.BLANKS, "").alias("text"), *[c[k].alias(k) for k in ("x0", "x1", "top", "bottom")]))
    solid = F.filter(said, lambda c: c["text"] != "")
    flat = lambda x: F.array_join(F.transform(x, lambda c: c["text"]), "")
    given = lambda x, f, q: F.struct(x.alias("solid"), f.alias("flat"), F.split(f, "").alias("letters"), q.alias("q"), F.left(q, F.lit(1)).alias("first"))
    return T.let(solid, lambda x: T.let(flat(x), lambda f: T.let(given(x, f, T.useful(quote)), places)))


def refined(boxes: Column, span: Column | None = None, by=area) -> Column:
    """Of a quote's boxes the smallest that is not flat and lies in the span, if one is given; the first on ties, else null.

    Boxes of one height can be told apart ``by`` their width alone: a product rounds once more, which makes ties or breaks them.
    """
    fits = F.filter(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & (F.lit(True) if span is None else span.isNull() | within(b, span)))
    ranked = F.transform(fits, lambda b, i: F.struct(by(b).alias("size"), i.alias("i"), b.alias("box")))
    return F.array_min(ranked)["box"]


def covers_quote(boxes: Column, box: Column, least: float = 0.3) -> Column:
    """Whether a box overlaps one of the quote's by ``least`` of their union."""
    return F.exists(boxes, lambda b: iou(box, b) >= least)


def anchor(text: Column, quote: Column, line_box: Column, span_box: Column, block_box: Column, start: int = 1) -> Column:
    """Where a quote stands, from the best source there is: its part of a text line, a layout span, its block (degraded), or nowhere.

    The quote is sought from character ``start`` on; an empty one stands there.
    """
    at = F.when(quote == "", F.lit(start)).otherwise(F.position(quote, text, F.lit(start)))
    exact = F.when((at > 0) & line_box.isNotNull(), sub_rect(line_box, at - 1, at - 1 + F.length(quote), F.length(text)))
    precision = F.when(exact.isNotNull(), "exact").when(span_box.isNotNull(), "span").when(block_box.isNotNull(), "block").otherwise("unlocated")
    return F.struct(precision.alias("precision"), F.coalesce(exact, span_box, block_box).alias("rect"))


def shown_rects(rects: Column, page: Column, precision: Column) -> Column:
    """Rectangles to draw with their page; one whole-page placeholder if there are none or only the page is known."""
    number = F.coalesce(page, F.lit(1))
    whole = F.struct(number.alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(SPAN).alias("x1"), F.lit(SPAN).alias("y1"))
    drawn = F.transform(rects, lambda r: F.struct(number.alias("page"), *[r[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))
    return F.when((F.size(rects) <= 0) | (precision == "page"), F.array(whole)).otherwise(drawn)

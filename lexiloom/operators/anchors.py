"""Evidence anchors: where a quote stands in a document's layout spans, pages and blocks.

A span is (n, text, page, box): n is its place in the document, the box in thousandths of the page. A
document's spans travel as one array, so a quote is located by array functions within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import geometry as G
from lexiloom.functions import text as T
from lexiloom.sources.scratch import written

REACH, LEAST_PREFIX, BLOCK_PREFIX, SHORT_PREFIX = 15, 6, 8, 4
LARGE_SPAN = 0.7
SPACE = "normalized-1000-top-left"


def with_spans(rows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``spans``, the document's spans in order; an empty array where there are none."""
    held = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "text", "page", "box"))).alias("spans"))
    empty = F.array().cast(held.schema["spans"].dataType)
    return rows.join(held, key, "left").withColumn("spans", F.coalesce("spans", empty))


def located_in_block(spans: Column, block: Column, quote: Column) -> Column:
    """The span that holds a quote of a block, told apart from equal text elsewhere by what follows.

    The block begins at the span from which REACH spans in a row share the longest prefix with it. From
    there the quote's offset is counted on: the span that holds it whole, else the one it begins in.
    """
    none = F.lit(None).cast("int")

    def walk(w: Column) -> Column:
        at, size = F.position(w["q"], w["b"]) - 1, F.length(w["q"])
        place = F.aggregate(
            F.slice(w["flats"], F.greatest(w["first"], F.lit(1)), F.greatest(F.size(w["flats"]), F.lit(1))),
            F.struct(F.lit(0).alias("seen"), F.lit(0).alias("i"), none.alias("whole"), none.alias("begins")),
            lambda acc, x: F.struct(
                (acc["seen"] + F.length(x)).alias("seen"),
                (acc["i"] + 1).alias("i"),
                F.coalesce(acc["whole"], F.when((acc["seen"] <= at) & (at + size <= acc["seen"] + F.length(x)), acc["i"])).alias("whole"),
                F.coalesce(acc["begins"], F.when((acc["seen"] <= at) & (at < acc["seen"] + F.length(x)), acc["i"])).alias("begins"),
            ),
            lambda acc: F.coalesce(acc["whole"], acc["begins"]),
        )
        return F.when((w["q"] != "") & (at >= 0) & (w["most"] >= LEAST_PREFIX), w["first"] - 1 + place)

    def begin(w: Column) -> Column:
        # Texts are put together only where the first span may begin the block: any other prefix is too short to count.
        head = lambda x: F.left(x, F.lit(LEAST_PREFIX))
        shared = F.transform(w["flats"], lambda x, i: F.when(w["b"].startswith(head(x)) | head(x).startswith(w["b"]), T.common_prefix(w["b"], F.array_join(F.slice(w["flats"], i + 1, REACH), ""))).otherwise(F.lit(0)))
        return T.let(shared, lambda s: T.let(F.struct(w["flats"].alias("flats"), w["b"].alias("b"), w["q"].alias("q"), F.array_max(s).alias("most"), F.array_position(s, F.array_max(s)).cast("int").alias("first")), walk))

    given = F.struct(F.transform(spans, lambda s: T.useful(s["text"])).alias("flats"), T.useful(block).alias("b"), T.useful(quote).alias("q"))
    return F.get(spans, T.let(given, begin))


def span_of_quote(spans: Column, quote: Column, page: Column) -> Column:
    """The span whose text holds the quote and little else, on the page if it has one; held but for white space counts half; first on ties."""
    q = T.normalized(quote)
    flat = T.useful(q)

    def ratio(s: Column) -> Column:
        text = T.normalized(s["text"])
        loose = T.useful(text)
        return F.when(F.contains(text, q), F.length(q) / F.length(text)).when((F.length(flat) >= 2) & F.contains(loose, flat), 0.5 * (F.length(flat) / F.length(loose)))

    rated = F.transform(spans, lambda s, i: F.struct((s["page"] == page).alias("here"), ratio(s).alias("ratio"), (-i).alias("back"), s.alias("span")))
    return F.when(q != "", F.array_max(F.transform(F.filter(rated, lambda r: r["ratio"] > 0), lambda r: F.struct(F.coalesce(r["here"], F.lit(False)).alias("here"), r["ratio"], r["back"], r["span"])))["span"])


def block_pages(blocks: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each block's page: that of the span with the longest common prefix, at least BLOCK_PREFIX, or SHORT_PREFIX where one holds the other; the first on ties.

    Texts are compared once however often a document repeats them (of equal spans the first counts). Those that share BLOCK_PREFIX characters meet by
    these, and only blocks that find nothing there are sought by SHORT_PREFIX ones, among texts of which one begins with the other.
    """
    said = T.normalized("text")
    asked = blocks.select(key, "block_index", said.alias("said")).where("said <> ''").groupBy(key, "said").agg(F.collect_list("block_index").alias("blocks"))
    # Written, as both ways of meeting read them: else every line would be split and normalized again for each.
    known = written(spans.select(key, said.alias("span_said"), "n", "page").where("span_said <> ''").groupBy(key, "span_said").agg(F.min(F.struct("n", "page")).alias("at")), "spans")

    def met(some: DataFrame, size: int, seek: Column) -> DataFrame:
        """With ``at`` and ``span_said`` of the spans that share ``size`` characters, null if there are none or none is to be sought."""
        begins = lambda c: F.when(F.length(c) >= size, F.left(c, F.lit(size)))
        return some.withColumn("begins", F.when(seek, begins("said"))).join(known.withColumn("begins", begins("span_said")), [key, "begins"], "left").drop("begins")

    shared = T.common_prefix("said", "span_said")
    best = lambda held: F.min(F.when(held, F.struct((-shared).alias("less"), "at")))
    long = met(asked, BLOCK_PREFIX, F.lit(True)).groupBy(key, "said").agg(F.first("blocks").alias("blocks"), best(F.col("span_said").isNotNull()).alias("best"))
    held = F.contains("said", "span_said") | F.contains("span_said", "said")
    short = met(long, SHORT_PREFIX, F.col("best").isNull()).groupBy(key, "said").agg(F.first("blocks").alias("blocks"), F.first("best").alias("best"), best(held).alias("other"))
    found = short.withColumn("best", F.coalesce("best", "other")).where("best IS NOT NULL")
    return found.select(key, F.explode("blocks").alias("block_index"), F.col("best.at.page").alias("page"), (-F.col("best.less")).alias("shared"))


def enriched(precision: Column, quote: Column, span: Column, chars: Column, width: Column, height: Column, by=G.area) -> Column:
    """An anchor (precision, status, page, rect) from the span of its quote; null leaves the finding as it is.

    A span much longer than the quote is cut down to the quote's own characters, the smallest place ``by`` area or width. Where the page has
    characters and none of the quote's places lies under the box, only the page is given.
    """
    large = F.length(T.normalized(quote)) / F.greatest(F.lit(1), F.length(T.normalized(span["text"]))) < LARGE_SPAN

    def placed(w: Column) -> Column:
        missed = (F.size(chars) > 0) & ~G.covers_quote(w["boxes"], w["box"])
        rect = F.struct(F.lit("rect").alias("precision"), F.lit("exact").alias("status"), span["page"].alias("page"), w["box"].alias("rect"))
        degraded = F.struct(F.lit("page").alias("precision"), F.lit("degraded").alias("status"), span["page"].alias("page"), F.when(F.lit(False), w["box"]).alias("rect"))
        return F.when(precision.eqNullSafe(F.lit("rect")) | (quote == "") | span.isNull(), None).when(missed, degraded).otherwise(rect)

    cut = lambda b: F.coalesce(F.when(large, G.refined(b, span["box"], by)), span["box"])
    return T.let(G.quote_boxes(chars, quote, width, height), lambda b: T.let(F.struct(b.alias("boxes"), cut(b).alias("box")), placed))


def said_rect(text: Column, box: Column, quote: Column) -> Column:
    """The part of a one-line box that says the quote, by its share of the characters; white space counts only if the quote is there with it."""
    at, loose = F.position(quote, text), F.position(T.useful(quote), T.useful(text))
    exact = G.sub_rect(box, at - 1, at - 1 + F.length(quote), F.length(text))
    flat = G.sub_rect(box, loose - 1, loose - 1 + F.length(T.useful(quote)), F.length(T.useful(text)))
    return F.when((quote == "") | box.isNull(), None).when(at > 0, exact).when(loose > 0, flat)


def pdf_anchor(quote: Column, layer: Column, spans: Column, rects: Column, page: Column) -> Column:
    """Where a quote stands on its page: first text-layer record that says it, else its part of the first layout span, else its block's rectangles, else nowhere."""
    says = lambda r: (quote != "") & (F.contains(r["text"], quote) | F.contains(T.useful(r["text"]), T.useful(quote)))
    real = lambda b: b.isNotNull() & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    in_layer = F.get(F.filter(layer, lambda r: real(r["box"]) & says(r)), F.lit(0))
    in_span = F.get(F.filter(spans, lambda r: real(r["box"]) & says(r)), F.lit(0))
    own = F.filter(rects, real)
    one = lambda level, precision, p, found: F.struct(F.lit(level).alias("level"), F.lit(precision).alias("precision"), F.coalesce(p, page).alias("page"), found.alias("rects"))
    return (
        F.when(in_layer.isNotNull(), one("pdf_text_layer", "exact", in_layer["page"], F.array(in_layer["box"])))
        .when(in_span.isNotNull(), one("mineru_layout_span", "exact", in_span["page"], F.array(said_rect(in_span["text"], in_span["box"], quote))))
        .when(F.size(own) > 0, one("paragraph_bbox", "degraded", page, own))
        .otherwise(one("unlocated", "unlocated", page, F.slice(own, 1, 0)))
    )


def docx_range(text: Column, quote: Column) -> Column:
    """A quote's code points in a paragraph; where it is not said, as many from the beginning."""
    at = F.position(quote, text) - 1
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(quote)).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.least(F.length(text), F.length(quote)).alias("end")))


def chosen_block(blocks: Column, quote: Column, index: Column, block_id: Column) -> Column:
    """The 0-based block of a quote: by index, by id, the first that says it, the first."""
    place = lambda hit: F.array_position(F.transform(blocks, hit), F.lit(True)) - 1
    by_id, by_text = place(lambda b: F.coalesce((b["block_id"] == block_id) & (block_id != ""), F.lit(False))), place(lambda b: (quote != "") & F.contains(b["text"], quote))
    return F.when((index >= 0) & (index < F.size(blocks)), index.cast("long")).when(by_id >= 0, by_id).when(by_text >= 0, by_text).otherwise(F.lit(0).cast("long"))


def normalized_anchor(kind: Column, precision: Column, rects: Column, page: Column, start: Column, end: Column, quote: Column) -> Column:
    """An anchor in the one form that clients get: exact or page for pages, a range for word-processor files (the default kind)."""
    pdf = F.struct(
        F.lit("pdf").alias("kind"), F.when(F.size(rects) > 0, "exact").otherwise("page").alias("precision"), F.when(precision == "exact", "valid").otherwise("degraded").alias("status"),
        F.coalesce(page, F.lit(1)).alias("page"), F.lit(SPACE).alias("space"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )
    docx = F.struct(
        F.lit("docx").alias("kind"), F.coalesce(precision, F.lit("exact")).alias("precision"), F.lit("valid").alias("status"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("space"), F.coalesce(start, F.lit(0)).alias("start"), F.coalesce(end, F.greatest(F.lit(1), F.length(quote))).alias("end"),
    )
    return F.when(kind == "pdf", pdf).otherwise(docx)

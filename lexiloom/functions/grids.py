"""Tables in texts: detection, grids (array of rows of cells), HTML and Markdown forms."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import col, let, stripped

GRID = "array<array<string>>"


def has_html_table(c) -> Column:
    return col(c).rlike(r"(?i)<\s*/?\s*table\b")


def _lines(c) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda x: F.trim(x))


def is_separator(line: Column) -> Column:
    return F.forall(_cells(line), lambda x: x.rlike(r"^:?-{3,}:?$"))


def has_markdown_table(c) -> Column:
    """At least three lines, a piped header and a separator below it."""
    return let(_lines(c), lambda lines: (F.size(lines) >= 3) & F.contains(F.get(lines, F.lit(0)), F.lit("|")) & F.coalesce(is_separator(F.get(lines, F.lit(1))), F.lit(False)))


def markdown_grid(c) -> Column:
    """Rows of a piped table without separators and blank rows, padded to one width; null below two rows."""
    rule = lambda x: F.forall(_cells(x), lambda c: c.rlike(r"^:?-{3,}:?$") | (c == ""))
    rows = F.transform(F.filter(_lines(c), lambda x: F.contains(x, F.lit("|")) & ~rule(x)), _cells)
    rows = F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))
    padded = lambda rows: let(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    return let(rows, lambda rows: F.when(F.size(rows) >= 2, padded(rows)))


def grid_markdown(g) -> Column:
    """A piped table with a separator below its first row."""
    g = col(g)
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.regexp_replace(F.replace(x, F.lit("|"), F.lit("\\|")), "\n", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(g, F.lit(0)))), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(F.get(g, F.lit(0))), rule), F.transform(F.slice(g, 2, F.greatest(F.lit(1), F.size(g))), row)), "\n")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def grid_html(g) -> Column:
    g = col(g)
    row = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), escaped(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(g, 2, F.greatest(F.lit(1), F.size(g))), row("td")), "")
    return F.concat(F.lit("<table><thead>"), row("th")(F.get(g, F.lit(0))), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))


def is_grid(g) -> Column:
    """At least two rows of at least two cells."""
    return F.coalesce((F.size(col(g)) >= 2) & (F.array_min(F.transform(col(g), lambda r: F.size(r))) >= 2), F.lit(False))


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def _read_grid(text: str | None):
    if not text:
        return None
    p = _Table()
    p.feed(text)
    rows = [r for r in p.rows if r]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows] if len(rows) >= 2 else None


def html_grid(c) -> Column:
    """Cells of an HTML table; only texts that hold one go through Python."""

    @F.pandas_udf(GRID)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(_read_grid)

    return F.when(has_html_table(c), read(F.when(has_html_table(c), col(c))))


def normalized_grid(html_col, markdown_col, text_col) -> Column:
    """The grid of the first form that gives one: HTML, Markdown, plain text; the last two may hold HTML as well."""
    either = lambda c: F.coalesce(html_grid(c), F.when(~F.coalesce(has_html_table(c), F.lit(False)), markdown_grid(c)))
    return F.coalesce(html_grid(html_col), either(markdown_col), either(text_col))


def plain_html_markdown(c) -> Column:
    """An HTML table as Markdown by patterns alone, without a parser: simple tables stay JVM-side."""
    rows = F.regexp_extract_all(col(c), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " ")))
    return grid_markdown(F.transform(rows, cells))


def appendix(tables) -> Column:
    """A Markdown appendix of tables (filename, section, markdown) with their sources; empty without tables."""
    source = lambda t: F.concat(t["filename"], F.when(t["section"] != "", F.concat(F.lit(" · "), t["section"])).otherwise(""))
    part = lambda t: F.concat(F.lit("\n> 来源："), source(t), F.lit("\n\n"), F.trim(t["markdown"]), F.lit("\n"))
    return F.when(F.size(col(tables)) > 0, F.concat(F.lit("\n\n---\n\n## 原文表格\n"), F.array_join(F.transform(col(tables), part), ""))).otherwise("")


def tables_of_hits(hits: DataFrame, query: str, rank: str, most: int) -> DataFrame:
    """For each query the first ``most`` distinct tables of its hits (kind, content, markdown), with the rank of the hit that has each first.

    A table hit gives its Markdown, any other what its content holds, as Markdown or HTML, without header
    lines; what is no grid of two by two is none. A hit's table is worked out once: a filter on it would be moved
    below and take the whole expression along, wherever it uses the table, so hits without one are left out at the end.
    """
    content, markdown = F.coalesce("content", F.lit("")), F.nullif("markdown", F.lit(""))
    bare = F.trim(F.regexp_replace(content, r"(?m)^\s*\[(文档|章节)\][^\n]*\n?", ""))
    said = hits.select(query, rank, "kind", content.alias("content"), F.coalesce(markdown, content).alias("given"), bare.alias("bare"))
    read = said.withColumns({"html": html_grid("content"), "bare_html": html_grid("bare")})
    of_table = F.when(has_markdown_table("given") | ~has_markdown_table("bare"), F.col("given")).otherwise(F.col("bare"))
    of_html = F.coalesce(*[F.when(F.col(c).isNotNull(), grid_markdown(c)) for c in ("html", "bare_html")])
    of_text = F.when(has_markdown_table("content"), F.col("content")).when(has_markdown_table("bare"), F.col("bare")).otherwise(of_html)
    said = stripped(F.when(F.lower("kind") == "table", of_table).otherwise(of_text))
    found = read.select(query, rank, let(said, lambda m: F.when(let(markdown_grid(m), is_grid), m)).alias("markdown"))
    first = found.groupBy(query, "markdown").agg(F.min(rank).alias(rank))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.col("markdown").isNull(), rank))).where((F.col("_n") <= most) & F.col("markdown").isNotNull()).drop("_n")

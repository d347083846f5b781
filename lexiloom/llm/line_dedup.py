"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text form a window. Windows are hashed (MD5, 128 bits, so that
collisions stay negligible at 10^12 windows), and a window that starts anywhere else first - in a
smaller (doc_id, text digest) or earlier in the same text - is a later occurrence. The lines that
later occurrences cover are merged and removed; everything else stays byte for byte.

Defined results for odd rows
* null text: stays null, no lines; empty text: one blank line, kept.
* texts of fewer than three lines have no window and stay whole.
* windows of three blank lines never count as repeats.
* rows with equal doc_id and equal text are one document: they get the same result.
* rows with equal doc_id and different text are told apart by the text's digest; a null doc_id
  sorts before every other.
* an empty table gives an empty result; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``_row`` (the input row as a struct), ``kept_text``, ``n_lines`` and ``n_removed``.

    Plan: one narrow pass makes (digest, doc, position) rows; a map-side combined aggregate finds
    each repeated window's first place; the join back is split by AQE when one window is hot; a
    last join on the document brings covered positions to the text.
    """
    key = [F.col(f"`{id_col}`").alias("_id"), F.md5(F.col(f"`{text_col}`").cast("binary")).alias("_key")]
    line = lambda i, k: F.get("_lines", i + k)
    digest = lambda i: F.when(
        F.length(F.trim(F.concat(line(i, 0), line(i, 1), line(i, 2)))) > 0,
        F.unhex(F.md5(F.concat_ws("\n", line(i, 0), line(i, 1), line(i, 2)).cast("binary"))),
    )
    windows = (
        docs.select(*key, F.split(F.col(f"`{text_col}`"), "\n", -1).alias("_lines"))
        .where(F.size("_lines") >= WINDOW)
        .select("_id", "_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), digest)).alias("_pos", "_window"))
        .where(F.col("_window").isNotNull())
    )
    place = F.struct("_id", "_key", "_pos")
    repeated = windows.groupBy("_window").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last").select("_window", "_first")
    covered = (
        windows.join(repeated, "_window")
        .where(~place.eqNullSafe(F.col("_first")))
        .groupBy("_id", "_key")
        .agg(F.collect_set("_pos").alias("_starts"))
        .withColumnsRenamed({"_id": "_cid", "_key": "_ckey"})
    )
    # The text goes through this join once, in its row, and is cut into lines again behind it.
    joined = docs.select(packed(docs), *key).join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_key") == F.col("_ckey")), "left")
    joined = joined.select("_row", "_starts", F.split(F.col("_row").getField(text_col), "\n", -1).alias("_lines"))
    removed = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), removed)
    return joined.select(
        "_row",
        F.when(F.col("_starts").isNull(), F.concat_ws("\n", "_lines")).otherwise(F.concat_ws("\n", F.transform(kept, lambda p: F.get("_lines", p)))).alias("_kept"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_starts").isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
        F.col("_lines").isNull().alias("_null"),
    ).select("_row", F.when(~F.col("_null"), F.col("_kept")).alias("kept_text"), "n_lines", "n_removed")


SQL = """
WITH base AS (SELECT doc_id, text, md5(text) AS k, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, k, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) - 1)) AS i FROM base WHERE len(ls) >= 3)
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, k, pos) AS rn
  FROM w WHERE length(trim(replace(win, chr(10), ''), ' ')) > 0
),
c AS (SELECT DISTINCT doc_id, k, pos + o AS pos FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE rn > 1),
l AS (SELECT doc_id, k, text, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM base)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS kept_text,
       count(*)::BIGINT AS n_lines, count(c.pos)::BIGINT AS n_removed
FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.k = c.k AND l.pos = c.pos
GROUP BY l.doc_id, l.k
"""

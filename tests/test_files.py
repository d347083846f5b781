"""Files, shapes and sinks that the driver's tables do not hold."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import findings as Fd
from lexiloom.sources import files as Fi

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_docx(spark, tmp_path):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = p("Title", "Heading1") + p("") + p("words") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    got = [tuple(r)[1:] for r in Fi.docx_blocks(spark, str(tmp_path)).orderBy("block_index").collect()]
    assert got == [(0, "docx-p-000000", "heading", 1, "Title"), (1, "docx-p-000001", "paragraph", None, "words"), (2, "docx-p-000002", "table", None, "| a | b |\n| 1 | 2 |")]


def test_words_join_the_first_word_of_their_line(spark):
    rows = spark.createDataFrame([([(10.0, 5.0, "b"), (10.0, 1.0, "a"), (11.9, 9.0, "c"), (12.5, 0.0, "d"), (14.4, 1.0, "e")],), ([],)], "w array<struct<top: double, x0: double, text: string>>")
    assert [r.x for r in rows.select(Fi.word_lines(F.col("w")).alias("x")).collect()] == [["a b c", "d e"], []]


def test_index_is_replaced_by_document(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda data: spark.createDataFrame(data, "doc_id long, chunk string")
    assert Fi.write_index(rows([(1, "a"), (1, "b"), (2, "c")]), path, ["doc_id"]) == 3
    assert Fi.write_index(rows([(1, "z")]), path, ["doc_id"]) == 1
    assert sorted((r.doc_id, r.chunk) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


@pytest.mark.parametrize("said, want", [('{"answer": "a\\nb", "x": 1}', "a\nb"), ('{"answer":"half', "half"), ('{"answer":"', None), ("none", None), ('{"answer":"x\\', "x")])
def test_partial_answers(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(T.partial_answer("t").alias("x")).first().x == want


def test_best_spans(spark):
    quotes = spark.createDataFrame([(1, 1, "the long common beginning"), (1, 2, "holds four"), (1, 3, "nothing")], "doc_id long, quote_id long, quote string")
    spans = spark.createDataFrame([(1, 1, "the long other"), (1, 2, "the long common end"), (1, 3, "four")], "doc_id long, span_id long, span_text string")
    assert sorted((r.quote_id, r.span_id) for r in Fd.best_spans(quotes, spans, "doc_id").collect()) == [(1, 2), (2, 3)]


def test_embedding_batches_retries_and_asks_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def service(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        with open(log) as f:
            if len(f.readlines()) == 1:
                raise RuntimeError("try again")
        return [[len(t)] for t in texts]

    rows = spark.createDataFrame([(i, f"text {i % 25}") for i in range(100)] + [(100, None)], "id long, text string").coalesce(1)
    got = {r.id: r.vector for r in Fi.embedded(rows, "text", service, batch=10, wait=0.01).collect()}
    assert got == {**{i: [float(len(f"text {i % 25}"))] for i in range(100)}, 100: [0.0]}
    sizes = [int(x) for x in open(log).read().split()]
    assert max(sizes) <= 10 and sum(sizes[1:]) == 26  # 25 texts and the empty one, each once; the first call failed
    with pytest.raises(Exception, match="never"):
        Fi.embedded(rows, "text", lambda texts: (_ for _ in ()).throw(RuntimeError("never")), retries=1, wait=0.01)


def test_unsafe_names_are_not_restored(spark):
    names = ["a/b.txt", "../a", "a/../b", "/etc/x", "C:/x", "a\\..\\b", "", "a..b/c"]
    files = spark.createDataFrame([(n, bytearray(b"x")) for n in names], "name string, content binary")
    listed = files.selectExpr("name", "sha2(content, 256) AS sha256")
    assert {r.name for r in Fi.restorable(files, listed).collect() if r.state == "ok"} == {"a/b.txt", "a..b/c"}

import io
import zipfile

import pytest

from lexiloom.sources import docx_source, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture()
def folder(spark, tmp_path):
    docx_source.register(spark)
    (tmp_path / "sub").mkdir()
    for k in range(6):
        (tmp_path / ("sub" if k % 2 else ".") / f"f{k}.docx").write_bytes(docx(("Heading1", f"title {k}"), ("Body", "text"), ("Body", " ")))
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(20):
            z.writestr(f"in/z{k}.docx", docx(("Body", f"zipped {k}")))
        z.writestr("in/readme.txt", "no")
    (tmp_path / "other.txt").write_text("no")
    return str(tmp_path)


def test_files_and_archives(spark, folder):
    got = spark.read.format("docx").load(folder)
    rows = {(r.doc_id, r.block_index, r.locator, r.type, r.level, r.text) for r in got.collect()}
    want = {(f"f{k}.docx", i, f"docx-p-{i:06d}", *b) for k in range(6) for i, b in enumerate([("heading", 1, f"title {k}"), ("paragraph", None, "text")])}
    assert rows == want | {(f"z{k}.docx", 0, "docx-p-000000", "paragraph", None, f"zipped {k}") for k in range(20)}
    plain = {(r.doc_id, r.block_index, r.text) for r in files.docx_blocks(spark, folder).collect()} | {(r.doc_id, r.block_index, r.text) for r in files.docx_blocks(spark, folder + "/sub").collect()}
    assert {(a, b, f) for a, b, _, _, _, f in want} == plain
    small = spark.read.format("docx").option("partitionBytes", 1000).load(folder)
    assert small.rdd.getNumPartitions() > 3 and small.count() == got.count()
    assert got.rdd.getNumPartitions() == 1


def test_columns_and_filters(spark, folder):
    ids = spark.read.format("docx").schema("doc_id string").load(folder)
    assert ids.columns == ["doc_id"] and ids.count() == 26  # one row a file: nothing is parsed
    some = spark.read.format("docx").load(folder).where("doc_id IN ('f1.docx', 'z3.docx') AND type = 'paragraph'")
    assert sorted(r.text for r in some.collect()) == ["text", "zipped 3"]
    with pytest.raises(Exception, match="gives no column"):
        spark.read.format("docx").schema("size long").load(folder).collect()


def test_broken_files(spark, folder):
    with open(f"{folder}/bad.docx", "wb") as f:
        f.write(b"not a file of that kind")
    with pytest.raises(Exception, match=r"bad\.docx cannot be read"):
        spark.read.format("docx").load(folder).collect()
    bad = spark.read.format("docx").option("mode", "permissive").load(folder).where("error IS NOT NULL").collect()
    assert [(r.doc_id, r.block_index, r.text) for r in bad] == [("bad.docx", None, None)] and "zip" in bad[0].error.lower()


def test_empty_folder(spark, tmp_path):
    docx_source.register(spark)
    assert spark.read.format("docx").load(str(tmp_path)).count() == 0

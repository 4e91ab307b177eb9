"""The data source of document files."""

import io
import zipfile

import pytest

from clauselake.sources import document_source, files, records


def word_file(body, **parts):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            tag = "hdr" if name.startswith("header") else "ftr"
            z.writestr(f"word/{name}.xml", f"<w:{tag} {space}>{text}</w:{tag}>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_files():
    table = f"<w:tbl><w:tr><w:tc>{p('x')}{p('y')}</w:tc><w:tc>{p(' ')}</w:tc><w:tc>{p('z')}</w:tc></w:tr></w:tbl>"
    data = word_file(p("one ") + table + p(" ") + "<w:p><w:r><w:t>two</w:t><w:tab/><w:t>2</w:t><w:br/><w:t>b</w:t></w:r></w:p>", footer1=p("foot"), header1=p("head"), header2=p(""))
    assert files.docx_text(data) == "one\ntwo\t2\nb\nx\ny | z\nhead\nfoot"
    assert files.docx_text(files.docx_bytes(["a <b> & c", "", "  d "])) == "a <b> & c\nd"


def test_packing_by_bytes():
    got = document_source.packed([("a", 5), ("b", 1), ("c", 50), ("d", 200), ("e", 0), ("f", 0)], 100, 10)
    assert [x.paths for x in got] == [("a", "b", "c"), ("d",), ("e", "f")] and document_source.packed([], 100, 10) == []


def test_document_source(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in {"a.txt": "héllo\n".encode(), "b.MD": b"  \n", "deep/c.docx": word_file(p("clause")), "d.docx": b"no archive", "e.pdf": b"%PDF", "f.exe": b"x", "plain": b"\xff text", ".hidden": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    spark.dataSource.register(document_source.DocumentSource)
    rows = spark.read.format("clause_documents").option("partition_bytes", 10).option("open_bytes", 10).load(f"file://{tmp_path}/in")
    want = [("a.txt", "héllo\n", "raw"), ("b.MD", "", "error"), ("c.docx", "clause", "paragraphs"), ("d.docx", "", "error"), ("e.pdf", "", "error"), ("plain", "� text", "raw")]
    assert sorted((r["source"], r["text"], r["method"]) for r in rows.collect()) == want and {r["page_idx"] for r in rows.collect()} == {0}
    assert rows.rdd.getNumPartitions() == 6
    (tmp_path / "none").mkdir()
    assert spark.read.format("clause_documents").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="absent"):
        spark.read.format("clause_documents").load(str(tmp_path / "absent")).collect()
    with pytest.raises(ValueError):
        document_source.local("s3://bucket/x")


def test_index_tables(spark, tmp_path):
    units = spark.createDataFrame([("1", "t", 2, ["a", "b"])], records.UNITS)
    docs = spark.createDataFrame([(1, "a", 5, 1, 2, "h")], records.MANIFEST)
    records.save_index(docs, units, units.limit(0), str(tmp_path / "i"))
    documents, sections, sentences = records.load_index(spark, str(tmp_path / "i"))
    assert documents.collect() == docs.collect() and sections.collect() == units.collect() and sentences.count() == 0
    assert [x.count() for x in records.load_index(spark, str(tmp_path / "absent"))] == [0, 0, 0]

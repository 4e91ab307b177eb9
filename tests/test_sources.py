"""Files, records, streams, training, and the query registry."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clauselake.operators import features, ground, index
from clauselake.plans import overlay, queries, train
from clauselake.sources import files, records
from clauselake.streaming import ingest


def docx(*lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('k')}</w:tc><w:tc>{p('v')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, lines))}{table}</w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{p("head")}</w:hdr>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    made = {"a.txt": b"plain \xff text", "b.TXT": b" \n", "c.md": b"# t", "noext": b"bare", "d.docx": docx("one", "two"), "bad.docx": b"no zip", "e.pdf": b"PDF", "f.png": b"PNG", "g.exe": b"?"}
    (tmp_path / "sub").mkdir()
    for name, data in made.items():
        (tmp_path / "sub" / name).write_bytes(data)

    def pdf(data):
        return [("a long text layer that is certainly over forty characters", ""), ("short", "seen"), ("short", ""), ("", "")]

    pages, rejected = files.read_documents(spark, str(tmp_path), pdf=pdf)
    got = {(r["source"], r["page_idx"]): (r["method"], r["text"]) for r in pages.collect()}
    assert got["a.txt", 0] == ("raw", "plain � text") and got["b.TXT", 0] == ("error", "") and got["c.md", 0][0] == got["noext", 0][0] == "raw"
    assert got["d.docx", 0] == ("paragraphs", "one\ntwo\nk | v\nhead") and got["bad.docx", 0] == ("error", "") and got["f.png", 0] == ("error", "")
    assert [got["e.pdf", i][0] for i in range(4)] == ["text", "ocr", "text", "error"] and [r["path"].rsplit("/", 1)[-1] for r in rejected.collect()] == ["g.exe"]


def test_documents_without_bytes(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    folder.mkdir()
    for name, data in {"1.txt": b"", "2 +%2B.txt": b"", "3.docx": b"", "4.pdf": b"", "5.exe": b"", "6+ 7.txt": b"full", "_metadata": b"x", "_own.txt": b"", ".hidden.txt": b""}.items():
        (folder / name).write_bytes(data)
    pages, rejected = files.read_documents(spark, str(tmp_path))
    assert {(r["source"], r["page_idx"], r["text"], r["method"]) for r in pages.collect()} == {
        ("1.txt", 0, "", "error"), ("2 +%2B.txt", 0, "", "error"), ("3.docx", 0, "", "error"), ("4.pdf", 0, "", "error"), ("6+ 7.txt", 0, "full", "raw")
    }
    assert pages.count() == 5 and {r["path"] for r in pages.collect()} == {f"file:{folder}/{n}" for n in ("1.txt", "2 +%2B.txt", "3.docx", "4.pdf", "6+ 7.txt")}
    assert [(r["path"].rsplit("/", 1)[-1], r["length"]) for r in rejected.collect()] == [("5.exe", 0)]
    (tmp_path / "none").mkdir()
    assert files.read_documents(spark, str(tmp_path / "none"))[0].count() == 0


def test_binary_documents_without_text(spark, tmp_path):
    rows = [(0, "even"), (1, "odd"), (2, ""), (3, ""), (4, None), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.binary_documents(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, "even", "paragraphs"), (1, 0, "odd", "raw")} | {(i, 0, "", "error") for i in (2, 3, 4, 5)}


def test_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"source": "a", "text": "t"}\n\n{"source": "b"}\n')
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    assert records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "source string, text string").count() == 2
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "source string").collect()
    assert records.read_jsonl(spark, str(tmp_path / "absent"), "source string", missing_ok=True).count() == 0
    (tmp_path / "c.csv").write_text('uuid,text\n1,"two\nlines, ""quoted"""\n')
    assert records.read_csv(spark, str(tmp_path / "c.csv"), ["uuid", "text"]).first()["text"] == 'two\nlines, "quoted"'
    for d, names in (("full", records.COMPLETE), ("part", records.COMPLETE[:2])):
        (tmp_path / "runs" / d).mkdir(parents=True)
        for n in names:
            (tmp_path / "runs" / d / n).write_text(json.dumps({}))
    assert [r["dir"].rsplit("/", 1)[-1] for r in records.complete_outputs(spark, str(tmp_path / "runs")).collect()] == ["full"]


def test_saved_indexes(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    records.save_embeddings(rows, str(tmp_path / "e"), "m", 2)
    assert records.load_embeddings(spark, str(tmp_path / "e"), "m", 2).count() == 1
    with pytest.raises(ValueError):
        records.load_embeddings(spark, str(tmp_path / "e"), "other")
    head = spark.createDataFrame([(0, "rent", [1.0], 0.0)], "class_idx int, class string, w array<double>, b double")
    records.save_head(head, str(tmp_path / "h"), 0.4)
    head.withColumn("threshold", F.lit(0.5)).write.parquet(str(tmp_path / "old"))
    assert records.load_head(spark, str(tmp_path / "h"))[1:] == (0.4, 0.3) and records.load_head(spark, str(tmp_path / "old"))[1:] == (0.5, 0.3)
    parts = [spark.createDataFrame(x, "doc string, annotator string, risk_flags array<string>") for x in ([("d", "m", ["old"]), ("d", "h", ["x"])], [("d", "m", ["new"])])]
    assert records.merge_annotations(*parts).first()["flags"] == {"m": ["new"], "h": ["x"]}


def test_streams(spark, tmp_path):
    rows = [("a", "x y", "2024-01-01 00:00:00"), ("b", "x  y", "2024-01-01 00:01:00"), ("b", "z", "2024-01-01 00:02:00"), ("c", " ", "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "source string, text string, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("source string, text string, t timestamp").parquet(str(tmp_path / "in"))
    q = ingest.first_seen(stream(), "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    ingest.merge_units(stream(), str(tmp_path / "units"), str(tmp_path / "c2")).awaitTermination(120)
    got = {r["n_occurrences"]: r["sources"] for r in ingest.units(spark, str(tmp_path / "units")).collect()}
    assert got == {2: ["a", "b"], 1: ["b"]}


def test_registry(spark, sf_dir):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() > 0


def test_queries_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    shown = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    for name in ("classify_fast_lane", "risk_findings", "paragraph_split", "unit_dedup", "summarize_rows", "stratified_split_members", "per_class_metrics", "set_agreement", "finding_prompt", "grounded_findings"):
        df = queries.QUERIES[name](spark, sf_dir)
        names = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert shown(df.select(*names).collect()) == shown(want), name


def test_queries_see_whole_texts(spark, tmp_path):
    late = "x " * 400 + "No security deposit is required. "
    docs = [(i, "s", late + " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}{i % 3}" for j in range(300))) for i in range(41)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, s, t[:100]) for i, s, t in docs], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert all(r["text"].rstrip().endswith(f"word{chr(97 + 299 % 26)}{chr(97 + 299 // 26)}{r['id'] % 3}") for r in overlay.sections(spark, f"{tmp_path}/a").collect())
    rows = [{(r["id"], r["rule_id"]) for r in queries.found(spark, f"{tmp_path}/{x}").select("id", "rule_id").collect()} for x in "ab"]
    assert rows[0] != rows[1]


def test_ranked_is_the_plain_rank(spark):
    rows = spark.createDataFrame([(i, "big" if i % 7 else None) for i in range(3000)], "id long, type string")
    plain = sorted(range(3000), key=lambda i: (__import__("hashlib").md5(f"{i}|42".encode()).hexdigest(), i))
    got = {r["id"]: (r["__r"], r["__n"]) for r in features.ranked(rows, [], ["id"]).collect()}
    assert got == {i: (k + 1, 3000) for k, i in enumerate(plain)}
    got = {r["id"]: (r["__r"], r["__n"]) for r in features.ranked(rows, ["type"], ["id"]).collect()}
    for part in ([i for i in plain if i % 7], [i for i in plain if i % 7 == 0]):
        assert all(got[i] == (k + 1, len(part)) for k, i in enumerate(part))



def test_pushdown(spark, sf_dir):
    """Scans read only what a query needs."""
    plan = queries.QUERIES["classify_fast_lane"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan
    assert ground.rule_table(spark).count() == 27 and index.repeated_sources(spark.createDataFrame([("a",)], "source string")).count() == 0

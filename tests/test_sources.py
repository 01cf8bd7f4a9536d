"""Word files made here, sinks, and a stream."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope import streaming
from folioscope.sources import docx, sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def run(text, bold=""):
    return f"<w:r><w:rPr>{bold}</w:rPr><w:t>{text}</w:t></w:r>"


BODY = f"""
<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="center"/></w:pPr>{run("目", "<w:b/>")}{run("录", "<w:b/>")}{run("x", '<w:b w:val="0"/>')}{run("y")}</w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> TOC \\o "1-3" </w:instrText></w:r>
 <w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:p><w:pPr><w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:headerReference w:type="default" r:id="rId1"/></w:sectPr></w:pPr><w:r><w:br w:type="page"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><a:blip r:embed="rId2"/></w:r><w:r><a:blip r:embed="rId9"/></w:r></w:p>
<w:sdt><w:sdtPr><w:tag w:val="slot"/></w:sdtPr><w:sdtContent><w:p>{run("fill me")}</w:p></w:sdtContent></w:sdt>
<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/></w:sectPr>"""


def word_file(body=BODY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}><w:p>{run('head')}</w:p></w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="header1.xml"/><Relationship Id="rId2" Target="../media/i.png"/></Relationships>')
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/></w:style><w:style w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    facts = docx.read_docx(spark, str(tmp_path)).cache()
    assert {r["path"].rsplit("/")[-1] for r in facts.collect()} == {"a.docx"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r["path"].rsplit("/")[-1], r["valid"]) for r in docx.valid_packages(files).collect()) == [("a.docx", True), ("bad.docx", False)]
    runs = docx.logical_runs(facts).filter("parent_ref = 'word/document.xml:p[1]'").orderBy("logical_run").collect()
    assert [(r["text"], r["bold"], r["n_rows"]) for r in runs] == [("目录", "true", 2), ("x", "false", 1), ("y", None, 1)]
    fields = facts.filter("kind = 'field'").select("text", "place", F.col("attrs")["end"].alias("end")).collect()
    assert [(f["text"], f["place"], f["end"]) for f in fields] == [("PAGE", 2, "2"), ("", 5, ""), ('TOC \\o "1-3"', 2, "")]
    flow = docx.body_flow(facts).orderBy("source_seq").collect()
    assert [(r["kind"], r["text"]) for r in flow] == [("paragraph", "目录xy"), ("paragraph", "fill me"), ("cell", "cell"), ("content_control", "fill me"), ("part_paragraph", "head")]
    sections = docx.section_references(facts).orderBy("section").collect()
    assert [(s["section"], s["slot"], s["target"]) for s in sections] == [(1, "header:default", "word/header1.xml"), (2, "header:default", "word/header1.xml")]
    numbered = docx.paragraph_numbering(facts).collect()
    assert [(r["source_ref"], r["rank"], r["m_num_fmt"]) for r in numbered] == [("word/document.xml:p[2]", 1, "decimal")]
    assert [r["target"] for r in docx.image_targets(facts).collect()] == ["media/i.png"]
    assert facts.filter("kind = 'break'").select(F.col("attrs")["type"]).distinct().count() == 2
    assert docx.unsupported_objects(files).count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    first = sinks.write_outputs({"one": a, "two": a.limit(0)}, str(tmp_path / "out")).collect()
    again = sinks.write_outputs({"one": a.repartition(3), "two": a.limit(0)}, str(tmp_path / "out")).collect()
    assert [(r["name"], r["n_rows"]) for r in first] == [("one", 2), ("two", 0)] and first == again
    found = spark.createDataFrame([("f1", "FAIL", "blocking", "b", "m", ["x"]), ("f2", "UNKNOWN", "minor", "c", "n", ["y"])], "finding_id string, status string, severity string, bucket string, message string, affected array<string>")
    summary = sinks.write_report(found, str(tmp_path / "report")).first()
    assert (summary["n_blocking"], summary["n_unknown"], summary["first_bucket"], summary["status"]) == (1, 1, "b", "FAIL")
    for _ in range(2):
        sinks.append_audit(spark, str(tmp_path / "audit"), "run", True, "why", ["f"], "me")
    assert spark.read.json(str(tmp_path / "audit")).select("audit_id").distinct().count() == 2


def test_stream_counts_like_a_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    spark.read.parquet(path).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_counts(streaming.follow_tables(spark, str(tmp_path / "in"), schema), late="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = streaming.windowed_counts(spark.read.parquet(path))
    pick = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert pick(spark.table("counted")) == pick(want)


def test_facts_of_asked_kinds_alone_and_files_a_few_at_a_time(spark):
    content = word_file()
    every, asked = list(docx.document_rows(content)), [set(docx.BANDS), {"run"}, {"section", "break"}, {"style"}, {"numbering"}, {"field", "relationship", "image", "numbering_level"}]
    assert all([r for r in every if r[0] in kinds] == list(docx.document_rows(content, kinds)) for kinds in asked)
    files = spark.createDataFrame([("a", content), ("b", b"no zip")], "path string, content binary")
    key = lambda df: sorted(repr(r) for r in df.collect())
    assert key(docx.facts(files, ["run", "section"])) == key(docx.facts(files).filter("kind IN ('run', 'section')"))
    batch = pa.RecordBatch.from_pydict({"content": [b"x" * 400, b"", None, b"x" * 5000, b"x"]})
    assert [piece.num_rows for piece in docx.slices(batch, "content", 1000)] == [3, 1, 1]

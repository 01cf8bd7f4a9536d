"""Queries that write Word files from the documents table, in memory, and read their facts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from folioscope.operators import sequence
from folioscope.sources import docx
from folioscope.sources.tables import table

_NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _package(text: str, header: bool = False) -> bytes:
    """A file with a paragraph for each line, of two runs with one look and a third in bold; the last line ends a section.

    With ``header`` the first line stands in a header part too, and the parts are deflated, as the file is to be kept.
    """
    lines = text.split("\n")

    def run(part, look=""):
        return f'<w:r><w:rPr>{look}</w:rPr><w:t xml:space="preserve">{escape(part)}</w:t></w:r>'

    body = []
    for i, line in enumerate(lines):
        a, b = len(line) // 3, 2 * len(line) // 3
        style = f'<w:pPr><w:pStyle w:val="{"H" if i == 0 else "B"}"/>{"<w:sectPr/>" if i == len(lines) - 1 else ""}</w:pPr>'
        body.append(f"<w:p>{style}{run(line[:a])}{run(line[a:b])}{run(line[b:], '<w:b/>')}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if header else zipfile.ZIP_STORED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {_NAMESPACE}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {_NAMESPACE}><w:p>{run(lines[0])}</w:p></w:hdr>")
    return out.getvalue()


def packed(spark, sf_dir, header: bool = False):
    """The documents as Word files (path, content)."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in docx.slices(batch, "text"):
                content = [_package(t, header) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartition(F.col("doc_id"))  # packing is all the work, and one file may be one split
    return docs.select("path", "text").mapInArrow(pack, "path string, content binary")


def _facts(spark, sf_dir, kinds):
    return docx.facts(packed(spark, sf_dir), kinds)


def word_paragraphs(spark, sf_dir):
    """Visible paragraphs of the files, numbered."""
    flow = docx.body_flow(_facts(spark, sf_dir, docx.BANDS))
    return flow.select(F.col("path").cast("long").alias("doc_id"), "source_seq", "place", F.md5("text").alias("text"), F.col("attrs")["style"].alias("style"))


def word_runs(spark, sf_dir):
    """Runs of the files after folding: how many of each look and how many characters."""
    runs = docx.logical_runs(_facts(spark, sf_dir, ["run"]))
    return runs.groupBy(F.col("path").cast("long").alias("doc_id"), F.coalesce("bold", F.lit("no")).alias("bold")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_rows").alias("n_raw"), F.sum(F.length("text")).alias("n_chars"))


def word_sections(spark, sf_dir):
    """Sections of the files and the paragraphs that they end after."""
    found = _facts(spark, sf_dir, ["section"]).filter("kind = 'section'").withColumn("at", F.coalesce("place", F.lit(1 << 40)))
    numbered = sequence.dense_sequence(found, ["path"], ["at"], "section")
    return numbered.select(F.col("path").cast("long").alias("doc_id"), "section", "place")


QUERIES = {f.__name__: f for f in (word_paragraphs, word_runs, word_sections)}

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"

SQL = {
    "word_paragraphs": f"""WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS source_seq, i AS place, md5(line) AS text, CASE WHEN i = 1 THEN 'H' ELSE 'B' END AS style
        FROM l WHERE trim(line) <> ''""",
    "word_runs": f"""WITH {_LINES}, c AS (SELECT doc_id, CAST(2 * length(line) // 3 AS BIGINT) AS plain, length(line) AS n FROM l)
        SELECT doc_id, 'no' AS bold, count(*) AS n_runs, CAST(2 * count(*) AS BIGINT) AS n_raw, CAST(sum(plain) AS BIGINT) AS n_chars FROM c GROUP BY doc_id
        UNION ALL SELECT doc_id, 'true', count(*), count(*), CAST(sum(n - plain) AS BIGINT) FROM c GROUP BY doc_id""",
    "word_sections": f"""WITH {_LINES}, m AS (SELECT doc_id, max(i) AS n FROM l GROUP BY doc_id)
        SELECT doc_id, 1 AS section, n AS place FROM m UNION ALL SELECT doc_id, 2, NULL FROM m""",
}

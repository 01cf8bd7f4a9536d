"""Word documents as tables of facts.

A document is a ZIP of XML parts, so reading is Python, one document at a time
in the executors; everything that relates facts to one another (numbering,
inheritance, section references, image targets) is a join or a window over the
tables.  ``facts`` gives one narrow table for all kinds; the functions after it
pick and shape the kinds.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import squeezed
from folioscope.operators import matching, sequence

# Namespaces and part names of the file format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAIN = "word/document.xml"
CONTENT_TYPES = "[Content_Types].xml"

#: Order of the bands: body, tables' cells, content controls, headers and footers.
BANDS = {"paragraph": 0, "cell": 1, "content_control": 2, "part_paragraph": 3}

FACTS = (
    T.StructType()
    .add("path", "string").add("kind", "string").add("part", "string").add("place", "long").add("source_ref", "string").add("parent_ref", "string")
    .add("text", "string").add("attrs", T.MapType(T.StringType(), T.StringType()))
)


#: Bytes of content that a reader or a writer of files takes from a batch at once, one file at least, and facts that it hands over at once.
SLICE_BYTES, SLICE_FACTS = 1 << 20, 10_000


def slices(batch, column: str, limit: int = SLICE_BYTES):
    """Cuts an Arrow batch into runs of rows of about ``limit`` bytes in a column: batches are cut by rows, however long these are."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def is_package(content: bytes) -> bool:
    """A ZIP with content types and a main document part."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return {CONTENT_TYPES, MAIN} <= set(z.namelist())
    except (zipfile.BadZipFile, OSError):
        return False


def _attr(element, name):
    return None if element is None else element.get(W + name)


def _toggle(parent, name):
    """None where the switch is absent, else whether it is on."""
    found = parent.find(W + name) if parent is not None else None
    return None if found is None else str((_attr(found, "val") or "true").lower() not in ("0", "false", "off")).lower()


def _run_style(properties):
    if properties is None:
        return {}
    fonts, size = properties.find(W + "rFonts"), properties.find(W + "sz")
    names = [] if fonts is None else [fonts.get(W + k) for k in ("ascii", "hAnsi", "eastAsia", "cs")]
    style = {
        "fonts": ",".join(dict.fromkeys(n for n in names if n)) or None, "size_pt": None if size is None else str(float(_attr(size, "val")) / 2), "bold": _toggle(properties, "b"), "italic": _toggle(properties, "i"),
        "underline": _attr(properties.find(W + "u"), "val"), "color": _attr(properties.find(W + "color"), "val"), "run_style": _attr(properties.find(W + "rStyle"), "val"),
    }
    return {k: v for k, v in style.items() if v is not None}


def _paragraph_style(properties):
    if properties is None:
        return {}
    spacing, indent, numbering = (properties.find(W + n) for n in ("spacing", "ind", "numPr"))
    out = {"style": _attr(properties.find(W + "pStyle"), "val"), "alignment": _attr(properties.find(W + "jc"), "val"), "line": _attr(spacing, "line"), "line_rule": _attr(spacing, "lineRule"), "first_line": _attr(indent, "firstLine"), "keep_next": _toggle(properties, "keepNext"), "page_break_before": _toggle(properties, "pageBreakBefore")}
    if numbering is not None:
        out |= {"num_id": _attr(numbering.find(W + "numId"), "val"), "ilvl": _attr(numbering.find(W + "ilvl"), "val")}
    return {k: v for k, v in out.items() if v is not None}


def _text(element) -> str:
    """Text of an element with tabs and breaks, without deleted text and field instructions."""
    out = []
    for node in element.iter():
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag == W + "tab" and node.get(W + "val") is None:
            out.append("\t")
        elif node.tag == W + "br":
            out.append("\n")
    return "".join(out)


def _field_rows(root, part):
    """Fields by a stack of begin and end marks; those that never end come last, innermost first."""
    stack, rows = [], []

    def close(entry, end):
        begin, words = entry
        instruction = "".join(words).strip()
        rows.append(("field", begin, instruction, {"field_type": instruction.split(" ")[0].upper() if instruction else "", "end": "" if end is None else str(end)}))

    for index, paragraph in enumerate(root.iter(W + "p"), 1):
        for node in paragraph.iter():
            if node.tag == W + "fldChar":
                kind = _attr(node, "fldCharType")
                if kind == "begin":
                    stack.append((index, []))
                elif kind == "end" and stack:
                    close(stack.pop(), index)
            elif node.tag == W + "instrText" and stack:
                stack[-1][1].append(node.text or "")
            elif node.tag == W + "fldSimple":
                close((index, [_attr(node, "instr") or ""]), index)
    while stack:
        close(stack.pop(), None)
    return rows


def _section_attrs(section):
    size, margins, numbers = (section.find(W + n) for n in ("pgSz", "pgMar", "pgNumType"))
    out = {"width": _attr(size, "w"), "height": _attr(size, "h"), "orientation": _attr(size, "orient"), "number_format": _attr(numbers, "fmt"), "number_start": _attr(numbers, "start")}
    out |= {f"margin_{k}": _attr(margins, k) for k in ("top", "bottom", "left", "right", "header", "footer", "gutter")}
    for ref in (*section.findall(W + "headerReference"), *section.findall(W + "footerReference")):
        out[f"{ref.tag.removeprefix(W).removesuffix('Reference')}:{_attr(ref, 'type') or 'default'}"] = ref.get(R + "id")
    return {k: v for k, v in out.items() if v is not None}


def _any_of(*kinds):
    """Whether any of ``names`` is wanted; no ``kinds`` are all."""
    return lambda wanted: wanted is None or not wanted.isdisjoint(kinds)


_PARAGRAPHS, _RUNS, _BREAKS, _SECTIONS, _CELLS = _any_of("paragraph", "cell_paragraph", "part_paragraph"), _any_of("run"), _any_of("break"), _any_of("section"), _any_of("cell")
_IMAGES, _FOOTNOTES, _BOXES, _CONTROLS, _FIELDS, _RELATIONS = _any_of("image"), _any_of("footnote"), _any_of("text_box"), _any_of("content_control"), _any_of("field"), _any_of("relationship")
_STYLES, _NUMBERINGS = _any_of("style"), _any_of("numbering_level", "numbering")
_OUTSIDE_PARTS = {"relationship", "style", "numbering_level", "numbering"}


def _part_rows(root, part, main, kinds=None):
    """Facts of one part, in document order: (kind, place, source_ref, parent_ref, text, attrs); of ``kinds`` alone, if given."""
    rows, paragraphs = [], list(root.iter(W + "p"))
    cells = {}
    for t, tbl in enumerate(root.iter(W + "tbl"), 1):
        for r, row in enumerate(tbl.findall(W + "tr"), 1):
            for c, cell in enumerate(row.findall(W + "tc"), 1):
                ref = f"{part}:tbl[{t}].r[{r}].c[{c}]"
                if _CELLS(kinds):
                    rows.append(("cell", t, ref, f"{part}:tbl[{t}]", "\n".join(_text(p) for p in cell.findall(W + "p")), {"row": str(r), "column": str(c), "cant_split": _toggle(row.find(W + "trPr"), "cantSplit") or ""}))
                for p in cell.iter(W + "p"):
                    cells[id(p)] = ref
    texts, runs, breaks, sections, images, footnotes, boxes = (f(kinds) for f in (_PARAGRAPHS, _RUNS, _BREAKS, _SECTIONS, _IMAGES, _FOOTNOTES, _BOXES))
    for i, p in enumerate(paragraphs, 1):
        ref, properties, inside = f"{part}:p[{i}]", p.find(W + "pPr"), cells.get(id(p))
        if texts:
            rows.append(("cell_paragraph" if inside is not None else "paragraph" if main else "part_paragraph", i, ref, inside, _text(p), _paragraph_style(properties)))
        if runs or breaks:
            for j, run in enumerate(p.iter(W + "r"), 1):
                if runs:
                    rows.append(("run", i, f"{ref}.r[{j}]", ref, _text(run), {"run_index": str(j)} | _run_style(run.find(W + "rPr"))))
                if breaks:
                    for br in run.findall(W + "br"):
                        rows.append(("break", i, ref, ref, "", {"type": _attr(br, "type") or "line"}))
        section = properties.find(W + "sectPr") if properties is not None else None
        if section is not None:
            if breaks:
                rows.append(("break", i, ref, ref, "", {"type": "section"}))
            if sections:
                rows.append(("section", i, ref, ref, "", _section_attrs(section)))
        if images:
            for blip in p.iter(DRAWING + "blip"):
                rows.append(("image", i, ref, ref, "", {"rel_id": blip.get(R + "embed") or ""}))
        if footnotes:
            for node in p.iter(W + "footnoteReference"):
                rows.append(("footnote", i, ref, ref, "", {"id": _attr(node, "id") or ""}))
        if boxes:
            for box in p.iter(W + "txbxContent"):
                rows.append(("text_box", i, ref, ref, _text(box), {}))
    body = root.find(W + "body")
    last = body.find(W + "sectPr") if body is not None else None
    if last is not None and sections:
        rows.append(("section", None, f"{part}:body", None, "", _section_attrs(last)))
    if _CONTROLS(kinds):
        for i, control in enumerate(root.iter(W + "sdt"), 1):
            tag = control.find(f"{W}sdtPr/{W}tag")
            rows.append(("content_control", i, f"{part}:sdt[{i}]", None, _text(control), {"tag": _attr(tag, "val") or ""}))
    fields = _field_rows(root, part) if _FIELDS(kinds) else []
    # some kinds are built together
    rows += [(kind, at, f"{part}:p[{at}]", None, text, attrs) for kind, at, text, attrs in fields]
    return rows if kinds is None else [row for row in rows if row[0] in kinds]


def document_rows(content: bytes, kinds=None):
    """Facts of one document: (kind, part, place, source_ref, parent_ref, text, attrs); nothing where it is no package.

    With ``kinds``, a set, only those are made, and parts without any of them are not read.
    """
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        return
    with package as z:
        names = set(z.namelist())
        if not {CONTENT_TYPES, MAIN} <= names:
            return
        for part in [MAIN, *sorted(n for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))]:
            if kinds is None or kinds - _OUTSIDE_PARTS:
                for kind, *rest in _part_rows(ElementTree.fromstring(z.read(part)), part, part == MAIN, kinds):
                    yield (kind, part, *rest)
            rels = f"word/_rels/{posixpath.basename(part)}.rels"
            if rels in names and _RELATIONS(kinds):
                for rel in ElementTree.fromstring(z.read(rels)).iter(PACKAGE + "Relationship"):
                    target = rel.get("Target") or ""
                    full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("word", target))
                    yield ("relationship", part, None, rel.get("Id"), None, full, {"mode": rel.get("TargetMode") or "Internal"})
        if "word/styles.xml" in names and _STYLES(kinds):
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                attrs = {"name": _attr(style.find(W + "name"), "val") or "", "based_on": _attr(style.find(W + "basedOn"), "val")} | _paragraph_style(style.find(W + "pPr")) | _run_style(style.find(W + "rPr"))
                yield ("style", "word/styles.xml", None, _attr(style, "styleId"), attrs.pop("based_on"), "", attrs)
        if "word/numbering.xml" in names and _NUMBERINGS(kinds):
            root = ElementTree.fromstring(z.read("word/numbering.xml"))
            levels = []
            for abstract in root.iter(W + "abstractNum"):
                for level in abstract.findall(W + "lvl"):
                    value = lambda n: _attr(level.find(W + n), "val") or ""  # noqa: B023, E731
                    levels.append(("numbering_level", "word/numbering.xml", int(_attr(level, "ilvl")), _attr(abstract, "abstractNumId"), None, value("lvlText"), {"num_fmt": value("numFmt"), "start": value("start"), "style": value("pStyle")}))
            for num in root.iter(W + "num"):
                levels.append(("numbering", "word/numbering.xml", None, _attr(num, "numId"), _attr(num.find(W + "abstractNumId"), "val"), "", {}))
            yield from (row for row in levels if kinds is None or row[0] in kinds)


def fact_batch(rows):
    """Facts as one Arrow batch."""
    import pyarrow as pa

    text = pa.string()
    kinds = [text, text, text, pa.int64(), text, text, text]
    *columns, attrs = zip(*rows)
    made = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*made, pa.array([list(a.items()) for a in attrs], pa.map_(text, text))], FACTS.names)


def facts(files: DataFrame, kinds=None) -> DataFrame:
    """The facts of documents given as rows (path, content), such as Spark's binary files; of ``kinds`` alone, if given.

    Files are taken from a batch a few at a time, and facts handed over before the next.
    """
    wanted = None if kinds is None else frozenset(kinds)

    def read(batches):
        for batch in batches:
            for piece in slices(batch, "content"):
                rows = []
                for path, content in zip(piece.column("path").to_pylist(), piece.column("content").to_pylist()):
                    for row in document_rows(content, wanted):
                        rows.append((path, *row))
                        if len(rows) >= SLICE_FACTS:
                            yield fact_batch(rows)
                            rows = []
                if rows:
                    yield fact_batch(rows)

    return files.select("path", "content").mapInArrow(read, FACTS)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all documents under a path that Spark can read."""
    return facts(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path))


def valid_packages(files: DataFrame) -> DataFrame:
    """(path, valid, sha256) of files."""

    @F.pandas_udf(T.BooleanType())
    def valid(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: is_package(bytes(c)))

    return files.select("path", valid("content").alias("valid"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def body_flow(all_facts: DataFrame) -> DataFrame:
    """What is visible in order, numbered by document: paragraphs, cells, tagged controls, headers and footers in bands."""
    band = F.coalesce(*[F.when(F.col("kind") == k, F.lit(b)) for k, b in BANDS.items()])
    seen = all_facts.filter(F.col("kind").isin(*BANDS) & (squeezed("text") != "") & ((F.col("kind") != "content_control") | (F.col("attrs")["tag"] != "")))
    return sequence.dense_sequence(seen.withColumn("band", band), ["path"], ["band", "part", "place", "source_ref"], "source_seq")


def logical_runs(all_facts: DataFrame) -> DataFrame:
    """Neighbouring runs of a paragraph with the same look as one, with the runs that they are made of."""
    look = ["fonts", "size_pt", "bold", "italic", "underline", "color"]
    runs = all_facts.filter("kind = 'run'").select("path", "parent_ref", "source_ref", "text", F.col("attrs")["run_index"].cast("int").alias("run_index"), *[F.col("attrs")[k].alias(k) for k in look])
    return sequence.fold_runs(runs, ["path", "parent_ref"], ["run_index"], look, "text", "logical_run", "source_ref")


def section_references(all_facts: DataFrame) -> DataFrame:
    """Headers and footers in force in each section by (kind, type): set there, or carried over from the section before."""
    own = all_facts.filter("kind = 'section'").withColumn("at", F.coalesce("place", F.lit(1 << 40)))
    own = sequence.dense_sequence(own, ["path"], ["at"], "section").select("path", "part", "section", F.explode("attrs").alias("slot", "rel_id")).filter("slot LIKE 'header:%' OR slot LIKE 'footer:%'")
    slots = own.select("path", "part", "slot").distinct()
    grid = sequence.dense_sequence(all_facts.filter("kind = 'section'").withColumn("at", F.coalesce("place", F.lit(1 << 40))), ["path"], ["at"], "section").select("path", "section").join(slots, "path").join(own, ["path", "part", "section", "slot"], "left")
    carried = sequence.inherited(grid, ["path"], ["section"], ["slot"], "rel_id", "rel_in_force")
    targets = all_facts.filter("kind = 'relationship'").select("path", "part", F.col("source_ref").alias("rel_in_force"), F.col("text").alias("target"))
    return carried.join(targets, ["path", "part", "rel_in_force"], "left").select("path", "section", "slot", "rel_in_force", F.coalesce("target", F.lit("")).alias("target"))


def numbering_catalog(all_facts: DataFrame) -> DataFrame:
    """Numbering definitions: every level of the abstract list that a list uses."""
    levels = all_facts.filter("kind = 'numbering_level'").select("path", F.col("source_ref").alias("abstract_id"), F.col("place").cast("string").alias("ilvl"), F.col("text").alias("level_text"), F.col("attrs")["num_fmt"].alias("num_fmt"), F.col("attrs")["style"].alias("style"))
    nums = all_facts.filter("kind = 'numbering'").select("path", F.col("source_ref").alias("num_id"), F.col("parent_ref").alias("abstract_id"))
    return levels.join(nums, ["path", "abstract_id"])


def paragraph_numbering(all_facts: DataFrame) -> DataFrame:
    """Each numbered paragraph's definition: by list and level, list and style, list, or style, in this order."""
    p = all_facts.filter("kind IN ('paragraph', 'cell_paragraph', 'part_paragraph')")
    p = p.select("path", "source_ref", *[F.col("attrs")[k].alias(k) for k in ("num_id", "ilvl", "style")]).filter("num_id IS NOT NULL OR style IS NOT NULL")
    c = numbering_catalog(all_facts).withColumn("order_id", F.col("num_id").cast("int"))
    tries = [["path", "num_id", "ilvl"], ["path", "num_id", "style"], ["path", "num_id"], ["path", "style"]]
    found = matching.ranked_match(p, ["path", "source_ref"], [(c, t, t) for t in tries], ["order_id", "ilvl"])
    return found.filter("rank IS NOT NULL")


def image_targets(all_facts: DataFrame) -> DataFrame:
    """Images with the parts they show; those without a target are dropped."""
    rels = all_facts.filter("kind = 'relationship'").select("path", "part", F.col("source_ref").alias("rel_id"), F.col("text").alias("target"))
    return all_facts.filter("kind = 'image'").select("path", "part", "source_ref", F.col("attrs")["rel_id"].alias("rel_id")).join(rels, ["path", "part", "rel_id"])


def unsupported_objects(files: DataFrame) -> DataFrame:
    """One row a document and kind of visible object that the facts do not cover."""
    # fixed values: marks of such objects in the main part
    marks = {"chart": b"c:chart", "smart_art": b"dgm:relIds", "ole_object": b"o:OLEObject"}

    def scan(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                if is_package(bytes(content)):
                    data = zipfile.ZipFile(io.BytesIO(bytes(content))).read(MAIN)
                    rows += [(path, kind) for kind, mark in marks.items() if mark in data]
            yield pd.DataFrame(rows, columns=["path", "object"])

    return files.select("path", "content").mapInPandas(scan, "path string, object string")

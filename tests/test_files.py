"""Files written as rows and parts of packages read back: golden bytes, failed tasks, named parts."""

import io
import json
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscope.sources import docx, files, packages
from tests.test_sources import BODY, word_file


def below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_golden_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("a/é.json", '{"b":[1,{"d":null,"c":"目"}],"a":1.50}'), ("b.json", "[]"), ("c.json", None)], "name string, content string")
    files.write_files(rows, str(tmp_path / "out"))
    got = {r["name"]: bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "out")).collect()}
    want = '{\n  "a": 1.5,\n  "b": [\n    1,\n    {\n      "c": "目",\n      "d": null\n    }\n  ]\n}\n'
    assert got == {"a/é.json": want.encode(), "b.json": b"[]\n"}
    manifest = next(p for p in below(tmp_path / "out") if "_manifest" in p)
    assert sum(p["files"] for p in json.load(open(manifest))["parts"]) == 3
    index = [json.loads(x) for p in below(tmp_path / "out") if p.endswith(files.INDEX) for x in open(p)]
    assert {i["name"]: i["bytes"] for i in index} == {n: len(c) for n, c in got.items()} | {"c.json": 0}


def test_yaml_keeps_the_order_of_keys(spark, tmp_path):
    pytest.importorskip("yaml")
    files.write_files(spark.createDataFrame([("x.yaml", '{"b": "目", "a": [1, true, null]}')], "name string, content string"), str(tmp_path), "yaml")
    assert bytes(files.read_files(spark, str(tmp_path)).first()["content"]) == "b: 目\na:\n- 1\n- true\n- null\n".encode()


@pytest.mark.parametrize("bad", [("z.json", "{no json"), ("a0.json", "1"), (None, "1"), ("../x", "1")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([*[(f"a{i}.json", "1") for i in range(50)], bad], "name string, content string")
    with pytest.raises(PySparkException):
        files.write_files(rows, str(tmp_path / "out"))
    assert below(tmp_path / "out") == []


def test_append_overwrite_and_empty(spark, tmp_path):
    one, two = (spark.createDataFrame([(n, "1")], "name string, content string") for n in ("one", "two"))
    path = str(tmp_path / "out")
    names = lambda: sorted(r["name"] for r in files.read_files(spark, path).collect())
    files.write_files(one, path)
    files.write_files(two, path)
    assert names() == ["one", "two"]
    files.write_files(two.withColumn("content_", F.lit(1)), path, overwrite=True)
    assert names() == ["two"]
    files.write_files(one.limit(0), path, overwrite=True)
    assert len(below(path)) == 1 and "_manifest" in below(path)[0]


def test_only_named_parts_are_read(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.docx").write_bytes(b"")
    # a package whose body is broken within: its header can be read, its body can not
    whole = word_file("<w:p><w:r><w:t>body</w:t></w:r></w:p>")
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        at = z.getinfo(docx.MAIN).header_offset
    hurt = bytearray(whole)
    hurt[at + 30 + len(docx.MAIN) + 5] ^= 0xFF
    (tmp_path / "hurt.docx").write_bytes(bytes(hurt))
    head = packages.parts(spark, str(tmp_path), "word/header1.xml", task_bytes=1)
    assert sorted(r["path"].rsplit("/")[-1] for r in head.collect()) == ["a.docx", "hurt.docx"]
    assert packages.parts(spark, str(tmp_path), "word/header?.xml").count() == 0
    with pytest.raises(PySparkException):
        packages.parts(spark, str(tmp_path), docx.MAIN).collect()
    # two filters of one relation in one plan do not meet
    both = head.filter(F.col("part").startswith("word/header")).unionByName(head.filter(F.col("part").startswith("word/footer")))
    assert both.count() == 2
    lines = packages.header_paragraphs(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/")[-1], r["part"], r["place"], r["text"]) for r in lines) == [("a.docx", "word/header1.xml", 1, "head"), ("hurt.docx", "word/header1.xml", 1, "head")]


def test_part_facts_are_those_of_whole_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    rest = ["style", "numbering", "numbering_level", "relationship"]
    whole = docx.read_docx(spark, str(tmp_path)).filter(~F.col("kind").isin(*rest))
    some = packages.part_facts(packages.parts(spark, str(tmp_path), docx.MAIN, "word/header1.xml"))
    pick = lambda df: sorted(repr((r["kind"], r["part"], r["place"], r["source_ref"], r["text"], r["attrs"])) for r in df.collect())
    assert pick(some) == pick(whole)


def test_visible_objects_and_bad_utf8(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(docx.MAIN, b"<x>\xff</x>")
    xml = packages.main_parts(spark, str(tmp_path))
    assert {r["path"].rsplit("/")[-1]: r["xml"] for r in xml.collect()}["b.docx"] == "<x>�</x>"
    got = [(r["path"].rsplit("/")[-1], r["content_id"], r["source_ref"]) for r in packages.visible_objects(xml).collect()]
    assert got == [("a.docx", "u_image_001", "word/document.xml:drawing[1]")] and "<a:blip" in BODY
    every = spark.createDataFrame([("p", "m", "<w:txbxContent/> wps:txbx <w:footnoteReference/> pic:pic"), ("q", "m", None)], "path string, part string, xml string")
    assert [r["object_type"] for r in packages.visible_objects(every).collect()] == ["text_box", "footnote", "image"]


def test_facts_of_parts_of_asked_kinds(spark):
    found = spark.createDataFrame([("a", docx.MAIN, zipfile.ZipFile(io.BytesIO(word_file())).read(docx.MAIN)), ("b", "word/header1.xml", None)], "path string, part string, content binary")
    every = sorted(repr(r) for r in packages.part_facts(found).filter("kind IN ('paragraph', 'cell_paragraph')").collect())
    assert every and every == sorted(repr(r) for r in packages.part_facts(found, ["paragraph", "cell_paragraph"]).collect())

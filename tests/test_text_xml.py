import re
import threading
from pathlib import Path
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from glossaflow import content as C
from glossaflow.sinks import documents as D


def workers_mb() -> float:
    """MB of all Python workers on this machine."""
    total = 0
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                total += sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", (p / "smaps_rollup").read_text())))
        except OSError:
            pass
    return total / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_many_tokens_take_little_memory(spark):
    texts = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.repeat(F.lit("word "), 3000).alias("text"))
    xml = D.text_xml(C.from_texts(texts))
    D.text_xml(C.from_texts(texts.limit(1))).count()  # starts the workers
    before, most, over = workers_mb(), 0.0, threading.Event()

    def watch() -> None:
        nonlocal most
        while not over.wait(0.02):
            most = max(most, workers_mb())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        n = xml.agg(F.count("*"), F.sum(F.size(F.split("xml", "<token ")) - 1)).first()
    finally:
        over.set()
        watcher.join()
    assert tuple(n) == (400, 1_200_000)
    assert most - before < 500


def test_sections_sentences_and_signs(spark, monkeypatch):
    monkeypatch.setattr(D, "_BATCH", 1)
    rows = [("d&1", 0, 'a "b"\t<c>', "One & two. x<y.", 0), ("d&1", 1, None, "", 20), ("d&1", 2, "t", "  ", 20), ("d2", 0, "", "", 0), ("d3", 10, "z", "Z.", 5), ("d3", 9, "y", "Y! Yes.", 0)]
    content = C.from_sections(spark.createDataFrame(rows, "doc_id string, sec_id int, type string, text string, start int"))

    def article(doc: str) -> str:
        root = ET.Element("article", id=doc)
        for _, sec, kind, text, start in sorted(r for r in rows if r[0] == doc):
            part, at = ET.SubElement(root, "section", id=str(sec), type=kind or ""), start
            for k, s in enumerate(re.findall(r".+?[.!] (?![a-z])|.+", text)):
                one = ET.SubElement(part, "sentence", id=str(k))
                for i, m in enumerate(re.finditer(r"\w+|[^\w\s]+", s)):
                    ET.SubElement(one, "token", id=str(i), start=str(at + m.start()), end=str(at + m.end()), length=str(len(m.group()))).text = m.group()
                at += len(s)
        return ET.tostring(root, encoding="unicode")

    made = D.text_xml(content).collect()
    assert sorted((r.doc_id, r.xml) for r in made) == [(d, article(d)) for d in ("d&1", "d2", "d3")]

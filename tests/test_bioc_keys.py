import zlib

from glossaflow.sources import files


def test_paths_of_one_crc_keep_their_documents(spark, tmp_path):
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    for name in ("plumless", "buckeroo"):
        docs = "".join(f"<document><id>{name}{k}</id><passage><offset>0</offset><text>Text {k}</text></passage></document>" for k in range(2))
        (tmp_path / f"{name}.xml").write_text(f"<collection>{docs}</collection>")
    sections, _ = files.read_bioc_xml(spark, str(tmp_path))
    assert sorted(r.doc_id for r in sections.collect()) == ["buckeroo0", "buckeroo1", "plumless0", "plumless1"]

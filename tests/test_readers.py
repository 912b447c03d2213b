"""Readers of files that many tasks share."""

import json

from palmleaf.sources import io


def test_json_arrays_by_lines(spark, tmp_path):
    """Arrays over many lines and on one, with brackets and quotes in strings, objects in objects, and files without an array."""
    deep = [{"id": f"k{i}" if i % 2 else None, "text": 'a "{[" \\ }] \n' + "x" * (i % 50), "topic": "t", "more": {"z": [1, {"y": "}"}]}} for i in range(400)]
    texts = {"a.json": json.dumps(deep, indent=2), "b.json": json.dumps(deep[:5]), "c.json": "[]", "d.json": "\n\n".join(json.dumps(d) for d in deep[:3]), "e.json": "[\n  {\n\n\"id\": \"cut\"", "f.json": "[" + json.dumps(deep[0]) + ",\n" + json.dumps(deep[1]) + ", " + json.dumps(deep[2]) + "]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = io.json_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in got:
        if not r.file.endswith("e.json"):
            found.setdefault(r.file[-6:], {})[r.pos] = json.loads(r.record)
    want = {"a.json": deep, "b.json": deep[:5], "d.json": deep[:3], "f.json": deep[:3]}
    assert {k: [v[i] for i in sorted(v)] for k, v in found.items()} == want and all(sorted(v) == list(range(len(v))) for v in found.values())


def test_conll_blocks(spark, tmp_path):
    (tmp_path / "a.conll").write_text("one B-X\ntwo\tI-X\n\n\n\nthree O\n  \nfour B-Y")
    got = sorted((r.block, r.pos, r.token, r.tag) for r in io.read_conll(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got] == [(0, "one", "B-X"), (1, "two", "I-X"), (0, "three", "O"), (1, "four", "B-Y")]


def test_packed_corpus(spark, tmp_path):
    """Texts in one file with a separator between them are read as those in files of their own."""
    texts = [f"The first paragraph of text {i}, which is long enough! Short. And a second sentence of it.\n\ntoo short\n\nAnother paragraph of text {i} that is as long as the first" for i in range(5)]
    (tmp_path / "each").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "each" / f"{i}.txt").write_text(text)
    (tmp_path / "packed.txt").write_text("\f".join(texts))
    got = [io.read_corpus(spark, str(tmp_path / "each")), io.read_corpus(spark, str(tmp_path / "packed.txt"), separator="\f")]
    each, packed = (sorted(map(tuple, g.select("para", "pos", "sentence").collect())) for g in got)
    assert each == packed and len(each) == 15 and got[1].select("doc").distinct().count() == 5

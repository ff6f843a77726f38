"""Mentions in frames, records of papers, batches of components and chains of references."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.functions import mentions
from tessera.operators import sets
from tessera.sources import corpus, files


def test_framed_mentions(spark):
    rng = random.Random(2)
    bits = ["We introduce the COCO dataset here.", "results", "2.1 Datasets and more", "trained on coco and COCO, VQA", "prior work on Vqa", "nothing", "", "  a subset of VQA, a benchmark", "evaluated", "References", "Appendix A", "3 references", "text"]
    docs = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 90)))) for i in range(30)] + [(30, None), (31, ""), (32, "VQA"), (33, "Methods\n" + "x\n" * 35 + "VQA\nVQA")]
    got = {(r.id, r.line, r["name"]): (r.section, r.role, r.excerpt) for r in mentions.framed_mentions(spark.createDataFrame(docs, "d long, t string"), "d", "t", r"(?i)(?<![\w-])(?:COCO|VQA)(?![\w-])").collect()}
    want = {}
    for d, t in docs:
        lines, listed = re.split(r"\r\n|\n|\r", t) if t is not None else [], False
        for i, line in enumerate(lines):
            listed |= re.match(r"^(?:\d+\s+)?(?:references|bibliography)\s*$", " ".join(line.split()), re.I) is not None
            seen = set()
            for name in re.findall(r"(?i)(?<![\w-])(?:COCO|VQA)(?![\w-])", line):
                if name.lower() in seen:
                    continue
                seen.add(name.lower())
                heads = [x.strip()[:100] for x in lines[max(0, i - 35) : i + 1] if re.match(mentions.HEADINGS, x.strip())]
                near = " ".join(lines[max(0, i - 1) : i + 2])
                role = next((n for n, p in mentions.ROLES if all(re.search(q, near) for q in p)), "unclassified")
                want[d, i + 1, name] = ("References" if listed else heads[-1] if heads else None, "bibliography-only reference" if listed else role, " ".join(near.split())[:500])
    assert got == want and len({r for _, r, _ in want.values()}) >= 5 and got[33, 37, "VQA"][0] is None and got[32, 1, "VQA"] == (None, "unclassified", "VQA")


RIS = """TY  - JOUR
TI  - One title
  that goes on
AU  - A, B
AU  - C, D
ZZ  - unknown
L1  - papers\\one.pdf
L2  - gone.pdf
ER  -
junk between
TY  - CONF
DO  - 10.1/X
TY  - BOOK
PY  - 1999
"""


def test_ris_records(spark, tmp_path):
    rows = spark.createDataFrame([("a.ris", "﻿" + RIS), ("b.ris", None), ("c.ris", "no tags")], "path string, text string")
    got = sorted(corpus.ris_records(rows).collect(), key=lambda r: r.ris_index)
    assert [(r.ris_index, r.title, r.authors, r.doi, r.year) for r in got] == [(1, "One title", ["A, B", "C, D"], None, None), (2, None, [], "10.1/X", None), (3, None, [], None, "1999")]
    assert got[0].tags["ZZ"] == ["unknown"] and [(x.type, x.path) for x in got[0].links] == [("L1", "papers/one.pdf"), ("L2", "gone.pdf")]
    assert got[1].paper_id == "paper-" + hashlib.sha256(b"10.1/x").hexdigest()[:16]
    assert {r.title for r in corpus.ris_records(rows, joined=True).collect()} == {"One title that goes on", None}
    (tmp_path / "papers").mkdir()
    (tmp_path / "lib.RIS").write_text(RIS)
    for name, data in (("papers/one.pdf", b"same"), ("papers/two.html", b"same"), ("noext", b"x")):
        (tmp_path / name).write_bytes(data)
    found, records = corpus.scan_corpus(spark, str(tmp_path))
    by = {r.relative_path: r for r in found.collect()}
    assert set(by) == {"lib.RIS", "papers/one.pdf", "papers/two.html", "noext"}
    assert by["papers/one.pdf"].paper_id == got[0].paper_id and by["papers/one.pdf"].ris_link_type == "L1" and by["papers/one.pdf"].copies == ["papers/one.pdf", "papers/two.html"]
    assert by["papers/two.html"].paper_id == "paper-unlinked-" + hashlib.sha256(b"two").hexdigest()[:12] and by["noext"].type == "unknown" and by["noext"].paper_id is None and by["noext"].copies is None
    one = {r.ris_index: (r.linked_files, r.missing_links) for r in records.collect()}
    assert one == {1: (["papers/one.pdf"], ["gone.pdf"]), 2: ([], []), 3: ([], [])}


def test_component_batches(spark):
    rng = random.Random(6)
    rows, first = [], {}
    for i in range(400):
        c = rng.choice([f"c{i // 3}", f"d{i}", "wide" if 100 < i < 130 else f"e{i // 7}"])
        rows.append((i, c))
        first.setdefault(c, i)
    batches, current, want = 0, 0, {}
    for c in sorted(first, key=lambda c: first[c]):
        size = sum(x == c for _, x in rows)
        if current and current + size > 16:
            batches, current = batches + 1, 0
        current += size
        want[c] = batches
    got = sets.component_batches(spark.createDataFrame(rows, "ord long, component string").repartition(5), "component", "ord").collect()
    assert len(got) == 400 and {r.component: r.batch for r in got} == want and max(want.values()) > 10
    assert sets.component_batches(spark.createDataFrame([(1, None)], "ord long, component string"), "component", "ord").first().batch == 0
    assert sets.component_batches(spark.createDataFrame([], "ord long, component string"), "component", "ord").count() == 0


def test_references_however_long_the_chain(spark):
    n = 700
    rows = [(f"n{i}", f"n{i + 1}" if i < n else None) for i in range(n + 1)] + [("x", "y"), ("y", "z"), ("z", "y"), ("lost", "nowhere"), ("self", "self")]
    got = {r.id: r.target for r in files.follow_references(spark.createDataFrame(rows, "id string, to string"), "id", "to").collect()}
    assert got == {f"n{i}": f"n{n}" for i in range(n + 1)} | dict.fromkeys(("x", "y", "z", "lost", "self"))


def test_collections(spark, tmp_path):
    import zipfile

    import pytest

    from tessera.sources.collection import Entry, Lookup, read_collection

    (tmp_path / "a.json").write_text('{"data": {"items": [{"id": "x", "n": 1, "p": {"q": "é"}}, {"id": "y", "n": null, "p": {"q": "2"}}]}}', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n".join(f'{{"id": "l{i}", "n": {i}}}' for i in range(500)) + "\n\n")
    (tmp_path / "t.txt").write_text("one\n\n  \ntwo\nthree")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/keyed.json", '{"k1": {"n": 5}, "k2": {"n": 6}}')
        z.writestr("arrays.json", '[["a", 1], ["b", 2]]')
        z.writestr("c.csv", 'id,n\n"q ""x""\nz",7\n')
        z.writestr("lines.txt", "﻿é\n\nü\n")
    P = lambda n: str(tmp_path / n)
    record = "id string, n long"
    found = read_collection(spark, [
        Entry(P("a.json"), "train", schema="id string, n long, p struct<q: string>", records_key="data.items"), Entry(P("b.jsonl"), "test", "jsonl", record),
        Entry(P("z.zip"), "keyed", schema=record, member="in/keyed.json", key_field="id"), Entry(P("z.zip"), "arr", schema=record, member="arrays.json", columns=["id", "n"], identity_prefix="g"),
        Entry(P("z.zip"), "csv", "csv", "id string, n string", member="c.csv"),
    ][:4], id_path="id").collect()
    by = {r.origin.identity: r for r in found}
    assert len(by) == 2 + 500 + 2 + 2 and by["train:x"].p.q == "é" and by["train:y"].n is None and by["train:y"].origin.row == 1
    assert [by[f"test:l{i}"].origin.row for i in range(500)] == list(range(500))
    assert (by["keyed:k2"].n, by["g:b"].n, by["g:b"].origin.split, by["g:b"].origin.file) == (6, 2, "arr", "arrays.json")
    row = read_collection(spark, [Entry(P("z.zip"), "csv", "csv", "id string, n string", member="c.csv")], identity_fields=["n", "id"]).first()
    assert row.id == 'q "x"\nz' and row.origin.identity == 'csv:["7","q \\"x\\"\\nz"]'
    lines = read_collection(spark, [Entry(P("t.txt"), "s", "text_lines"), Entry(P("z.zip"), "z", "text_lines", member="lines.txt")]).collect()
    assert {(r.line, r.text, r.origin.identity) for r in lines} == {(1, "one", "s:0"), (4, "two", "s:1"), (5, "three", "s:2"), (1, "é", "z:0"), (3, "ü", "z:1")}
    assert read_collection(spark, [Entry(P("t.txt"), "s", "text")]).first().text == "one\n\n  \ntwo\nthree"

    table = spark.createDataFrame([("x", "cat"), ("y", "dog"), ("w", "cow")], "key string, name string")
    first = Entry(P("a.json"), "train", schema="id string, n long", records_key="data.items")
    joined = lambda **o: Entry(first.path, "train", schema=first.schema, records_key=first.records_key, lookups=[Lookup(**{"table": table, "on": "id", "key": "key", "name": "animal", **o})])
    got = {r.id: r.animal.name for r in read_collection(spark, [joined(unused=True)]).collect()}
    assert got == {"x": "cat", "y": "dog"}
    many = {r.id: sorted(a.name for a in r.animal) for r in read_collection(spark, [joined(table=table.where("key <> 'w'").union(spark.createDataFrame([("x", "cub")], table.schema)), many=True)]).collect()}
    assert many == {"x": ["cat", "cub"], "y": ["dog"]}
    bad = [joined(), joined(table=table.where("key = 'x'")), joined(table=table.union(table), unused=True), joined(name="n", unused=True), Entry(P("a.json"), "s", "xml"), Entry(P("a.json"), "s", schema=None)]
    for e in bad:
        with pytest.raises(ValueError):
            read_collection(spark, [e])
    for e in (Entry(P("z.zip"), "s", schema=record, member="none.json"), Entry(P("z.zip"), "s", schema=record, member="in/keyed.json"), Entry(P("z.zip"), "s", schema=record, member="arrays.json", columns=["id"])):
        with pytest.raises(Exception, match="no member|list of objects|arrays of"):
            read_collection(spark, [e])
    with pytest.raises(ValueError, match="is there 2 times"):
        read_collection(spark, [first, first], id_path="id")
    with pytest.raises(Exception, match="missing"):
        read_collection(spark, [first], identity_fields=["id", "n"])

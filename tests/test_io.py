"""Readers, writers, the command line and the stream."""

import bz2
import hashlib
import json

import pytest

from quillspark import cli
from quillspark.operators.catalog import Context, lint
from quillspark.operators.rules import CATALOG
from quillspark.sources import documents, reports
from quillspark.streaming import lint as stream

LONG = " ".join(["word"] * 21) + "."


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub/skip").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"Line one.\r\n" + LONG.encode())
    (tmp_path / "sub/b.md").write_text("# Head\n\nfine; text")
    (tmp_path / "sub/skip/c.txt").write_text("left out")
    (tmp_path / "d.html").write_text("no")
    return tmp_path


def test_documents(spark, folder):
    got = {r.uri.rpartition("/")[2]: r.text for r in documents.read_documents(spark, str(folder), exclude=["skip"]).collect()}
    assert got == {"a.txt": "Line one.\r\n" + LONG, "b.md": "# Head\n\nfine; text"}
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        documents.read_documents(spark, str(folder)).collect()
    assert documents.quarantined(spark, str(folder)).count() == 1


def test_frozen_and_corpora(spark, tmp_path):
    data = b'{"a": 1}\n{"a": 2}\n'
    (tmp_path / "x.jsonl").write_bytes(data)
    read = lambda sha: documents.read_frozen_json(spark, str(tmp_path / "x.jsonl"), sha, "a int").collect()
    assert [r.a for r in read(hashlib.sha256(data).hexdigest())] == [1, 2]
    with pytest.raises(Exception, match="has changed"):
        read("0" * 64)
    (tmp_path / "x.conllu").write_text("# sent_id = s1\n# text = a b\n1\ta\n\n# sent_id = s2\n# text = c\n1\tc\n\n")
    assert [(r.sent, r.text) for r in documents.read_conllu(spark, str(tmp_path / "x.conllu")).orderBy("sent").collect()] == [("s1", "a b"), ("s2", "c")]
    (tmp_path / "x.bz2").write_bytes(bz2.compress("The|DT|O pump|NN|O\n\n.|.|O\n".encode()))
    assert sorted(r.text for r in documents.read_tagged(spark, str(tmp_path / "x.bz2")).collect()) == [".", "The pump"]


def test_reports(spark, folder, tmp_path):
    docs = documents.read_documents(spark, str(folder))
    found = lint(docs, CATALOG, ["SENT-001", "SEMI-001"], Context({"text_type": "procedural"}))
    report = {r.uri.rpartition("/")[2]: json.loads(r.json) for r in reports.json_reports(found).collect()}
    assert report["a.txt"]["schema_version"] == "1.0"
    place = report["a.txt"]["diagnostics"][0]["location"]
    assert (place["start_offset"], place["start_line"], place["start_column"]) == (11, 2, 1)
    assert reports.read_json_reports(reports.json_reports(found)).count() == found.count() == 2
    assert any("SEMI-001" in r.line and ":3:5:" in r.line for r in reports.text_lines(found).collect())
    assert [reports.summary(*x) for x in ((0, 0), (1, 0), (1, 1), (1, 2))] == ["No rules are enabled.", "No findings.", "1 finding.", "2 findings."]
    rows = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    digest = reports.write_once(rows, str(tmp_path / "once"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "once")).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}'] and len(digest) == 64
    with pytest.raises(Exception):
        reports.write_once(rows, str(tmp_path / "once"))
    reports.telemetry(spark.createDataFrame([("ok", "secret text")], "status string, text string"), str(tmp_path / "t"))
    reports.telemetry(spark.createDataFrame([("ok", "secret text")], "status string, text string"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).columns == ["status"] and spark.read.json(str(tmp_path / "t")).count() == 2


def test_command_line(spark, folder, capsys, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    run = lambda *a: cli.main(["lint", str(folder), "--enable", "SENT-001", "--text-type", "procedural", *a], spark)
    assert run() == 1 and "SENT-001" in capsys.readouterr().out
    assert run("--format", "json") == 1 and json.loads(capsys.readouterr().out.strip())["diagnostics"]
    assert run("--write-baseline", str(out / "base")) == 0
    capsys.readouterr()
    assert run("--baseline", str(out / "base")) == 0 and "No findings." in capsys.readouterr().out
    assert cli.main(["lint", str(folder)], spark) == 0 and "No rules are enabled." in capsys.readouterr().out
    assert cli.main(["lint", str(folder), "--enable", "NOPE-001"], spark) == 2
    assert cli.main(["rules"]) == 0 and cli.main(["explain", "SEMI-001"]) == 0 and cli.main(["explain", "x"]) == 2


def test_stream_equals_batch(spark, folder):
    query = stream.long_sentences(stream.arriving(spark, str(folder / "*.txt"))).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.start, r.end, r.words) for r in spark.table("found").collect()]
    batch = lint(documents.read_documents(spark, str(folder)), CATALOG, ["SENT-001"], Context({"text_type": "procedural"})).collect()
    assert [(s, e) for s, e, _ in got] == [(r.start, r.end) for r in batch] == [(11, 11 + len(LONG))] and got[0][2] == 21


def test_packets_round_trip(spark, tmp_path):
    fields = ["case_id", "context", "notes"]
    rows = spark.createDataFrame([("1", '=sum("a";b)\nline two, "quoted"', None, 5), ("2", "plain", " pad ", 6)], "case_id string, context string, notes string, hidden int")
    reports.write_packet(rows, str(tmp_path / "packet"), fields)
    back = {r.case_id: (r.context, r.notes) for r in reports.read_packet(spark, str(tmp_path / "packet"), fields).collect()}
    assert back["1"] == ("'" + '=sum("a";b)\nline two, "quoted"', "") and back["2"][0] == "plain"
    with pytest.raises(Exception):
        reports.read_packet(spark, str(tmp_path / "packet"), ["context", "case_id", "notes"]).collect()
    with pytest.raises(Exception):
        reports.write_packet(rows, str(tmp_path / "packet"), fields)


def test_documents_are_left_out_by_folder_and_by_file(spark, tmp_path):
    from quillspark.sources.documents import read_documents

    for name in ("a.txt", "b.md", "sub/a.txt", "old/c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.text for r in read_documents(spark, str(tmp_path), ["old"], ["sub/a.txt"]).collect()}
    assert got == {"a.txt", "b.md"}


def test_vocabularies_are_kept_under_their_hash(tmp_path):
    from quillspark.operators import vocabulary

    source = '{"entries": [{"term": "b", "part_of_speech": "noun", "meaning_id": "m", "case_sensitive": false}, {"term": "a", "part_of_speech": "noun", "meaning_id": "m", "case_sensitive": true}]}'
    with pytest.raises(ValueError, match="consent"):
        vocabulary.cached(source, str(tmp_path), consent=False)
    path = vocabulary.cached(source, str(tmp_path), consent=True)
    assert vocabulary.cached(source, str(tmp_path), consent=True) == path and [p.name for p in tmp_path.iterdir()] == [path.name]
    entries = vocabulary.from_resource(path.read_text())
    assert [e["term"] for e in entries] == ["b", "a"] and vocabulary.content_hash(entries) == vocabulary.content_hash(vocabulary.read_source(source))
    path.write_text(path.read_text().replace('"b"', '"c"'))
    for use in (lambda: vocabulary.from_resource(path.read_text()), lambda: vocabulary.cached(source, str(tmp_path), consent=True)):
        with pytest.raises(ValueError, match="hash"):
            use()

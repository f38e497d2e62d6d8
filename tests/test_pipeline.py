import json

import pytest

import __spark_entry__
from docshape import cli
from docshape.plans import provider
from docshape.plans.pipeline import discover, discover_from_strings, set_log_level
from docshape.sources import files
from docshape.streaming import incremental


def texts(n=12):
    invoices = [f"INVOICE\nInvoice Number: {i}\nTotal: ${i}.00\nDue Date: 2024-01-{i + 1:02d}" for i in range(n)]
    memos = ["MEMO\n" + "we should meet about the plan again and talk it over at length " * 6 + f"\nauthor{i}" for i in range(n)]
    return [t for pair in zip(invoices, memos) for t in pair]


def test_discovery(spark):
    said = []
    found = discover_from_strings(spark, texts() + ["  "], on_progress=lambda *x: said.append(x))
    assert found.stats["total_docs"] == 24 and found.stats["parsed_errors"] == 1 and said[-1][2] == 100
    kinds = {}
    for r in found.assignments.collect():
        kinds.setdefault(r.cluster_id, set()).add(int(r.name[4:6]) % 2)
    assert len(kinds) == 2 and all(len(v) == 1 for v in kinds.values())
    got = {r.name: r for r in found.fields.collect()}
    assert got["total"].type == "number" and got["due_date"].type == "date" and got["invoice_number"].frequency == 100.0 and got["total"].required
    assert {r.name for r in found.clusters.collect()} == {"Invoice", "Memo"}


def test_aliases_are_counted_as_their_union(spark):
    docs = [f"NOTE\n{'Client' if i % 2 else 'Customer'}: c{i}" for i in range(10)]
    aliases = spark.createDataFrame([("Client", "customer", 0)], "alias string, canonical string, ord int")
    rows = discover_from_strings(spark, docs, aliases=aliases).fields.collect()
    assert {(r.name, r.frequency) for r in rows} == {("customer", 100.0)}


def test_bad_input(spark):
    for bad, error in (("x", TypeError), ([], ValueError), ([1], TypeError)):
        with pytest.raises(error):
            discover_from_strings(spark, bad)
    with pytest.raises(ValueError):
        files.from_strings(spark, ["a"], ["b", "c"])
    for k in (1, "3", True):
        with pytest.raises(ValueError):
            discover_from_strings(spark, ["a", "b"], min_cluster_size=k)
    with pytest.raises(ValueError):
        discover(spark.range(3))
    assert "warning" in discover_from_strings(spark, ["only one"]).stats
    set_log_level("warning")


def test_folder_and_cli(spark, tmp_path, capsys):
    for i, t in enumerate(texts(6)):
        (tmp_path / f"d{i}.txt").write_text(t)
    (tmp_path / "bom.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "bad.log").write_bytes(b"a\xffb")
    (tmp_path / "pic.png").write_bytes(b"x")
    (tmp_path / "skip.bin").write_bytes(b"x")
    (tmp_path / "big.txt").write_text("y" * 5000)
    got = {r.name: r for r in files.read_folder(spark, str(tmp_path), max_bytes=4000).collect()}
    assert got["bom.md"].text == "hello" and got["bad.log"].text == "a�b" and "needs" in got["pic.png"].parse_error and "larger" in got["big.txt"].parse_error and "skip.bin" not in got
    assert len(files.supported_files(str(tmp_path))) == 16
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2
    out = tmp_path / "out.json"
    assert cli.main(["analyze", str(tmp_path), "-q", "-o", str(out)]) == 0
    assert {f["name"] for f in json.loads(out.read_text())["schemas"]} >= {"total", "due_date"}
    manifest = tmp_path / "m.json"
    manifest.write_text('[{"filename": "b", "doc_type": "z"}, {"filename": "a", "doc_type": "y"}, {"filename": "c", "doc_type": "z"}]')
    assert {(r.name, r.type_id) for r in files.read_manifest(spark, str(manifest)).collect()} == {("b", 0), ("a", 1), ("c", 0)}


class Flaky(Exception):
    status_code = 503


def test_provider():
    for model, name in (("claude-x", "anthropic"), ("gpt-4o", "openai"), ("o3", "openai"), ("gemini-1", "google"), ("groq/any", "groq"), ("llama-3", "groq"), ("gpt-oss", "cerebras"), ("x:free", "openrouter"), ("what", "anthropic")):
        assert provider.detect_provider(model) == name
    slept, answers = [], iter([Flaky("busy"), Flaky("try again in 7s"), provider.Reply('{"name": "N", "description": "d", "keywords": []}')])

    def call(prompt, p):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    p = provider.ModelProvider("claude-x", call=call, sleep=slept.append)
    assert provider.cluster_label(p, ["t"])["name"] == "N" and slept == [2.0, 7.5]
    bad = provider.ModelProvider("claude-x", call=lambda *_: provider.Reply("garbage"))
    assert provider.cluster_label(bad, ["t"])["name"] == "Unknown Type"
    assert provider.is_transient(TimeoutError()) and not provider.is_transient(ValueError("room 5001"))
    with pytest.raises(ValueError):
        provider.ModelProvider("nobody/x", provider="nobody")
    assert provider.context_chars("claude") == 400_000 and provider.context_chars("?") == 12_000


def test_streaming(spark, tmp_path):
    schema = "doc_id long, cluster_id string, text string, ts timestamp"
    rows = [(i, "c", f"Name: {i}\nName: x", None) for i in range(6)]
    df = spark.createDataFrame(rows, schema).selectExpr("doc_id", "cluster_id", "text", "timestamp'2024-01-01 00:10:00' as ts")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.document_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    incremental.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in incremental.totals(spark, str(tmp_path / "out")).collect()] == [("c", "name", 6)]
    query = incremental.windowed_field_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.field, r.doc_count) for r in spark.table("w").collect()] == [("name", 6)]


def test_entry_has_sql_of_the_same_names(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() > 0

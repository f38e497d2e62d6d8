"""Discovery with a language model, whose replies are recorded."""

import json

import numpy as np
import pytest

from docshape import benchmark
from docshape.functions.text import field_name, plain_field_name
from docshape.operators import cluster, judged, presence, similar
from docshape.plans.analyst import ModelAnalyst, RuleAnalyst, analyst_of, merge_into
from docshape.plans.pipeline import discover_files, discover_from_strings
from docshape.plans.provider import RecordedProvider, RuleProvider
from docshape.sources import export

INVOICE = json.dumps({"fields": [{"name": "Invoice No", "type": "String", "description": "number", "example": "7"}, {"name": "Client", "description": "who pays", "type": "string"}, {"name": "Customer", "description": "who pays, in full"}, {"name": "Total", "type": "number", "example": "5"}, {"name": "Due Date", "type": "date"}, {"bad": 1}]})
MEMO = '```json\n{"fields": [{"name": "Author", "type": "string", "example": "x"}'
REPLIES = [
    (("TASK label", "INVOICE"), '{"name": "Invoice", "description": "d", "keywords": ["total"]}'), (("TASK label",), "no idea"),
    (("TASK discover", "INVOICE"), INVOICE), (("TASK discover",), MEMO),
    (("TASK verify", "INVOICE", "Total: $3"), '{"found": [{"name": "total", "present": true, "value": 3, "quote": "Total: $3", "grounded": true}, {"name": "invoice_no", "present": true, "value": "3"}, {"name": "never heard of", "present": true}]}'),
    (("TASK verify", "INVOICE"), '{"found": [{"name": "Total", "present": true, "value": "9", "quote": "Total", "grounded": true}, {"name": "client", "present": true, "value": "c"}, {"name": "due_date", "present": false}]}'),
    (("TASK verify",), "unreadable"),
    (("TASK synonyms", "client"), '{"groups": [{"canonical": "Customer", "aliases": ["client"]}]}'), (("TASK synonyms",), '{"groups": []}'),
    (("TASK name groups", "Invoice"), '[{"group_index": 0, "name": "Money"}, {"group_index": 1, "name": "misc"}]'),
    (("TASK group",), '{"groups": [{"name": "Who", "fields": ["client", "unknown"]}, {"name": "Misc", "fields": ["total", "client"], "is_repeating": true}]}'),
]


def texts(n=8):
    invoices = [f"INVOICE\nInvoice Number: {i}\nTotal: ${i}.00\nClient: c{i}" for i in range(n)]
    memos = ["MEMO\n" + "we should meet about the plan again and talk it over at length " * 6 for _ in range(n)]
    return [t for pair in zip(invoices, memos) for t in pair]


def test_model_discovery(spark):
    found = discover_from_strings(spark, texts(), provider=RecordedProvider(REPLIES))
    names = {r.name: r.cluster_id for r in found.clusters.collect()}
    assert set(names) == {"Invoice", "Unknown Type"}
    got = {(r.cluster_id, r.name): r for r in found.fields.collect()}
    own = {n: r for (c, n), r in got.items() if c == names["Invoice"]}
    assert set(own) == {"invoice_no", "customer", "total", "due_date"}
    # All eight are verified; the third quotes its total, the others an unlike one.
    assert (own["total"].doc_count, own["total"].grounded_count, own["total"].frequency, own["total"].required, own["total"].type) == (8, 8, 100.0, True, "number")
    assert (own["customer"].doc_count, own["customer"].grounded_count, own["customer"].description) == (7, 0, "who pays, in full")
    assert own["invoice_no"].doc_count == 1 and own["due_date"].doc_count == 0 and not own["due_date"].required
    assert own["total"].example in ("9", "3") and set(own["total"].examples) == {"9", "3"}
    assert {r.group for r in own.values()} <= {"Money", "Invoice Details", "Buyer Details", "Section 2"} and all(r.color for r in own.values())
    assert got[names["Unknown Type"], "author"].doc_count == 0
    assert found.matrix.count() == 8 * 4 + 8 * 1 and found.matrix.where("present").count() == 8 + 7 + 1
    assert json.loads(export.payload(found))["stats"]["model"] == "recorded"


def test_unrecorded_prompts_are_no_answers(spark):
    silent = ModelAnalyst(RecordedProvider([]))
    fields = [{"name": c, "type": "string", "description": ""} for c in "abcde"]
    assert silent.label(["x"])["name"] == "Unknown Type" and silent.discover("x", []) == silent.verify("x", ["a"]) == silent.synonyms(fields) == silent.group(fields, "", 2) == [] and silent.name_groups([["a"]], "") == {}


def test_analysts():
    assert isinstance(analyst_of(None), RuleAnalyst) and isinstance(analyst_of(RuleProvider()), RuleAnalyst) and isinstance(analyst_of(RecordedProvider([])), ModelAnalyst)
    rules = RuleAnalyst()
    assert [f["name"] for f in rules.verify("Due Date: 2024-01-02\nx = 1\nnothing", ["due_date", "y"])] == ["due_date"]
    known = merge_into([], rules.discover("Total Due: $5", []))
    assert merge_into(known, [{"name": "totalDue", "type": "string", "description": "the sum that is due by then", "example": "$6"}]) == [{"name": "total_due", "type": "number", "description": "the sum that is due by then", "example": "$5", "examples": ["$5", "$6"]}]


def test_groups(spark):
    fields = spark.createDataFrame([(c, i, n, "string", "", "") for c, ns in (("a", ["x", "y"]), ("b", ["client", "total", "paid", "left", "over"]), ("d", ["vendor name", "vendor city", "sum total", "tax total"])) for i, n in enumerate(ns)], "cluster_id string, ord long, name string, type string, description string, example string")
    types = spark.createDataFrame([("a", "Receipt"), ("b", ""), ("d", "invoice")], "cluster_id string, name string")
    got = {}
    for r in judged.group_fields(fields, types, ModelAnalyst(RecordedProvider(REPLIES[-1:])), encoder=lambda said: np.array([[1.0, 0.1] if "vendor" in t else [0.1, 1.0] for t in said])).orderBy("cluster_id", "group_id").collect():
        got.setdefault(r.cluster_id, []).append((r.name, r.is_repeating, r.fields))
    assert got["a"] == [("Receipt Fields", False, ["x", "y"])]
    assert got["b"] == [("Who", False, ["client"]), ("Document Section 2", True, ["total"]), ("Document Properties", False, ["paid", "left", "over"])]
    assert [n for n, _, _ in got["d"]] == ["Section 1", "Section 2"] and {tuple(f) for _, _, f in got["d"]} == {("vendor name", "vendor city"), ("sum total", "tax total")}


def test_names_in_python_and_in_the_jvm(spark):
    names = ["Invoice Number", "invoiceNumber", " a.b-c ", "Tax %", "É1", "__x__", "", "A B", "İx", "aB cD"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(field_name(df.n)).collect()] == [plain_field_name(n) for n in names]


def test_candidates_hold_all_pairs(spark):
    import random

    rng = random.Random(2)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(120)})
    rows = spark.createDataFrame([("k", (n,)) for n in names], "key string, item struct<name: string>")
    text = rows["item.name"]
    pairs = lambda df: {(r.a.name, r.b.name) for r in df.collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for most in (1, 2):
        assert pairs(similar.within_edits(rows, text, most)) >= {(a, b) for a in names for b in names if a != b and edits(a, b) <= most}
    assert pairs(similar.inside(rows, text)) == {(a, b) for a in names for b in names if a != b and b in a}
    words = spark.createDataFrame([("k", (" ".join(sorted(set(rng.choices("abcdefgh", k=5)))) + f" {i % 3}",)) for i in range(60)], "key string, item struct<name: string>")
    said = {r.item.name for r in words.collect()}
    over = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    assert pairs(similar.sharing_words(words, words["item.name"], 50)) >= {(a, b) for a in said for b in said if a != b and over(a, b) >= 0.5}


def test_too_few_and_bad_files(spark, tmp_path):
    one = discover_from_strings(spark, ["only one", " "])
    assert one.fields.count() == one.clusters.count() == 0 and "at least 2" in one.logs[-1]
    for bad, error in (("x", TypeError), ([], ValueError), ([1], TypeError), (["/no/such/file"], FileNotFoundError)):
        with pytest.raises(error):
            discover_files(spark, bad)
    for i, t in enumerate(texts(4)):
        (tmp_path / f"{i}.txt").write_text(t)
    found = discover_files(spark, [str(tmp_path / f"{i}.txt") for i in range(8)])
    assert found.stats["total_docs"] == 8 and {"total", "client"} <= {r.name for r in found.fields.collect()}
    shown = export.demo_payload(found, 2)
    assert len(shown["points"]) == 4 and {"fields", "coord_3d", "name"} <= set(shown["points"][0])


def test_benchmark(spark, tmp_path, capsys):
    folder = tmp_path / "small"
    (folder / "documents").mkdir(parents=True)
    rows = []
    for i, t in enumerate(texts(8)):
        (folder / "documents" / f"d{i}.txt").write_text(t)
        rows.append({"filename": f"d{i}.txt", "doc_type": "memo" if i % 2 else "invoice"})
    (folder / "manifest.json").write_text(json.dumps(rows))
    out = tmp_path / "r.json"
    assert benchmark.main([str(folder), "-o", str(out)]) == 0 and benchmark.main([str(tmp_path)]) == 1
    assert json.loads(out.read_text())["clustering"]["ari"] == 1.0 and "purity" in capsys.readouterr().out


def test_matrix_has_a_row_for_every_document_and_field(spark):
    docs = spark.createDataFrame([("c", i, f"A: {i}" + ("\nB: x" if i < 2 else "")) for i in range(4)], "cluster_id string, doc_id long, text string").replace("A:", "Aa:")
    docs = docs.selectExpr("cluster_id", "doc_id", "replace(replace(text, 'A:', 'Aa:'), 'B:', 'Bb:') as text")
    found = presence.extract_fields(docs)
    rows = presence.presence_matrix(docs, presence.field_frequency(docs, found), found).collect()
    assert len(rows) == 8 and sum(r.present for r in rows) == 6 and all((r.quote is not None) == r.present for r in rows)


def test_nearest_refuses_many_references(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0], i) for i in range(20)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        cluster.nearest_cluster(v, v, most=10)
    got = {r.vec_id: (r.ref_id, r.distance) for r in cluster.nearest_cluster(v, v.where("vec_id in (0, 2, 9)")).collect()}
    assert got[1] == (0, 1.0) and got[15] == (9, 6.0) and cluster.nearest_cluster(v, v.limit(0)).count() == 0
    assert {r.label: r.embedding for r in cluster.centres(v.where("label < 2")).collect()} == {0: [0.0, 0.0], 1: [1.0, 0.0]}


def test_fixtures_and_demo(spark, tmp_path):
    from docshape import demo
    from docshape.sources.fixtures import fixtures

    rows = fixtures(spark, 30).orderBy("doc_id").collect()
    assert rows == fixtures(spark, 30).repartition(3).orderBy("doc_id").collect() and rows != fixtures(spark, 30, seed=8).orderBy("doc_id").collect()
    assert {r.doc_type for r in rows} == {"inspection", "fault report", "bulletin"} and all(r.text and r.name.endswith(f"{r.doc_id:06d}.txt") for r in rows)
    out = tmp_path / "demo.json"
    assert demo.main([str(out), "-n", "30"]) == 0
    shown = json.loads(out.read_text())
    assert {"Inspection Record", "Fault Report", "Service Bulletin"} == {c["name"] for c in shown["clusters"]} and len(shown["points"]) == 30


def test_names_are_verified_without_counting_documents(spark, tmp_path, monkeypatch):
    """The query's names are a distinct list; names are normalized once, not for each line."""
    from docshape.functions.text import plain_field_name
    from docshape.operators import presence
    from docshape.plans import queries

    monkeypatch.setattr(presence, "field_frequency", lambda *a, **k: pytest.fail("documents were counted"))
    got = queries.queries()["verify_fields"](spark, "/root/testdata/sf0.001")
    one = [(r.norm, r.quote, r.value, r.grounded) for r in got.where("doc_id = 1000000001").collect()]
    assert ("customer_name", "Customer Name: " + one[[o[0] for o in one].index("customer_name")][2]) == next(o[:2] for o in one if o[0] == "customer_name") and all(o[3] for o in one)
    plain_field_name.cache_clear()
    assert [plain_field_name(n) for n in ("Order Number", "Order Number", "orderNumber")] == ["order_number"] * 3 and plain_field_name.cache_info().hits == 1

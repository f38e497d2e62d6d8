import pytest
from pyspark.sql import functions as F

from docshape.operators import fields, grouping, metrics, presence
from docshape.sources import export

SCHEMA = "cluster_id string, ord long, name string, type string, description string, example string"


def test_merge(spark):
    rows = [("c", 0, "City", "string", "a", "NYC"), ("c", 1, "city", "number", "longer", "LA"), ("c", 2, "CITY", "date", "longer", "NYC"), ("c", 3, "", "string", "x", "y"), ("c", 4, "other", None, None, None)]
    got = {r.norm: r for r in fields.merge_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"city", "other"}
    assert (got["city"].type, got["city"].description, got["city"].example, got["city"].examples, got["city"].ord) == ("number", "longer", "NYC", ["NYC", "LA"], 0)
    assert got["other"].type == "string" and got["other"].examples == []
    many = spark.createDataFrame([("c", i, "n", "string", "", f"e{i}") for i in range(9)], SCHEMA)
    assert fields.merge_fields(many).first().examples == ["e0", "e1", "e2", "e3", "e4"]


def test_dedup_and_cross(spark):
    schema = "cluster_id string, ord long, name string, type string, description string, frequency double, doc_count long"
    rows = [("a", 0, "customer_name", "string", "x", 50.0, 5), ("a", 1, "client", "string", "xyz", 80.0, 8), ("a", 2, "invoice_date", "date", "", 10.0, 1), ("b", 0, "Customer Name", "string", "", 83.3, 4)]
    table = spark.createDataFrame(rows, schema)
    aliases = spark.createDataFrame([("client", "buyer", 0), ("Client", "customer_name", 1)], "alias string, canonical string, ord int")
    got = {(r.cluster_id, r.canonical): r for r in fields.dedup_fields(table, aliases).collect()}
    merged = got["a", "customer_name"]
    assert (merged.frequency, merged.doc_count, merged.aliases, merged.description) == (80.0, 8, ["client"], "xyz") and ("a", "invoice_date") in got
    shared = fields.cross_cluster_fields(table).collect()
    assert [(r.name, r.clusters, r.avg_frequency) for r in shared] == [("customer_name", ["a", "b"], pytest.approx(66.7, abs=0.06))]


def test_merge_suggestions(spark):
    rows = [("c", 0, "total", "", "sum", ""), ("c", 1, "total_amount", "", "", ""), ("c", 2, "vendor_name", "", "", ""), ("c", 3, "invoice_date", "", "", ""), ("d", 0, "totals", "", "", "")]
    got = fields.suggest_merges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.name1, r.name2, r.suggested_name, r.reason) for r in got] == [("total", "total_amount", "total_amount", "one name contains the other")]


def test_sample(spark):
    df = spark.createDataFrame([("a", i) for i in range(10_000)] + [("b", i) for i in range(5)] + [("c", 7 * i) for i in range(100)], "g string, i long")
    got = {}
    for r in fields.systematic_sample(df, "g", "i", 8).collect():
        got.setdefault(r.g, []).append(r.i)
    assert sorted(got["a"]) == [int(k * 10_000 / 8) for k in range(8)] and len(got["b"]) == 5 and sorted(got["c"]) == [7 * int(k * 100 / 8) for k in range(8)]


def test_presence_frequency_coverage(spark):
    docs = spark.createDataFrame([("c", i, f"Name: n{i}\n" + ("Amount: 5\nAmount: 6" if i % 5 else "")) for i in range(10)] + [("c", 10, None)], "cluster_id string, doc_id long, text string")
    found = presence.extract_fields(docs)
    got = {r.name: r for r in presence.field_frequency(docs, found).collect()}
    assert (got["name"].doc_count, got["name"].frequency, got["name"].required) == (10, 90.9, True) and (got["amount"].doc_count, got["amount"].required) == (8, False)
    cover = presence.coverage(presence.field_frequency(docs, found)).first()
    assert (cover.n_fields, cover.coverage) == (2, 81.8)
    chunks = [(1, "f", 0, False, False, "no", "v"), (1, "f", 1, True, False, "q1", ""), (1, "f", 2, True, True, "q2", "v2"), (1, "f", 3, True, True, "q3", "v3"), (2, "f", 0, False, True, "x", "y")]
    merged = presence.merge_chunks(spark.createDataFrame(chunks, "doc_id long, field string, chunk int, present boolean, grounded boolean, quote string, value string")).collect()
    assert [(r.doc_id, r.quote, r.value, r.grounded) for r in merged] == [(1, "q3", "v2", True)]


def test_groups(spark):
    table = spark.createDataFrame([("c", i, n, "", "", "") for i, n in enumerate(["total", "Buyer", "x"])], SCHEMA)
    groups = spark.createDataFrame([(0, "Money", ["Total"]), (1, "Who", ["buyer", "total"])], "group_id int, name string, fields array<string>")
    assert {r.name: (r.group, r.color) for r in grouping.assign_groups(table, groups).collect()} == {"total": ("Money", "#3868b8"), "Buyer": ("Who", "#5cb85c"), "x": ("Ungrouped", "#9a8e80")}
    assert [r.name for r in grouping.unassigned(table, groups).collect()] == ["x"]
    import numpy as np

    labels = grouping.average_linkage(np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [0, 0.8]]), 2)
    assert labels.tolist() == [0, 0, 1, 1, 1] and grouping.group_count(3) == 1 and grouping.group_count(40) == 8


def test_metrics(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 5) for i in range(30)], "t int, p int")
    assert list(metrics.clustering_metrics(same, "t", "p").first())[3:] == [1.0] * 6
    one = metrics.clustering_metrics(spark.createDataFrame([(i % 2, 0) for i in range(10)], "t int, p int"), "t", "p").first()
    assert (one.ari, one.homogeneity, one.completeness, one.purity) == (0.0, 0.0, 1.0, 0.5) and "ari" in metrics.report(one.asDict())


def test_exports(spark):
    rows = [("c", 0, "name", "string", "the | name", 'a "b"', 90.0, True), ("c", 1, "a,ge", "number", "", None, 10.0, False), ("c", 2, "day", "date", "d", "2024-01-01", 50.0, False)]
    table = spark.createDataFrame(rows, SCHEMA + ", frequency double, required boolean")
    assert export.csv_headers(table).first().csv == 'name,"a,ge",day\n"a ""b""","","2024-01-01"\n'
    assert "| name | string | Yes | 90.0% | the \\| name |" in export.markdown(table).first().markdown
    assert {r.name: r.type for r in export.entities(table).collect()} == {"name": "string", "a,ge": "float", "day": "date"}
    import json

    schema = json.loads(export.json_schema(table).first().json_schema)
    assert schema["required"] == ["name"] and schema["properties"]["day"]["format"] == "date" and schema["properties"]["a,ge"]["type"] == "number"
    assert export.spark_schema([{"name": "x", "type": "number"}, {"name": "y", "type": "enum"}]).simpleString() == "struct<x:double,y:string>"
    assert export.csv_headers(table.limit(0)).count() == 0

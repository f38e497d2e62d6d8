import re

import pytest
from pyspark.sql import functions as F

from docshape.functions import text as T
from docshape.functions.chunks import chunks, split_text
from docshape.functions.jsonfix import balanced, expect_shape, parse_json, repaired
from docshape.functions.reference import group_name, single_group_name

EDGE = [
    "", "x", "a\r\nb: c\r\n", "key : value\nNext=1\nT: 10:30\nA:\nb", "٣/٤/٢٠٢٤ and 3/4/2024, 2024-01-02", "é@b.co émail@exämple.org x@y.z", "HEAD\nTWO\n\nTHREE", "₹1,23,456.00 $ 5 €1.234", "call 555 123 4567 or +1-555-123-4567",
    "##### five\n# one\n", "éMarch 3, 2024 Mar 3 2024", "a\tb\tc\n|x|y|\n| one", "http://x.y https://é.z", "p\n\nq\n\nr", "k=v\n" * 5,
]


def python_features(t):
    if not t:
        return [0.0] * 18
    n = {k: len(re.findall(p, t, (re.I if "i" in f else 0) | (re.M if "m" in f else 0))) for k, (p, f) in T.PATTERNS.items()}
    lines = t.count("\n") + 1
    table = sum(x.count("\t") >= 2 or x.count("|") >= 2 for x in t.split("\n"))
    share = lambda x: min(x / lines, 1)
    out = [min(len(t) / 10000, 5), min(lines / 100, 5), min(len(t.split()) / 2000, 5), *(share(n[k]) for k in ("dates", "amounts", "emails", "phones", "urls", "kv")), min(n["headers"] / 10, 1), share(table)]
    out.append(min((t.count("\n\n") + 1) / lines, 1) if "\n\n" in t else 0)
    return [float(x) for x in [*out, *(n[k] > 0 for k in ("dates", "amounts", "emails")), table > 0, n["headers"] > 0, n["kv"] > 3]]


def test_fingerprint_equals_python_on_edge_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "i int, t string")
    for r in T.fingerprinted(df, "i", "t", text_col="t").collect():
        assert list(r)[2:] == pytest.approx(python_features(r.t)), r.t
    nulls = T.fingerprinted(spark.createDataFrame([(None,)], "t string"), text_col="t").first()
    assert list(nulls) == [0.0] * 18


def test_names(spark):
    golden = {"Invoice Number": "invoice_number", "invoiceNumber": "invoice_number", "totalAmountDue": "total_amount_due", "invoice-number": "invoice_number", "vendor.name": "vendor_name", "amount ($)": "amount", "  Tax %  ": "tax", "  ": "", "invoice__number": "invoice_number", "__leading__trailing__": "leading_trailing"}
    df = spark.createDataFrame([(k,) for k in golden], "n string").select("n", T.field_name(F.col("n")).alias("f"))
    assert {r.n: r.f for r in df.collect()} == golden


def test_truncate_jaccard_fences_types(spark):
    long = "".join(chr(97 + i % 26) for i in range(5001))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.smart_truncate(F.lit(long))) == long[:666] + "\n...\n" + long[2500 - 333 : 2500 + 333] + "\n...\n" + long[-666:]
    assert one(T.smart_truncate(F.lit("x" * 2000))) == "x" * 2000
    assert one(T.words_jaccard(F.lit("The total  sum"), F.lit("total SUM due"))) == pytest.approx(2 / 4) and one(T.words_jaccard(F.lit(""), F.lit("a"))) == 0
    assert one(T.without_fences(F.lit("```json\n{}\n```"))).strip() == "{}"
    kinds = [(v, one(T.value_type(F.lit(v)))) for v in ("$1,234.50", "2024-01-31", "Yes", "abc", "12x")]
    assert [k for _, k in kinds] == ["number", "date", "boolean", "string", "string"]
    assert group_name("Other", 1, "invoice") == "Buyer Details" and group_name("", 9, "Lease") == "Lease Section 10" and group_name(" Money ", 0, "x") == "Money"
    assert single_group_name("") == "Document Fields" and single_group_name("Invoice") == "Invoice Fields"


def test_chunks(spark):
    sentences = " ".join(f"Sentence number {i}." for i in range(500))
    parts = split_text(sentences, 2000)
    assert len(parts) > 1 and all(len(p) <= 2000 for p in parts) and re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", sentences)
    assert split_text("  \n") == [] and split_text("short") == ["short"] and "".join(split_text("x" * 2500, 1000)) == "x" * 2500
    assert spark.createDataFrame([(sentences,), (None,)], "t string").select(F.size(chunks(F.col("t"), 2000))).collect()[0][0] == len(parts)


def test_json(spark):
    assert parse_json('Sure: {"a": [1, 2], "b": "x') == {"a": [1, 2], "b": "x"} and parse_json("```json\n[1]\n```") == [1]
    assert parse_json('{"a": 1} trailing') == {"a": 1} and balanced('{"a": ["b') == '{"a": ["b"]}'
    with pytest.raises(ValueError):
        parse_json("this is not json")
    df = spark.createDataFrame([('x {"k": 1',), ("none",), (None,)], "r string")
    assert [r[0] for r in df.select(repaired(F.col("r"))).collect()] == ['{"k":1}', None, None]
    assert expect_shape({"a": 1}, ("dict", "a")) and expect_shape([{"b": 2}], ("list", ("dict", "b")))
    for bad, shape in (({}, ("dict", "a")), ([1], ("list", dict)), ("x", list)):
        with pytest.raises(ValueError):
            expect_shape(bad, shape)


def test_lines_are_cut_without_a_pattern_for_each(spark):
    """No line is split by a pattern that is compiled anew, and names of plain words need no replacements; odd ones are as before."""
    from docshape.operators import presence

    lines = ["ab:c", "a:b", "=x", "ab= :y", "ab:\t\x0b =z ", "é:1", "éé:1", "A=b:c", "  :v", "abc:  ", "x" * 40 + ":1", "x" * 41 + ":1", "fooBar: 2", "A1b C:2", "a  b:1", "Tax % : 5"]
    df = spark.createDataFrame([(1, "c", "\n".join(lines)), (2, "c", None)], "doc_id long, cluster_id string, text string")
    rows = [(r.line, r.name, r.norm, r.value) for r in presence.extract_fields(df).orderBy("line").collect()]
    assert rows == [(0, "ab", "ab", "c"), (3, "ab", "ab", ":y"), (4, "ab", "ab", "=z"), (10, "x" * 40, "x" * 40, "1"), (12, "fooBar", "foo_bar", "2"), (13, "A1b C", "a1b_c", "2"), (14, "a  b", "a_b", "1"), (15, "Tax %", "tax", "5")]
    plan = df.select(T.key_values(df.text).alias("kv"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[:=]" not in plan and "regexp" not in plan.lower()
    names = ["Order Number", "ABC def", "A1 b2", "orderNumber", " x ", "a-b", "", "9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.field_name(F.col("n"))).collect()]
    assert got == [T.plain_field_name(n) for n in names]

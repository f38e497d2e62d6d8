"""The pipeline against brute force, stage by stage, on the smallest tables."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docshape.llm.common import table, tokenizer_path, written
from docshape.llm.secrets import default_model, redacted
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_mixing import water_fill
from tests.llm.test_quality import brute as quality_brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = table(spark, DIR, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), "test")
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    return out


def test_quality_rules_reject_what_fails_and_keep_good_documents(spark, outputs):
    before, after = outputs[0], {r.doc_id for r in outputs[1]}
    good = {r.doc_id for r in table(spark, DIR, "labels").where("quality = 1").collect()}
    for r in before:
        n, _, _, _, rep = quality_brute(r.text)
        assert (n < 20 or 100 * rep > 30 * n) <= (r.doc_id not in after)
    assert sum(r.doc_id not in after and quality_brute(r.text)[0] >= 20 for r in before if r.doc_id in good) <= 0.06 * len(good)


def test_one_document_of_each_group_stays(outputs):
    want = [c for i, _, _, c in jaccard_brute([(r.doc_id, r.text) for r in outputs[1]]) if i == c]
    assert sorted(r.doc_id for r in outputs[2]) == sorted(want)


def test_secrets_are_masked(outputs):
    texts = {r.doc_id: r.text for r in outputs[2]}
    assert len(outputs[3]) == len(outputs[2])
    for r in outputs[3]:
        assert r.text == redacted(texts[r.doc_id], default_model(), "[secret]") and r.n_chars == len(r.text)


def test_sources_give_their_shares(outputs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, copies, longest = defaultdict(int), Counter(), Counter(), 0
    for r in outputs[3]:
        sizes[r.source] += size(r.text)
    for r in outputs[4]:
        taken[r.source] += size(r.text)
        copies[r.doc_id] += 1
        longest = max(longest, size(r.text))
    assert max(copies.values()) <= 3
    shortest = {s: min(size(r.text) for r in outputs[3] if r.source == s) for s in sizes}
    for s, t in water_fill(sizes).items():
        assert abs(taken[s] - t) <= max(0.05 * t, shortest[s] + 1), s


def test_packing_holds_every_token_once(spark, outputs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in outputs[4]:
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got, fill = Counter(), defaultdict(list)
    for r in outputs[5]:
        got[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
    assert len(fill) <= -(-sum(want.values()) // 4096) + 2
    again = corpus_pipeline.run(spark, DIR).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in outputs[5])


def test_stages_take_an_empty_table(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0


def test_stages_take_nulls_long_texts_ties_and_clashing_columns(spark):
    prose = "the quiet river ran past old houses where people told each other long stories about the sea and the cold winter "
    rows = [(1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, prose.upper(), None, None), (None, prose + "alone with nobody else near", "en", "a"), (4, None, "en", "a"), (5, "", "de", "b"), (6, "short", "de", "b")]
    rows += [(7, " ".join(f"word{i} and{i % 7}" for i in range(200_000)), "en", "b"), (8, "a note with password=abcdefghijklmno in it " + " ".join(f"x{i}" for i in range(30)), "en", "b")]
    names = ["doc_id", "text", "lang", "source", "row_id", "key", "h", "stratum", "copies", "row", "a.b"]
    docs = spark.createDataFrame([(*r, i, "k", i % 3, "s", None, float(i), True) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, row_id int, key string, h int, stratum string, copies int, row double, `a.b` boolean")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DIR)
        if name != "packing":
            assert got.columns == names, name
        out[name] = got.collect()
    kept = [(r.doc_id, r.row_id) for r in out["quality rules"]]
    assert {i for i, _ in kept} <= {None, 1, 2, 3, 7, 8} and len(kept) == len(set(kept)) and {1, 2, 3, None} <= {i for i, _ in kept}
    assert sorted((r.doc_id for r in out["near duplicates"]), key=str) == [1, 4, 5, 6, 7, 8] and all(r.key == "k" for r in out["near duplicates"])
    masked = {r.row_id: r for r in out["secret scans"]}
    assert len(masked) == len(rows) and masked[5].text is None and masked[9].text.startswith("a note with [secret] in it") and masked[8].text == rows[8][1]
    assert all(r.text and r.text.strip() for r in out["source mixing"]) and {r.row_id for r in out["source mixing"]} <= {0, 1, 2, 3, 4, 7, 8, 9}
    packed = Counter(r.doc_id for r in out["packing"] if r.piece == 0)
    assert packed == Counter(r[0] for r in rows) and sum(r.length for r in out["packing"] if r.doc_id == 7) > 400_000

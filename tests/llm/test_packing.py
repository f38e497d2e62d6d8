import zlib

import numpy as np
import pytest

from docshape.llm.common import tokenizer_path
from docshape.llm.packing import WordTokenizer, best_two_fit, pack_documents

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "don't can't I'll THE'S", "Éa ÉÉ ñ. ß, éa x́, ́y", "a.,b ... !? 12,345 x.y,", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ Σ, İstanbul", " nb sp  x \x1c y\x85z", "x" * 5000, "日本語。テスト, ｆｕｌｌ", "tab\tnew\nline\r\n\x0b\x0c end"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_ids_equal_whole_text_ids(tokenizer):
    for text, got in zip(ODD, WordTokenizer(PATH).encode([t.encode() for t in ODD])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(3, 1.2, 700).astype(int) + 1, 256)
    bins, offsets = best_two_fit(lengths, 256)
    for b in range(bins.max() + 1):
        own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert own and own[0][0] == 0 and sum(x for _, x in own) <= 256
        assert all(a + x == c for (a, x), (c, _) in zip(own, own[1:]))
    assert bins.max() + 1 <= -(-lengths.sum() // 256) + 2


def test_smallest_piece_gives_way_to_a_tighter_pair():
    # Greedy takes 6 and 3 of 10, leaving 1; the pair 2 + 2 fills the gap of 4.
    bins, _ = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packed_whole(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "again", "again"])] + [(None, "null id"), (3, "repeated id")]
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, piece string, length int")
    got = pack_documents(docs, PATH, max_tokens=64, with_ids=True).toPandas()
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            want.append((-1 if doc is None else doc, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 64


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def naive_best_two_fit(lengths, capacity):
    """The same choices over plain lists: contents of the bins in order."""
    left, bins = sorted(lengths), []
    while left:
        gap, held = capacity, []
        while fits := [x for x in left if x <= gap]:
            held.append(max(fits))
            left.remove(max(fits))
            gap -= held[-1]
        if gap and len(held) > 1 and left:
            smallest = held[-1]
            pairs = [(a + b, a, b) for i, b in enumerate(left) for a in left[i + 1 :] if smallest < a + b <= gap + smallest]
            if pairs:
                _, a, b = max(pairs)
                held.pop()
                left.remove(a)
                left.remove(b)
                held += [a, b]
                left = sorted([*left, smallest])
        bins.append(held)
    return bins


def test_best_two_fit_equals_the_naive_one():
    import random

    from docshape.llm.packing import best_two_fit

    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity if rng.random() < 0.3 else max(1, capacity // 3)) for _ in range(rng.randint(1, 40))]
        bins, offsets = best_two_fit(np.array(lengths), capacity)
        got = {}
        for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths)):
            got.setdefault(b, []).append(n)
        assert [got[b] for b in sorted(got)] == naive_best_two_fit(lengths, capacity)

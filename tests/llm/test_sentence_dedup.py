import random

from docshape.llm.sentence_dedup import LEAST_SENTENCES, LEAST_WORDS, dedup_sentences, sentences, without


def brute(rows):
    """Every run compared with every other, word by word."""
    docs = {(d, t): sentences(t or "") for d, t in rows}
    runs = []
    for (d, t), found in docs.items():
        for i in range(len(found)):
            for e in range(i + LEAST_SENTENCES, len(found) + 1):
                if sum(s[2] for s in found[i:e]) >= LEAST_WORDS:
                    words = tuple(tuple(t[a:b].lower().split()) for a, b, _, _ in found[i:e])
                    runs.append((words, (d, i), (d, t), i, e))
                    break
    first = {}
    for words, order, *_ in sorted(runs, key=lambda r: r[1]):
        first.setdefault(words, order)
    gone = {k: set() for k in docs}
    for words, order, key, i, e in runs:
        if first[words] != order:
            gone[key].update(range(i, e))
    out = []
    for d, t in rows:
        found, g = docs[d, t], gone[d, t]
        spans = []
        for i in sorted(g):
            if spans and spans[-1][2] == i - 1:
                spans[-1][1:] = [found[i][1], i]
            else:
                spans.append([found[i][0], found[i][1], i])
        out.append((d, len(found), len(g), ",".join(f"{a}:{b}" for a, b, _ in spans), t if t is None else without(t, [(a, b) for a, b, _ in spans])))
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "!", "?", "..."])
    prose = lambda k: rng.choice([" ", "\n"]).join(sentence(rng.randint(1, 18)) for _ in range(k))
    passage, flat = prose(9), " ".join(word() for _ in range(70))
    texts = [prose(rng.randint(1, 12)) for _ in range(60)]
    texts[10:20] = [t + "\n" + passage + "\n" + prose(2) for t in texts[10:20]]
    texts[20:24] = [t + " and " + flat + " but " + prose(1) for t in texts[20:24]]
    texts[30], texts[31] = texts[3], texts[3].upper()
    texts[40] = passage + " " + passage
    return [*enumerate(texts), (100, None), (101, ""), (102, " \n"), (103, "Short."), (104, "x. " * 500), (105, "w " * 3000)], passage, flat


def test_equals_brute_force(spark):
    rows, passage, flat = made()
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, span int").repartition(3)
    got = {r.doc_id: r for r in dedup_sentences(docs).collect()}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)
    assert passage in got[10].text and not any(passage in got[i].text for i in range(11, 20))
    assert flat in got[20].text and all(len(set(flat.split()) & set(got[i].text.split())) < 50 for i in range(21, 24))
    assert all(got[i].n_removed == 0 for i in range(10) if i != 3) and got[30].text == got[31].text == ""


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in dedup_sentences(docs).collect()) == [("7", 0), ("7", 0), ("None", 2), ("None", 2)]
    assert dedup_sentences(docs.limit(0)).count() == 0


def all_runs(rows):
    """Per document the sentences that any repeated run covers, every run compared with every other."""
    runs, first = [], {}
    for d, t in sorted(rows):
        found = sentences(t)
        for i in range(len(found)):
            for e in range(i + LEAST_SENTENCES, len(found) + 1):
                if sum(s[2] for s in found[i:e]) >= LEAST_WORDS:
                    words = tuple(tuple(t[a:b].lower().split()) for a, b, _, _ in found[i:e])
                    runs.append((d, i, e, first.setdefault(words, (d, i)) != (d, i)))
    return {d: {s for x, i, e, again in runs if again and x == d for s in range(i, e)} for d, _ in rows}


def test_ends_of_passages_go(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(rng.randint(1, 19))) + "."
    prose = lambda k: " ".join(sentence() for _ in range(k))
    passages = [prose(rng.randint(4, 7)) for _ in range(12)]
    rows = [(i, " ".join((prose(3), passages[i % 12], prose(3)))) for i in range(36)]
    got = {r.doc_id: r for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = all_runs(rows)
    assert all(got[d].n_removed == len(expected[d]) for d, _ in rows)
    assert all(not any(s in got[i].text for s in passages[i % 12].split(". ")) for i in range(12, 36) if len(passages[i % 12].split()) >= LEAST_WORDS)


def test_passages_of_51_words_amid_other_words(spark):
    rng = random.Random(12)
    frequent = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(400)]
    words = lambda n: " ".join(frequent[int(400 * rng.random() ** 2)] for _ in range(n))
    passages = [words(51) for _ in range(400)]
    rows = [(400 * copy + i, " ".join((words(rng.randint(5, 40)), p, words(rng.randint(5, 40))))) for copy in range(2) for i, p in enumerate(passages)]
    got = {r.doc_id: r for r in dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [len(rows[400 + i][1].split()) - len(got[400 + i].text.split()) for i in range(400)]
    assert min(lost) >= LEAST_WORDS and all(got[i].n_removed == 0 for i in range(400))

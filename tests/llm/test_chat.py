import random

from docshape.llm.chat import ROLES, RoleModel, as_transcript, _OTHER_STYLES, fit_roles, is_held_out, marker, parse_transcripts, render, role_counts, symbols, transcripts_of, unrender


def made(n, seed):
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(k))
    out = []
    for _ in range(n):
        turns = [("system", words(rng.randint(5, 20)))] if rng.random() < 0.3 else []
        for k in range(rng.randint(1, 4)):
            turns.append(("user", words(rng.randint(3, 25)) + rng.choice(["?", ".", ".\n" + words(6)])))
            turns.append(("assistant", "\n".join(words(rng.randint(20, 60)) for _ in range(rng.randint(1, 4)))))
        out.append(turns)
    return out


def labelled(chats):
    for i, turns in enumerate(chats):
        text, states = as_transcript(i, turns)
        yield text.split("\n"), states


def test_markers():
    for line, role in (("User: hi", 1), ("### Human:", 1), ("[assistant] x", 2), ("<|system|>", 0), ("**AI**: x", 2), ("Q: why", 1), ("A: b", 2), ("a word", -1), ("Answering: x", -1), ("user friendly", -1), ("", -1)):
        assert marker(line)[0] == role, line


def test_viterbi_equals_brute_force():
    model = RoleModel(role_counts(labelled(made(50, 1))))
    from itertools import product

    for lines in (["User: a", "b"], ["x", "", "y?"], ["A: q", "### Human:", "z", ""]):
        shown = symbols(lines)
        score = lambda s: model.start[s[0]] + model.show[s[0], shown[0]] + sum(model.move[a, b] + model.show[b, x] for a, b, x in zip(s, s[1:], shown[1:]))
        best = max(score(s) for s in product(range(6), repeat=len(lines)))
        assert abs(score(model.viterbi(shown)) - best) < 1e-9


def test_held_out_roles_are_recovered():
    model = RoleModel(role_counts(labelled(made(400, 2))))
    right = whole = 0
    for i, turns in enumerate(made(300, 3), 1000):
        got = model.turns(as_transcript(i, turns, _OTHER_STYLES)[0])
        whole += [r for r, _ in got] == [r for r, _ in turns]
        right += got == turns
    assert whole / 300 > 0.9 and right / 300 > 0.9


def test_render_round_trip():
    turns = [("user", "a <|end|>\n<|user|>\nb <\\| c <\\\\|"), ("assistant", ""), ("system", "x\n\ny")]
    assert unrender(render(turns)) == turns and render([]) == ""


def test_table(spark):
    rows = [(c, k, r, t, "x") for c, turns in enumerate(made(60, 4)) for k, (r, t) in enumerate(turns)]
    odd = [(None, 0, "user", "lost", "x"), (None, 0, "user", "lost", "x"), (900, None, "user", "no turn", "x"), (901, 0, None, None, "x"), (902, 0, "narrator", "User: odd", "x"), (903, 0, "user", "w " * 20000, "x")]
    long = [(950, k, "user" if k % 2 == 0 else "assistant", f"text {k}" * (1 + k % 2 * 9), "x") for k in range(5000)]
    table = spark.createDataFrame(rows + odd + long, "conv_id long, turn long, role string, text string, chat string")
    raw = transcripts_of(table)
    # One conversation of 5,000 odd turns would outweigh the other 66 in the counts.
    model = fit_roles(raw.where("conv_id is null or conv_id <> 950"))
    got = parse_transcripts(raw, model, keep=("conv_id", "held_out", "n_true", "true_roles")).collect()
    assert len(got) == 60 + 2 + 1 + 3 + 1
    (whole,) = [r for r in got if r.conv_id == 950]
    assert whole.n_true == 5000 and whole.n_turns > 4000
    short = [r for r in got if r.conv_id != 950]
    assert sum(r.roles == r.true_roles for r in short) / len(short) > 0.85
    assert all(r.held_out == is_held_out(r.conv_id) for r in got)
    assert all(len(unrender(r.chat)) == r.n_turns and set(r.roles.split(",")) <= set(ROLES) for r in got)
    assert parse_transcripts(transcripts_of(table.limit(0)), fit_roles(transcripts_of(table.limit(0))), keep=("conv_id",)).count() == 0


def test_held_out_conversations_of_the_table(spark):
    raw = transcripts_of(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    got = parse_transcripts(raw, fit_roles(raw), keep=("held_out", "true_roles")).where("held_out").collect()
    assert len(got) > 100 and sum(r.roles == r.true_roles for r in got) / len(got) > 0.9

"""Turns are cut where the model finds their first lines, not where the table's rows end."""

from __future__ import annotations

import random

from tremor.llm import transcripts


def test_recovered_turns_are_the_paths(spark):
    """Recovered turns against Viterbi over whole conversations, with turns inside rows, over rows and over runs."""
    rng = random.Random(4)
    said = ["yes?", "well\nthen", "- item\nUser: x?\nmore", "no\nAssistant: fine", "and so\non", ""]
    rows = [(c, t, ("user", "assistant")[t % 2] if rng.random() < 0.7 else None, rng.choice(said) + str(rng.random())) for c in (1, 2, 3) for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        model = transcripts.learn(df)
        got = {(r.conv_id, r.turn): r for r in transcripts.parse(df, model).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    inside = merged = 0
    for c in (1, 2, 3):
        walk, lines, states = transcripts.Walk(model), [], []
        for _, t, role, text in [r for r in rows if r[0] == c]:
            for i, line in enumerate(transcripts.turn_lines(role, text, transcripts.bare(c, t, transcripts.BARE_EIGHTHS))):
                lines.append((t, i, line))
                states += [s for s, _ in walk.push(model.line(line, c, t, i), None)]
        states += [s for s, _ in walk.finish()]
        want = {}
        for (t, i, line), state in zip(lines, states):
            if state % 2 == 0:
                found, n = transcripts.marker(line)
                body = [line[n:] if found == state // 2 else line]
                want.setdefault(t, []).append((i, transcripts.ROLES[state // 2], body))
                inside += i > 0
            else:
                body.append(line)
                merged += i == 0
        cuts = {(t, i) for (t, i, _), s in zip(lines, states) if s % 2 == 0}
        for t in range(150):
            r = got[c, t]
            turns = [(i, role, f"<|{role}|>\n" + "\n".join(b) + "\n<|end|>\n") for i, role, b in want.get(t, [])]
            assert [tuple(x) for x in r.recovered] == turns
            assert r.agrees == ({x for x in cuts if x[0] == t} == {(t, 0)})
    assert len(got) == len(rows) and inside and merged


def test_raw_transcript(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], ("What is it?", "It is a thing.\nIt has\nlines")[t % 2]) for c in range(40) for t in range(4)]
    model = transcripts.learn(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    raw = spark.createDataFrame([(1, "User: What is it?\nAssistant: It is a thing.\nIt has\nlines\nUser: What is it?"), (2, None)], "conv_id long, text string")
    got = [tuple(r) for r in transcripts.parse_text(raw, model).orderBy("conv_id", "turn").collect()]
    assert got == [
        (1, 0, 0, "user", "<|user|>\nWhat is it?\n<|end|>\n"),
        (1, 1, 1, "assistant", "<|assistant|>\nIt is a thing.\nIt has\nlines\n<|end|>\n"),
        (1, 2, 4, "user", "<|user|>\nWhat is it?\n<|end|>\n"),
    ]

"""Chat layouts, templates and round trips."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

TURNS = "conv_id long, turn long, role string, text string, piece string, start string, masked string"


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "p", "s", "m") for r in rows], TURNS).repartition(parts)


AWKWARD = ["", None, " ", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "<<s>>", "[[INST]]", "\\", "\\n\n", "a\nb\n", "日本 😀 </s", "<s", "<s>" * 50, "x" * 40_000, "$1\\3", "<unk><pad>", "[/INST][INST]<s></s>"]


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(own), sha(whole), len(loss), sha(loss))
    return out


def test_read_back_equals_the_turns(spark):
    rows = [(i // 4 if i % 7 else None, i % 4, ("user", "assistant", "system", "we\\ird\n<s>", None)[i % 5], x) for i, x in enumerate(AWKWARD * 3)]
    rows += [(90, None, "user", "b"), (90, None, "user", "a"), (90, 1, "assistant", "z"), (90, 1, "assistant", "z"), (None, 5, "assistant", "of no one"), (-1, 0, "assistant", "\x00")]
    rows += [(91, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(3_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = chat.format_turns(turns(spark, rows), "conv_id")
        got = {r["conv_id"]: r for r in chat.read_back(made, "conv_id").collect()}
        whole = {r["conv_id"]: r for r in chat.documents(made, "conv_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    for c, r in whole.items():
        text = r["formatted"]
        assert len(text) == got[c]["formatted_chars"]
        read = list(chat.TEMPLATE.turns(text))
        assert hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, *_ in read).encode()).hexdigest() == want[c][1]
        spans = [(s["loss_start"], s["loss_end"]) for s in r["loss_spans"]]
        assert [chat.TEMPLATE.unescape(text[a:b]) for a, b in spans] == [b for _, b, trained, _ in read if trained]
        assert [a for a, _ in spans] == [at for *_, trained, at in read if trained]
        # a marker stands in the text once for each turn and nowhere else
        assert sum(text.count(m) for m in ("<s>", "[INST]")) == sum(text.count(m) for m in ("</s>", "[/INST]")) == got[c]["n_turns"]


def test_no_turns(spark):
    made = chat.format_turns(turns(spark, [(1, 1, "a", "b")], 1).limit(0), "conv_id")
    assert made.count() == 0 and chat.read_back(made, "conv_id").count() == 0 and chat.documents(made, "conv_id").count() == 0


def plain_escape(text):
    """Escape sign by sign, without expressions."""
    out, i = "", 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[j] == "\\":
            j += 1
        if text[i] in "<[" and any(text.startswith(c[1:], j) for c in chat.TEMPLATE.controls):
            out += text[i:j] + "\\"
        else:
            out += text[i:j]
        i = j
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "unk>", "a", "\n"]), max_size=12).map("".join))
def test_escape_is_undone(text):
    made = plain_escape(text)
    assert chat.TEMPLATE.unescape(made) == text
    assert not any(c in made for c in chat.TEMPLATE.controls)


def test_escape_equals_plain_version(spark):
    texts = [a + b + c for a in ("", "<", "[\\") for b in ("<\\s>", "[INST]", "</s>", "\\<unk>", "<x>") for c in ("", "\\\\", "s>", "<pad>")]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(chat.TEMPLATE.escape(frame["t"])).collect()] == [plain_escape(t) for t in texts]


def test_markers_must_differ():
    with pytest.raises(ValueError):
        chat.Template(controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    with pytest.raises(ValueError):
        chat.Template(trained=("<a>", "</a>"))


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, "messages", [(0, "user", "q"), (1, "assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, "messages", [(0, "user", "xy")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, "stray"]}, "conversations", [(0, "user", "q"), (1, "assistant", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [(0, "user", "do\n\nthis"), (1, "assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done", "system": "be"}, "instruction", [(0, "system", "be"), (1, "user", "do"), (2, "assistant", "done")]),
    ({"prompt": "p", "completion": 12}, "prompt, completion", [(0, "user", "p"), (1, "assistant", "12")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, "preference", [(0, "user", "p"), (1, "assistant", "c")]),
    ({"question": "q", "answer": {"b": 1}}, "question, answer", [(0, "user", "q"), (1, "assistant", '{"b":1}')]),
    ({"turn": 3, "role": "bot", "text": "t"}, "table of turns", [(3, "assistant", "t")]),
    ({"prompt": "", "response": ""}, "prompt, response", [(0, "user", ""), (1, "assistant", "")]),
]


def test_records_of_every_layout(spark):
    odd = [None, "", "nonsense", "[1, 2]", "null", "{}", '{"messages": []}', '{"messages": [{"role": "user"}]}', "[" * 200_000, '{"x": ' * 50_000, '{"prompt": "\\ud800", "completion": "a\\u0000"}']
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(100 + i, b) for i, b in enumerate(odd)] + [(0, json.dumps(RECORDS[0][0]))]
    found, unread = chat.turns_of_json(spark.createDataFrame(rows, "id long, turn string").repartition(3), "id", "turn")
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["turn"], r["role"], r["text"]))
    for i, (_, _, want) in enumerate(RECORDS):
        assert sorted(got.pop(i)) == sorted(want * (2 if i == 0 else 1))
    assert got == {110: [(0, "user", "\ufffd"), (1, "assistant", "a\x00")]} or {k: sorted(v) for k, v in got.items()} == {110: [(0, "user", "\ufffd"), (1, "assistant", "a\x00")]}
    why = {r["id"]: r["reason"] for r in unread.collect()}
    assert why == {**dict.fromkeys((100, 101, 102, 103, 104, 108, 109), "no object"), **dict.fromkeys((105, 106, 107), "unknown layout")}


def test_layout_goes_by_field_paths_only():
    known = chat.Mappings(chat.LAYOUTS)
    for record, name, _ in RECORDS:
        assert known.of(chat.json_paths(record))[1].name == name
    one, other = ({"messages": [{"role": r, "content": c}], "n": n} for r, c, n in (("a", "b", 1), ("x", None, "two")))
    assert known.of(chat.json_paths(one))[0] == known.of(chat.json_paths(other))[0]
    assert chat.fingerprint({"a.b"}) != chat.fingerprint({"a", "b"})


def test_tables_and_records_agree(spark):
    data = [(1, "sys", "do", "this", "out"), (2, None, None, "x", ""), (3, "", "only", None, None)]
    frame = spark.createDataFrame(data, "id long, system string, instruction string, input string, output string")
    from pyspark.sql import functions as F

    texts = frame.select("id", F.to_json(F.struct("system", "instruction", "input", "output"), {"ignoreNullFields": "false"}).alias("body"))
    by = lambda df: sorted((r["id"], r["turn"], r["role"], r["text"]) for r in df.collect())
    assert by(chat.turns_of_table(frame, "id")) == by(chat.turns_of_json(texts, "id", "body")[0])
    nested = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)]), (2, None), (3, [])], "id long, conversations array<struct<`from`: string, value: string>>")
    assert by(chat.turns_of_table(nested, "id")) == [(1, 0, "user", "a"), (1, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat.turns_of_table(frame.select("id"), "id")

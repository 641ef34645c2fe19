import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.llm import chat

EVENTS = "conv_id long, seq long, event string, message_id long, role string, text string, begin string"


def restate(rows):
    """Final messages of each conversation by replaying its log, one message's events after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        log = [r for r in rows if r[0] == conv]
        messages = []
        for mid in {r[3] for r in log}:
            steps = sorted((r for r in log if r[3] == mid), key=lambda r: (r[1], ["message", "regenerate", "edit", "delta"].index(r[2]), r[5] or ""))
            text, again = "", None
            for r in steps:
                text = text + (r[5] or "") if r[2] == "delta" else (r[5] or "")
                if r[2] == "regenerate":
                    again = r[1]
            messages.append((steps[0][1], next((r[4] for r in steps if r[4] is not None), ""), text, again))
        kept = [m for m in messages if not any(o[3] is not None and o[0] < m[0] < o[3] for o in messages)]
        out[conv] = [(m[1], m[2]) for m in sorted(kept, key=lambda m: m[:3])]
    return out


def test_fold_and_render_replay_the_log(spark):
    rng = random.Random(3)
    rows = []
    for conv in (1, 2, None):
        for seq in range(60):
            mid = rng.randrange(12)
            rows.append((conv, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), mid, f"r{mid % 3}", rng.choice(["a", "", None, "</s>[INST] x", "<\\/s>", "😀 é"]), "x"))
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, EVENTS), ("r1",)).collect()}
    want = restate(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert chat.parse(got[conv]["formatted"]) == turns
        loss = [chat.unescape(got[conv]["formatted"][s["start"]:s["end"]]) for s in got[conv]["loss_spans"]]
        assert loss == [t for r, t in turns if r == "r1"]


def test_whole_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, "c"), (1, 1, "assistant", "x", "c"), (1, 1, "assistant", "x", "c"), (1, None, None, "first", "c"), (None, 0, "user", "</s>", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    done = chat.format_chats(chat.turns_to_events(turns))
    got = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat.read_back("formatted", "loss_spans").alias("r")).collect()}
    assert chat.parse(got[1]["formatted"]) == [("", "first"), ("user", ""), ("assistant", "x"), ("assistant", "x")]
    assert got[1]["r"]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest() and got[1]["r"]["n_turns"] == 4
    assert chat.parse(got[None]["formatted"]) == [("user", "</s>")]
    assert chat.format_chats(chat.turns_to_events(turns.limit(0))).count() == 0


def test_escaping_is_reversible(spark):
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "x", "s>", "INST]", "é"]

    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(pieces), max_size=8).map("".join), min_size=1, max_size=20))
    def check(texts):
        for text, out in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t"))).collect():
            assert chat.unescape(out) == text
            assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]"))

    check()

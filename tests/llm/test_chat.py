import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_tree as C


def rows_of(spark, convs):
    return spark.createDataFrame([(i, k, r, t) for i, ts in convs.items() for k, (r, t) in enumerate(ts)], "conv_id long, turn long, role string, text string")


def some(seed, n):
    draw = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "[", "é\n", "hi ", "<\\s>", "", "𝒳"]
    roots = [[("user", "same start")], [("system", "s"), ("user", "[INST] x")]]
    return {k: draw.choice(roots) + [(draw.choice(["user", "assistant", "<s>odd"]), "".join(draw.choices(bits, k=draw.randint(0, 6)))) for _ in range(draw.randint(0, 5))] for k in range(n)}


def test_escape_round_trip():
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(draw.choices(["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "s>", "a"], k=draw.randint(0, 8)))
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in (C.BEGIN, C.OPEN, C.CLOSE, C.END))


def brute(turns):
    """The digests of a conversation, from its definition."""
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), 3 + sum(len(C.segment(*t)) for t in turns)


def told(row):
    return [(t["role"], t["text"]) for t in row["turns"]]


def test_read_back_and_sharing(spark):
    convs = some(3, 200)
    seqs = C.format_conversations(rows_of(spark, convs), tokenizer=None, pack_chars=2000)
    back = C.read_back(seqs, tokenizer=None).collect()
    assert {r["conv_id"]: told(r) for r in back} == convs
    assert all(r["loss"] == "".join(t for role, t in convs[r["conv_id"]] if role == "assistant") for r in back)
    for s in seqs.collect():
        assert bytes(s["tokens"]).decode() == s["text"]
        assert len(s["tokens"]) == len(s["position_ids"]) == len(s["loss_mask"])
        seen = set()
        for n in s["nodes"]:
            up = s["nodes"][n["parent"]] if n["parent"] >= 0 else None
            text = s["text"][n["char_start"] : n["char_end"]]
            assert (n["parent"], text) not in seen  # shared turns are emitted once
            seen.add((n["parent"], text))
            cover = lambda spans: [k for a in spans for k in range(a["start"], a["end"])]
            above = cover([*up["attends"], up]) if up else []
            assert cover(n["attends"]) == above and n["position"] == len(above)
            assert all(a["end"] < b["start"] for a, b in zip(n["attends"], n["attends"][1:], strict=False))
            assert s["position_ids"][n["start"] : n["end"]] == list(range(n["position"], n["position"] + n["end"] - n["start"]))
            role, said = C.parse_turns(text)[0]
            learned = bytes(x for x, m in zip(s["tokens"][n["start"] : n["end"]], s["loss_mask"][n["start"] : n["end"]], strict=True) if m).decode()
            assert learned == (C.escape(said) if role == "assistant" else "")  # no mark is under the mask


def test_loss_text_comes_from_the_mask(spark):
    convs = {1: [("user", "q"), ("assistant", "one"), ("user", "r"), ("assistant", "two </s>")]}
    seqs = C.format_conversations(rows_of(spark, convs))
    assert C.read_back(seqs).first()["loss"] == "onetwo </s>"
    unmasked = seqs.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.lit(False)))
    assert C.read_back(unmasked).first()["loss"] == ""
    shifted = seqs.withColumn("position_ids", F.transform("position_ids", lambda p: p + 1))
    with pytest.raises(Exception, match="position ids"):
        C.read_back(shifted).collect()


def test_long_conversations_are_cut_into_chapters(spark):
    draw = random.Random(8)
    convs = {k: [(draw.choice(["user", "assistant"]), draw.choice(["hi", "</s>", "x" * 40, ""]) + str(draw.randint(0, 3))) for _ in range(n)] for k, n in enumerate([900, 1, 400, 3])}
    convs[5] = convs[2]
    seqs = C.format_conversations(rows_of(spark, convs), pack_chars=3000, chapter_chars=1000)
    back = C.read_back(seqs)
    assert back.where("chapter > 0").count() > 20 and back.agg(F.max(F.length("formatted"))).first()[0] < 1500
    rows = C.conversation_digests(back).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in rows} == {k: brute(v) for k, v in convs.items()} and len(rows) == len(convs)


def test_edges(spark):
    many = [(3, k, "assistant", f"t{k}") for k in range(3000)]  # many turns, and extra columns of clashing names
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, "user", "x" * 300_000), *many], "conv_id long, turn long, role string, text string")
    df = df.withColumns({"chapter": F.lit("c"), "last": F.lit("l"), "path": F.lit("p"), "turns": F.lit("t")})
    back = C.read_back(C.format_conversations(df, tokenizer=None), tokenizer=None)
    want = {1: [("", ""), ("assistant", "a"), ("assistant", "a")], None: [("user", "x")], 2: [("user", "x" * 300_000)], 3: [("assistant", f"t{k}") for k in range(3000)]}
    assert {r["conv_id"]: told(r) for r in back.collect()} == want
    assert {r["conv_id"]: tuple(r)[1:] for r in C.conversation_digests(back).collect()} == {k: brute(v) for k, v in want.items()}
    assert C.conversation_digests(C.read_back(C.format_conversations(df.limit(0), tokenizer=None), tokenizer=None)).count() == 0

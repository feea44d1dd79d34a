import random
import re

from graphloom.llm import line_dedup as D


def windows(lines, long_words=D.LONG_WORDS):
    """(first line, number of lines) of every window of a text."""
    n = len(lines)
    out = [(at, min(3, n)) for at in range(max(n - 2, 1))] if n else []
    if n > 1 and long_words:
        out += [(k, 1) for k, line in enumerate(lines) if len(re.findall(r"[^ \t\n\x0b\f\r]+", line)) >= long_words]
    return [(at, n) for at, n in out if "".join(lines[at : at + n]).strip(" \t\n\x0b\f\r")]


def brute(docs, long_words=D.LONG_WORDS):
    """docs (id, text) after the cut, with n_lines and n_removed; ids are distinct and not null."""
    seen, out = set(), []
    for i, text in sorted(docs):
        lines = text.split("\n") if text is not None else []
        cut, own = set(), []
        for at, n in sorted(windows(lines, long_words)):
            w = tuple(lines[at : at + n])
            if w in seen:
                cut.update(range(at, at + n))
            else:
                own.append(w)
                seen.add(w)
        kept = [x for k, x in enumerate(lines) if k not in cut]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n_lines long, extra string")
    rows = D.dedup_lines(df)
    assert rows.columns.count("n_lines") == 1 and "extra" in rows.columns
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in rows.collect()], key=str)


def test_against_brute_force(spark):
    draw = random.Random(2)
    docs = [(k, "\n".join(draw.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(draw.randint(0, 30)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "one\ntwo"), (203, "\n".join(["same"] * 2000)), (204, "\n\n\n\n\n"), (205, "a\r\nb\r\nc\r\nd")]
    passage = ["p " * 49 + "end", "q " * 30 + "end", "r " * 200]
    docs += [(k, "\n".join(draw.choice(passage + [f"own {k}"]) for _ in range(draw.randint(1, 4)))) for k in range(300, 360)]
    assert run(spark, docs) == brute(docs)


def test_passage_across_documents(spark):
    passage = "p one\np two\np three\np four"
    got = run(spark, [(1, f"x\n{passage}\ny"), (2, f"{passage}\nz"), (3, f"q\nr\n{passage}")])
    assert got == [(1, f"x\n{passage}\ny", 6, 0), (2, "z", 5, 4), (3, "q\nr", 6, 4)]


def test_repeated_rows_null_ids_and_empty(spark):
    same = "a\nb\nc\nd"
    got = run(spark, [(5, same), (5, same), (None, same), (6, same)])
    assert [g for g in got if g[0] == 5] == [(5, "", 4, 4)] * 2 and (None, same, 4, 0) in got
    assert run(spark, []) == []


def test_long_lines_between_differing_neighbours(spark):
    long = " ".join(f"w{k}" for k in range(50))
    got = run(spark, [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, f"e\n{long[4:]}\nf")])
    assert got == [(1, f"a\n{long}\nb", 3, 0), (2, "c\nd", 3, 1), (3, "", 1, 1), (4, f"e\n{long[4:]}\nf", 3, 0)]
    rows = spark.createDataFrame([(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd")], "doc_id long, text string")
    assert {r["n_removed"] for r in D.dedup_lines(rows, long_words=None).collect()} == {0}


def test_a_very_long_text(spark):
    text = "\n".join(f"line {k % 30_000}" for k in range(60_000))
    got = run(spark, [(1, text)])[0]
    assert got[2:] == (60_000, 30_000) and got[1] == "\n".join(f"line {k}" for k in range(30_000))

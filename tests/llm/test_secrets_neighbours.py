"""Keys in typographic and unspaced text are candidates; keys that a letter continues are none."""

from graphloom.llm import secrets_scan as S


def test_neighbours_of_a_key():
    model = S.train_models(S.random_strings(3000, 1), S.identifiers(3000, 2))
    key = S.random_strings(3, 77)[2].strip(".-")
    for before, after in (("“", "”"), ("：", "。"), ("", "…"), ("‘", "’"), ("密钥是", "请保管"), ("１", ""), ("키", "는"), ("—", "—")):
        assert S.all_spans(f"{before}{key}{after}", model) == [(len(before), len(before) + len(key), "random")]
    for before, after in (("é", ""), ("", "é"), ("", "́"), ("ж", ""), ("", "ß")):
        assert S.all_spans(f"{before}{key}{after}", model) == []

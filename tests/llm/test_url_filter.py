import random

from graphloom.llm import url_filter as U


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h.count("."), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages, U.rules_frame(spark, rules)).collect()}


def test_against_brute_force(spark):
    draw = random.Random(4)
    labels, parts = ["a", "b", "com", "net", "www", "é"], ["", "/", "/en/", "/en/x", "/e", "/fr/", "/en/x/y"]
    rules = {(".".join(draw.choices(labels, k=draw.randint(1, 3))), draw.choice(parts)): draw.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ["http://" + ".".join(draw.choices(labels, k=draw.randint(1, 4))) + draw.choice(parts) + draw.choice(["", "?q=/en/", "#top", "z"]) for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://WWW.A.COM/en/", "x://a.com://b", "http://a..com./", "http://" + "a." * 3000 + "com/en/", "http://com/" + "z" * 20000, "ftp://com\n/en/"]
    got = judged(spark, urls, rules)
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_production_rules_and_repeats(spark):
    urls = ["http://www.example.com/en/1", "http://x.example.com/en/1", "http://example.com", "https://q.net/es/", "http://q.net/de/"] * 2
    got = judged(spark, urls, U.RULES)
    assert len(got) == 10
    assert [got[k][2:] for k in range(5)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), (None, "allow"), ("net/es/", "block"), (None, "allow")]


def test_empty_tables_and_null_rules(spark):
    assert judged(spark, [], U.RULES) == {}
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    assert judged(spark, ["http://a.com/"], [(None, "/", "block"), ("com", "/", "allow"), ("com", "/", "block")])[0][3] == "block"

import base64
import hashlib
import random

from graphloom.llm import secrets_scan as S


def brute(text, kind):
    """Base spans by hand-written scanning."""
    out, k = [], 0
    token = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while k < len(text):
        end = None
        if kind == "hex" and text[k] in "0123456789abcdef":
            end = k
            while end < len(text) and text[end] in "0123456789abcdef":
                end += 1
            fine = end - k >= 24
        elif kind == "access" and text.startswith("AKIA", k):
            end = k + 4
            while end < len(text) and (text[end].isascii() and (text[end].isdigit() or text[end].isupper())):
                end += 1
            fine = end - k >= 20
            end = None if end == k + 4 else end
        elif kind == "assign":
            for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if not low.startswith(name, k):
                    continue
                for quote in ((1, 0) if text[k + len(name) : k + len(name) + 1] in ('"', "'") and k + len(name) < len(text) else (0,)):
                    j = k + len(name) + quote
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] not in (":", "=") or j >= len(text):
                        continue
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    if j < len(text) and text[j] in "\"'":
                        j += 1
                    m = j
                    while m < len(text) and text[m] in token:
                        m += 1
                    if m > j:
                        end, fine = m, m - j >= 6
                        break
                if end:
                    break
        if end:
            if fine:
                out.append((k, end, kind))
            k = end
        else:
            k += 1
    return out


def test_base_against_brute_force():
    draw = random.Random(6)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", '"', "'", " ", "=", ":", "abc", "x1y2z3", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "ſecret", "deadbeef"]
    for _ in range(1500):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 14)))
        want = sorted(s for kind in ("assign", "access", "hex") for s in brute(text, kind))
        assert sorted(S.base_spans(text)) == want, text


def test_short_match_consumes():
    assert S.base_spans("secret: token: abcdefgh") == []
    assert S.base_spans("password = token=abcdefgh") == [(0, 25, "assign")]


def test_models_on_held_out_samples():
    model = S.train_models(S.random_strings(3000, 1), S.identifiers(3000, 2))
    rand, plain = S.random_strings(1000, 3), S.identifiers(1000, 4)
    assert sum(S.ratio(x, model) > S.MIN_RATIO for x in rand) >= 990
    assert sum(S.ratio(x, model) > S.MIN_RATIO for x in plain) <= 5


def unseen(draw):
    """Secrets in shapes that the samples do not have."""
    b58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    of = lambda chars, n: "".join(draw.choices(chars, k=n))
    yield "base58", of(b58, draw.randint(25, 50))
    yield "base32", of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", draw.randint(26, 40))
    yield "uuid", "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    yield "upper hex", of("0123456789ABCDEF", 40)
    yield "signed token", base64.urlsafe_b64encode(f'{{"alg":"HS256","sub":{draw.randint(0, 10**9)}}}'.encode()).decode().strip("=") + "." + base64.urlsafe_b64encode(draw.randbytes(32)).decode().strip("=")
    yield "prefixed", f"ghp_{of(b58, 36)}"


ORDINARY = """Kraftfahrzeughaftpflichtversicherung Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften Aufmerksamkeitsdefizitstoerung
Bundesausbildungsfoerderungsgesetz Grundstuecksverkehrsgenehmigungszustaendigkeit Geschwindigkeitsbegrenzung anticonstitutionnellement/intergouvernementalisation
electroencefalografista.contrarrevolucionario internationalization_localization_framework com.fasterxml.jackson.databind.ObjectMapper supercalifragilisticexpialidocious
www.example.com/articles/2023/11/how-to-build-things MAX_CONNECTION_POOL_SIZE_DEFAULT ______________________________ ======================== ................................
2023-01-01T00.00/2024-12-31 ABCDEFGHIJKLMNOPQRSTUVWXYZ usr/local/lib/python3.13/site-packages ProcessingInstructionTokenizerFactory""".split()


def test_precision_and_recall_on_unseen_shapes(spark):
    """Trained without words of the language of half of the ordinary strings, and on none of the secrets' shapes."""
    words = "der die das und versicherung gesellschaft bestimmung verordnung schrift grenze arbeit kraft fahrzeug geschwindigkeit aufmerksam bund les des une pour dans nation ment tion gouvernement".split()
    model = S.train_models(S.random_strings(4000, 7), S.identifiers(4000, 5) + S.marks(1000, 8) + words * 20 + S.identifiers(4000, 6, words))
    draw = random.Random(31)
    tried = [(shape, S.ratio(text, model) > S.MIN_RATIO) for _ in range(150) for shape, text in unseen(draw)]
    assert sum(found for _, found in tried) >= 0.99 * len(tried), [shape for shape, found in tried if not found]
    assert [w for w in ORDINARY if S.ratio(w, model) > S.MIN_RATIO] == []


def test_words_of_documents():
    assert S.plain_words("Über größe, token=abcdefgh naïve. a1b2c3 x.y End") == ["Uber", "grosse", "naive", "End"]


def test_query_columns_and_edges(spark, prose, docs_schema):
    key = S.random_strings(3, 77)[2]
    hexa = hashlib.md5(b"x").hexdigest()
    texts = [None, "", f"see {key} here", f"token = {hexa} é", f"è{key}", "AKIA" + "Z" * 16 + " ", "getCustomerAccountBalanceFilter", prose(1, 3000) + " " + key]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(2, texts[2], "en", "s", 1)], docs_schema)
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    got = S.scan_secrets(docs.withColumn("secrets", docs.lang), S.build_model(docs, labels))
    rows = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in got.collect()}
    assert got.count() == 9 and rows[0] == rows[1] == rows[4] == rows[6] == []
    assert rows[2] == [("random", 4, 4 + len(key))]
    assert rows[3] == [("assign", 0, 40), ("hex", 8, 40)]
    assert rows[5] == [("access", 0, 20)] and rows[7][0][0] == "random"
    assert S.all_spans(f"{key}é", S.train_models(S.random_strings(500, 1), S.identifiers(500, 2))) == []
    red = {r["doc_id"]: r["text"] for r in S.redact(got, "secrets").collect()}
    assert red[3] == "[SECRET] é" and red[0] is None
    assert S.scan_secrets(docs.limit(0), S.build_model(docs.limit(0), labels)).count() == 0

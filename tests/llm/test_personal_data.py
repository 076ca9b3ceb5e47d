import re

from echolattice.llm import personal_data as pd
from hypothesis import example, given, settings
from hypothesis import strategies as st

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and plain_luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text("aZ0159.@-+ ()_%é\n", max_size=40))
@example("a@b.c@d.e x@y a.b@c.d.e, @z.z .@-.-")
@example("1.2.3.4.5.6.7.8 999.1.1.1 0000255.0.0.1 1..2.3.4")
@example("4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000 +1 (988) 555-2485 +123 4111111111111111")
@example("+1 (706) 555-3138 4644348398010899")
def test_base_spans(t):
    assert [s[:3] for s in pd.find(t) if s[0] in pd.BASE] == plain(t)


def test_iban_and_context():
    t = "Bank account DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; card: 4111111111111111"
    found = {s[0]: s for s in pd.find(t)}
    assert t[found["iban"][1] : found["iban"][2]] == "DE89 3704 0044 0532 0130 00" and found["iban"][3] == 1.0
    assert abs(found["card"][3] - 0.9) < 1e-9
    assert [s[0] for s in pd.find(t)].count("iban") == 1
    assert pd.redact("write to a.b@c.de or +1 (988) 555-2485!") == "write to [email] or [phone]!"


def test_iban_before_other_words():
    for code in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for behind in ("", " Please pay", " The bank", " 2024", " IBAN", " 2024 IBAN OK", " DE88 3704", "."):
            for before in ("", "AB12 ", "AB12 3456 "):
                assert [s[:3] for s in pd.find(before + code + behind) if s[0] == "iban"] == [("iban", len(before), len(before + code))]
    two = "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"
    assert [two[a:b] for k, a, b, _ in pd.find(two) if k == "iban"] == [two[:27], two[28:]]
    assert not [s for s in pd.find("DE88370400440532013000 Please pay, DE89370400440532013000X") if s[0] == "iban"]


def test_context_decides_on_added_kinds():
    code = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for ahead in ("token = ", 'api_key: "', "Password ", "x" * 500 + " secret="):
        t = ahead + code + " end"
        assert [(k, t[a:b], s) for k, a, b, s in pd.find(t)] == [("secret", code, 0.5)]
    for ahead in ("", "commit ", "tokens ", "my_token ", "token " + "x" * 48 + " ", "token g"):
        assert not pd.find(ahead + code)
    assert not [s for s in pd.find("key " + "1" * 40 + " key " + "a" * 40 + " key " + "1a" * 15 + " key " + "1a" * 40) if s[0] == "secret"]
    assert [s[0] for s in pd.find("token _" + "1a" * 16 + "_, IBAN _DE89370400440532013000_")] == ["iban", "secret"]
    assert pd.redact(f'token = "{code}"') == 'token = "[secret]"'


def test_scores_like_sql(spark, tmp_path):
    import compare

    code = "0123456789abcdef" * 2
    texts = ["token " * k + f"{'y' * j} {code} _{code}_ mail a@b.cd, call: +1 (988) 555-2485, Bank DE89370400440532013000. ip 1.2.3.4" for k in range(3) for j in range(35, 45)]
    texts += ["é" * j + f" key {code}é{code}" for j in range(40, 50)] + [f"key{code}", f" KEY\n{code}", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not compare.difference(pd.op5_personal_data(spark, str(tmp_path)), con, pd.ORACLE)


def test_linear_on_long_runs():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "A" * 300_000, "a@" * 100_000, "-" * 300_000 + "@-"):
        pd.find(t)


def test_query(spark, tmp_path, docs, corpus):
    import hashlib
    from collections import Counter

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t, *_ in corpus:
        s = [f"{k}:{a}:{b}" for k, a, b in plain(t or "")]
        want[i, hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["base_sha256"]) for r in pd.op5_personal_data(spark, str(tmp_path)).collect()) == want


def test_empty(no_docs):
    assert pd.find_personal_data(no_docs).count() == 0

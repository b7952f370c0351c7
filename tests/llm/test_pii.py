import random
import re
from hashlib import sha256

from gaugeworks.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + j % 2), 10)) for j, x in enumerate(reversed(d))) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_expressions():
    random.seed(3)
    for _ in range(6000):
        text = "".join(random.choice(["1", "22", "4111", "0", ".", "-", " ", "+", "(", ")", "a", "@", "b.c", "é", "255", "%", "\n"]) for _ in range(random.randint(0, 40)))
        found = [x[:4] for x in pii.find(text) if x[3] in pii.BASE]
        assert found == plain(text), text


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    kinds = lambda t: [x[3] for x in pii.find(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 OK") == kinds("gb82west12345698765432 bank") == ["iban"] and kinds("iban GB82 WEST 1234 5698 7654 321") == []
    assert kinds("555-123-4567 is my phone") == ["phone_local"]
    assert kinds("call 555-123-4567") == ["phone_local"] and kinds("xx 555-123-4567") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("123-45-6789") == []


def test_long_runs_take_one_pass():
    assert pii.find("1" * 300_000) == [] and pii.find("a" * 300_000) == [] and pii.find("1." * 100_000)[0][3] == "ip"


def test_rows(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (2, None, None), (3, "", "y"), (None, "+1 (743) 555-3824", "z")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"), redacted=True).collect()
    assert [(r.doc_id, r.n_email, r.n_phone, r.spans, r.text) for r in out] == [
        (1, 1, 0, "email:0:6", "<email>"), (1, 1, 0, "email:0:6", "<email>"), (2, 0, 0, "", None), (3, 0, 0, "", ""), (None, 0, 1, "phone:0:17", "<phone>"),
    ]
    assert out[3].base_sha256 == sha256(b"").hexdigest()
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_querys_columns_are_those_of_the_plain_expressions(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.query(spark, sf).collect():
        want = plain(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in PLAIN]
        assert set(said.split(",")) <= set(r.spans.split(",")) and r.spans.count(":") == 2 * len([x for x in r.scores.split(",") if x])

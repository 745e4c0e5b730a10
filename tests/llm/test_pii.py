import hashlib
import random
import re
import time

import duckdb
import pandas as pd
import pytest

from quire.llm import pii
from quire.llm.queries import ORACLES

CARD = "4539578763621486"
SCHEMA = "doc_id long, text string, spans int, kind string, Text2 string"


def checked(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    """The contract's expressions as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ways = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and checked(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, *m.span()) for k, p, ok in ways for m in re.finditer(p, text) if ok(m)]


TEXTS = [
    None, "", " ", "nothing here", "a@b", "a@b.c", "a@b.c.d@e.f", "x a@b.c_d@e.f", "@b.c", "a@@b.c", "a@b..c", "é.a-b+c%@x-y.de. ü", "a@b.c-d@e.fr",
    "1.2.3.4", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.0000255", "1.2.3", "999.1.2.3.4", "v1.2.3.4 version", "1.2.3.99999999999999999999",
    CARD, f"{CARD}5", "4539 5787-6362 1486", "4539  578763621486", f"-{CARD}-", f"1 {CARD}", "0" * 16, "0" * 19, "0" * 20, "4539578763621486 4539578763621486",
    "+1 (564) 555-4526", "+1 23", "+12345678", "++12345678 ", "+1 (564) 555-4526 99999999", "+1-", "+123456789012345", "+1234567890123456", "+1 2+3 4567890",
    "my iban is DE89 3704 0044 0532 0130 00 IN all", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32 for", "GB82WEST12345698765433", "NO93 8601 1117 947 THE", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
    "ssn 123-45-6789.", "123-45-6789", "social security: 000-45-6789 and 123-00-6789, 987-65-4321", "ssn 1-123-45-6789 123-45-6789-1", "call 555-123-4567 or 555 1234", "555-123-4567", "phone " + "x" * 60 + " 555-123-4567",
    "tel 4539 5787 6362 1486", "hotel 555-1234", "TELÉFONO 555.123.4567 fax", "mail me at a@b.c from 10.0.0.1 or call +1 (564) 555-4526 with card " + CARD, "😀 a@b.c 😀 +12345678", "aa123-45-6789 ssn",
]


def mixed(n, seed):
    rng = random.Random(seed)
    parts = ["a", "@", ".", "b.c", "1", "12", "255", "300", " ", "-", "+1", "(", ")", CARD, "é", "ssn ", "123-45-6789", "555-1234", "call ", "GB82WEST12345698765432", "_", "%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def found(spark, texts):
    rows = [(i, t, 1, "k", "z") for i, t in enumerate(texts)]
    return pii.find(spark.createDataFrame(rows, SCHEMA))


def test_base_spans_are_the_contracts(spark):
    texts = TEXTS + mixed(400, 1)
    got = {r["doc_id"]: r for r in pii.digests(found(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain(t or "")
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert got[i]["spans"] == told or got[i]["spans"].startswith(told)


def test_equals_sql_with_the_added_kinds(spark):
    texts = TEXTS + mixed(300, 2)
    got = sorted(map(tuple, pii.digests(found(spark, texts)).collect()))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = sorted(tuple(r) for r in duckdb.sql(ORACLES["op13_pii"]).fetchall())
    assert got == want
    spans = ",".join(r[-1] for r in got)
    assert all(f"{k}:" in spans for k in pii.ADDED)


def test_validators_and_context():
    assert [x[:3] for x in pii.spans("iban GB82 WEST 1234 5698 7654 32 for")] == [("iban", 5, 32)]
    assert pii.spans("GB82WEST12345698765433") == []
    assert pii.spans("123-45-6789") == [] and [x[0] for x in pii.spans("her ssn: 123-45-6789")] == ["national_id"]
    assert [x[0] for x in pii.spans("tel 4539 5787 6362 1486")] == ["card"]  # what a base span holds is not told again
    low, high = pii.spans("version 1.2.3.4")[0][3], pii.spans("server 1.2.3.4")[0][3]
    assert low < pii.SCORE["ip"] < high


def test_redacts(spark):
    docs = spark.createDataFrame([(1, "a@b.c is +12345678!", 1, "k", "z"), (2, None, 1, "k", "z"), (3, "x", 1, None, "z"), (3, "x", 1, None, "z")], SCHEMA)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["[EMAIL] is [PHONE]!", None, "x", "x"]


def test_empty_and_repeated_rows(spark):
    assert found(spark, []).count() == 0 and pii.redact(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert [len(r["spans"]) for r in pii.find(rows).collect()] == [1, 1, 1]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "a@" * 1_000_000, "a@b." * 500_000, "+1" * 1_000_000, "+1 " * 600_000, "A1" * 1_000_000, "+1" + " " * 2_000_000, "AA11 " * 400_000, "1-" * 1_000_000, "a@b.c" * 300_000])
def test_linear_in_long_runs(text):
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 15

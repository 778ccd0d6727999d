"""Secrets that start inside runs or behind candidates that fail; the query's columns against plain Python."""

import base64
import random
import re
import time
from collections import Counter

import pytest

from tests.llm.test_secrets import CASES, PKCS1, PKCS8, SEC1, b64, plain_base, url, wrapped
from tidemark.llm import registry
from tidemark.llm import secrets as S

TOKEN = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}.c2ln"


def found(text):
    return [text[s:e] for _, s, e in S.confirmed_spans(text)]


def test_failed_token_candidates_hide_nothing():
    assert found(f"eyAAAAAAAAAA.eyBBBB.{TOKEN}") == [TOKEN] and found(f"{TOKEN}.{TOKEN}") == [TOKEN] * 1 + [TOKEN] * 1
    assert found(f"a.b.c.{TOKEN}.x") == [TOKEN] and found(f"id-{TOKEN}") == [TOKEN] and found(f"eyeyey{TOKEN} {TOKEN}") == [TOKEN] * 2


def test_keys_inside_runs():
    for key in (PKCS1, PKCS8, SEC1):
        t = b64(key).rstrip("=")
        for before in ("/", "path/", "MMMM", "abcMII", "b3Bl"):
            assert found(f"x {before}{t} y") == [t], before
        h = key.hex()
        assert found(f"0x{h}") == [h] and found(f"ab30{h}") == [h] and found(f"{h.upper()}ff") == [h.upper()]
    t = wrapped(b64(PKCS8), 64)
    assert found(f"/{t}\n") == [t] and found(f"{b64(SEC1).rstrip('=')}/{b64(PKCS1)}")[0] == b64(SEC1).rstrip("=")


def test_long_runs_without_keys():
    assert found("M" * 200_000) == [] and found("eyJ" * 50_000 + ".eyJ.") == [] and found("30" * 100_000) == [] and found("MIIB" * 20_000) == []


HEADS = b"\x30\x82\x1f\xff\x02\x01\x00\x02\x82\x10\x00" + bytes(10)
LONG = {
    "letters without a dot": "a" * 10**6 + " x. ey",
    "header starts": "ey" * 500_000 + f".{url({'sub': 1})}.x",
    "nested header": base64.urlsafe_b64encode(b'{"a":' * 150_000 + b"}").decode().rstrip("=") + f".{url({'sub': 1})}.x",
    "key starts": "MIIf" * 250_000,
    "key starts, wrapped": wrapped("MIIf" * 250_000, 64),
    "key heads": b64(HEADS * 36_000),
    "key heads, wrapped": wrapped(b64(HEADS * 36_000), 64),
    "magic, wrapped": wrapped("b3BlbnNzaC1rZXktdjEAAAAA" * 40_000, 72),
    "hex key starts": "3082FFFF" * 125_000,
    "hex key heads": (HEADS * 24_000).hex().upper(),
}


@pytest.mark.parametrize("shape", LONG)
def test_a_megabyte_is_read_in_linear_time(shape):
    """Ten times the text takes about ten times as long, and no shape takes seconds; a secret behind it is still found."""
    text = LONG[shape]
    took = []
    for t in (text[-(len(text) // 10) :], text):
        began = time.process_time()
        assert found(f"{t}\n. {TOKEN} ")[-1] == TOKEN
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.02) and took[1] < 5, took


def test_redacting_a_long_row(spark):
    rows = [(1, f"{LONG['key starts']} {TOKEN}", 1), (2, LONG["header starts"], 2)]
    got = {r.doc_id: r.text for r in S.redact_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: f"{LONG['key starts']} [token]", 2: LONG["header starts"]}


def test_only_objects_that_end_the_header_are_tried():
    rng = random.Random(9)
    for _ in range(3000):
        data = "".join(rng.choices(['{', '}', '"', '"a":', "\\", "1", ",", "[", "]", " ", '{"alg":"x"}'], k=rng.randrange(1, 14))).encode()
        want = [i for i in range(len(data)) if data[i : i + 1] == b"{" and S._json_object(base64.urlsafe_b64encode(data[i:]).decode().rstrip("=")) is not None]
        assert set(want) <= set(S.whole_objects(data)), data


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(3)
    parts = [*CASES, TOKEN, b64(PKCS1), SEC1.hex(), "prose and é more", f"eyAAAAAAAAAA.eyBBBB.{TOKEN}", "z" * 5000]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 5))), i) for i in range(80)] + [(None, "AKIA1234567890ABCD", 1), (3, None, 1), (4, "", 1), (5, CASES[3], 1), (5, CASES[3], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_hex long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op9_secrets"](spark, str(tmp_path)).collect()
    key = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    order = ("assign", "access", "hex", "token", "pem", "key64", "keyhex")
    want = []
    for i, t, _ in rows:
        base = plain_base(t or "")
        n = Counter(k for k, *_ in base)
        more = [("token", m.start(), m.end()) for m in re.finditer(re.escape(TOKEN), t or "")]
        more += [("key64", m.start(), m.end()) for m in re.finditer(re.escape(b64(PKCS1)), t or "")]
        more += [("keyhex", m.start(), m.end()) for m in re.finditer(SEC1.hex(), t or "")]
        want.append((str(i), n["assign"], n["access"], n["hex"], key(sorted(base + more, key=lambda s: (s[1], order.index(s[0]))))))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.spans) for r in got) == sorted(want)


def test_redacted_rows(spark):
    rows = [(1, None, None, 5), (2, "", 0, 5), (3, f"a {TOKEN} b", 7, 5), (3, f"a {TOKEN} b", 7, 5), (4, "clean", None, 5)]
    got = S.redact_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, None, 5), (2, "", 0, 5), (3, "a [token] b", 11, 5), (3, "a [token] b", 11, 5), (4, "clean", None, 5)], key=str)

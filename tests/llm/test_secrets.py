import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.secrets import BASE, MORE, Rule, trigram_query

ASSIGN = re.compile(re.sub(r"\(\?i:(.*?)\)\)", lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1]) + ")", BASE[0].pattern))


def plain(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found += [(m.start(), 3 + i, m.end()) for i, r in enumerate(MORE) for m in re.finditer(r.pattern, t)]
    return sorted(found)


PARTS = ["token", "Secret", "API_KEY", "apikey", "password", "passwd", "=", ": ", '"', "'", " ", "  ", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "漢😀", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "x" * 36, "xoxb-1234567890ab", "eyJhbGciOiJ9.eyJzdWIiOiIx.abc", "token=token = abcdefgh", "ſecret=abcdef"]


def test_spans_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "token=", "token=abcde", "token=abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24, "token=" + "secret=" * 700, "token = abcdef1\n" * 700]
    texts += ["".join(r.choices(PARTS, k=r.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, *texts[:20]])], "i long, text string, rules string")
    for x in secrets.scan(df).collect():
        assert [tuple(s) for s in x.spans] == plain((texts + texts[:20])[x.i]), (texts + texts[:20])[x.i]
        assert x.rules == "k"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("AKIA[A-Z0-9]+", [{"aki", "kia"}]),
        ("[0-9a-f]{24,}", None),
        ("ab+cde", [{"cde"}]),
        ("abc|xyz+", [{"abc"}, {"xyz"}]),
        ("abc|xy", None),
        ("a(bc|d)?ef", [{"abc", "bce", "cef"}, {"ade", "def"}, {"aef"}]),
        ("(?i:Tok)en", [{"tok", "oke", "ken"}]),
        ("x[ab]yz", [{"xay", "ayz"}, {"xby", "byz"}]),
    ],
)
def test_trigram_query(pattern, want):
    got = trigram_query(pattern)
    assert (got if got is None else sorted(map(sorted, got))) == (want if want is None else sorted(map(sorted, want)))


def test_rules_without_trigrams_scan_all(spark):
    df = spark.createDataFrame([("xay",), ("z",), (None,)], "text string")
    got = secrets.scan(df, rules=(Rule("short", "a."),)).collect()
    assert [[tuple(s) for s in x.spans] for x in got] == [[(1, 0, 3)], [], []]


def test_redaction(spark):
    key = "AKIA" + "B" * 16
    df = spark.createDataFrame([(1, f"é token={key}. x", 9), (2, None, None), (None, "clean", 5), (1, f"a {'0' * 30} b\n{key}", 0)], "doc_id long, text string, n_chars long")
    out = secrets.redacted(df)
    assert out.columns == df.columns
    assert sorted(x.text or "" for x in out.collect()) == sorted(["é [assign] x", "", "clean", "a [hex] b\n[access]"])
    assert secrets.redacted(df.limit(0)).count() == 0


def test_op4_columns(spark, tmp_path):
    import hashlib

    key = "AKIA" + "C" * 16
    df = spark.createDataFrame([(1, f"a {key} ghp_{'x' * 36} token: {'f' * 30}"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in secrets.op4(spark, str(tmp_path)).collect()}
    base = "access:2:22,assign:64:101,hex:71:101"
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].base_sha256) == (1, 1, 1, hashlib.sha256(base.encode()).hexdigest())
    assert got[1].spans == "access:2:22,github:23:63,assign:64:101,hex:71:101"
    assert (got[2].n_assign, got[2].base_sha256, got[2].spans) == (0, hashlib.sha256(b"").hexdigest(), "")
    assert F is not None

import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from pagefold.llm import secrets

R = random.Random(9)
HEX40 = "".join(R.choices("0123456789abcdef", k=40))
B64 = "aB3" + "".join(R.choices(string.ascii_letters + string.digits + "+/", k=61))
KEY = "AKIA" + "".join(R.choices(string.ascii_uppercase + string.digits, k=16))
TEXTS = [
    "", None, "nothing here", f'token = "{HEX40}" and more', f"é🙂 PassWord:hunter2222 {KEY} x", "token: \"secret\": \"abcdefgh123", "api_key=short apikey = 'longenough1'",
    f"{HEX40}{HEX40}", f"x{HEX40}", "AKIA" + "A" * 11, "AKIA" + "A" * 12, f"{B64} stands alone", "aaaa1111bbbbAAAA" * 6, "some-long-hyphenated-Word-2-with-many-parts-in-it-and-more",
    f"secret={B64}=={HEX40}", "ſecret=abcdefghijk Toſen", f"tokentoken=={HEX40}", "word " * 30_000 + HEX40,
]
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def frame(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, f"passwd=abcdefgh {B64}", "c"), (3, TEXTS[3], "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, found string")


def test_base_spans(spark):
    rows, df = frame(spark)
    got = sorted((tuple(r)[:5] for r in secrets.secret_rows(df).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        b = brute(t)
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((i, *(sum(x[1] == k for x in b) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_added_spans(spark):
    _, df = frame(spark)
    by = {r.doc_id: r.spans for r in secrets.secret_rows(df).collect()}
    assert by[11] == f"random:0:{len(B64)}"
    assert "random" not in by[12] and "random" not in by[13] and by[2] == ""
    assert by[3].startswith("assign:0:")


def identifiers():
    """Long names of Python's standard library, and paths and names of the kinds that scanners trip over; none is made of the decoys' words on purpose."""
    import asyncio
    import http.client
    import inspect
    import signal
    import socket
    import ssl
    import unittest
    import urllib.request
    import xml.dom.minidom

    names = set()
    for module in (asyncio, http.client, inspect, signal, socket, ssl, unittest, urllib.request, xml.dom.minidom):
        for n in dir(module):
            names.add(n)
            if isinstance(x := getattr(module, n), type):
                names |= set(dir(x))
    more = """getUserAccountById2FromDatabase AbstractSingletonProxyFactoryBean2Impl HttpServletRequest2WrapperFactory src/main/java/com/Example2/Service Donaudampfschifffahrtsgesellschaft2Kapitaen
    some-long-hyphenated-Word-2-with-many-parts my_Variable_name_with_Number_12_in_it usr/local/lib/python3/site-packages/Numpy application/vnd-Openxmlformats2/document"""
    return sorted({n for n in names if len(n) >= 20}) + more.split()


def test_false_discoveries_and_recall(spark):
    """Of what is reported among ordinary names and random strings, at most 2 in 100 are ordinary; of random strings of 32 characters on, 95 in 100 are found."""
    r = random.Random(11)
    rows = [(t, 0) for t in identifiers()] + [("abcdefghij0123456789" * 3, 0), ("1A" * 30, 0), ("0123456789ABCDEF" * 4, 0)]
    for name, _, alphabet in secrets.ENCODINGS:
        if name != "hex":  # base spans
            rows += [("".join(r.choices(alphabet, k=n)), n) for n in (24, 32, 40, 64, 200) for _ in range(10)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int").repartition(4)
    hit = {x.doc_id for x in secrets.secret_rows(df).where("spans <> ''").collect()}
    ordinary = [i for i, (t, y) in enumerate(rows) if not y and i in hit and not brute(t)]
    long = [i for i, (_, y) in enumerate(rows) if y >= 32]
    assert len(ordinary) <= 0.02 * len(hit), [rows[i][0] for i in ordinary]
    assert sum(i in hit for i in long) >= 0.95 * len(long)


def test_ordinary_names_alone(spark):
    """Without secrets nothing, or next to nothing, is reported."""
    rows = [(i, t) for i, t in enumerate(identifiers())]
    hit = secrets.secret_rows(spark.createDataFrame(rows, "doc_id long, text string")).where("spans <> ''").collect()
    assert len([x for x in hit if not brute(rows[x.doc_id][1])]) <= 1


def test_tests_against_plain_python(spark):
    r = random.Random(12)
    alphabet = secrets.ENCODINGS[6][2]
    assert secrets.ENCODINGS[6][0] == "base62"
    texts = ["".join(r.choices(alphabet, k=n)) for n in (20, 33, 64, 511, 512, 513, 2000)] + ["Word1" * 12, "aB3" * 400]
    s, n = F.col("s"), F.length("s").cast("double")
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", secrets.uniformity(s, F.lit(alphabet), n, F.lit(62.0)), secrets.evenness(s, F.lit(alphabet), n, F.lit(62.0)), secrets.runs(s, n), secrets.correlation(s, n)).collect()

    def two_sided(z):
        return math.erfc(abs(z) / math.sqrt(2))

    def upper(square, df):
        v = 2 / (9 * df)
        return math.erfc(((max(square, 0) / df) ** (1 / 3) - (1 - v)) / math.sqrt(v) / math.sqrt(2)) / 2

    for t, u, e, q, c in got:
        m = len(t)
        assert close(u, upper(sum((t.count(x) - m / 62) ** 2 / (m / 62) for x in alphabet), 61))
        pools = [(sum(x in p for x in t), sum(x in p for x in alphabet) / 62) for p in secrets.POOLS]
        assert close(e, upper(sum((o - m * w) ** 2 / (m * w) for o, w in pools if w), sum(w > 0 for _, w in pools) - 1))
        bits = [x in "aeiouAEIOU01234" for x in t]
        o = sum(bits)
        mean = 2 * o * (m - o) / m + 1
        assert close(q, two_sided((1 + sum(a != b for a, b in zip(bits, bits[1:], strict=False)) - mean) / math.sqrt((mean - 1) * (mean - 2) / (m - 1))))
        xs = [ord(x) for x in t]
        mu = sum(xs) / m
        lag = sum((a - mu) * (b - mu) for k, (a, b) in enumerate(zip(xs, xs[1:], strict=False), 1) if k % secrets.BLOCK)
        assert close(c, two_sided((lag / sum((x - mu) ** 2 for x in xs) + 1 / m) * math.sqrt(m)))


def close(a, b):
    return abs(a - b) <= 2e-6 + 0.02 * b or max(a, b) < 1e-6


def test_a_very_long_run(spark):
    """A run of a million characters is one candidate, tested whole."""
    r = random.Random(13)
    text = "x " + "".join(r.choices(string.ascii_letters + string.digits, k=1_000_000)) + " y"
    got = secrets.secret_rows(spark.createDataFrame([(1, text), (2, "Word1" * 200_000)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.spans for x in got} == {1: "random:2:1000002", 2: ""}


def test_redact(spark):
    rows, df = frame(spark)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].text == '<SECRET>" and more' and by[3].n_chars == len(by[3].text)
    assert by[2].text == "nothing here" and by[1].text is None and by[0].text == ""
    assert by[17].text == "word " * 30_000 + "<SECRET>" and by[11].text == "<SECRET> stands alone"
    for r in by.values():
        assert not brute(r.text)
    assert secrets.redact(df.limit(0)).count() == secrets.secret_rows(df.limit(0)).count() == 0

import hashlib
import random
import re

from pyspark.sql import functions as F

from pagefold.llm import fingerprints

PARAGRAPH = re.compile(fingerprints.PARAGRAPH)


def brute(rows):
    """(doc_id, n_chars, sha, near_edited, near_next) of every row, from the paragraphs themselves."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        a, e, n = (set(PARAGRAPH.findall(x)) for x in (t, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, e), 9), round(like(a, n), 9)))
    return sorted(out, key=repr)


def texts(r):
    sentence = lambda: " ".join("".join(r.choices("abcdeé🙂", k=r.randint(1, 9))) for _ in range(r.randint(1, 30))) + r.choice([". ", "! ", "\n", "\n\n", "? "])
    out = ["", None, "\n\n\n", "abc", "abcd", "é🙂" * 30, "no end " * 800]
    out += ["".join(sentence() for _ in range(r.randint(1, 25))) for _ in range(30)]
    long = [sentence() for _ in range(900)]
    return out + ["".join(long), "".join(long[:700] + long[720:]), out[9], out[10] + "tail"]


def check(got, rows):
    mine = sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr)
    assert mine == brute(rows)


def test_rows(spark):
    r = random.Random(12)
    ts = texts(r)
    rows = [(i * 7 - 20, t) for i, t in enumerate(ts)] + [(None, "first by order. " * 20), (1, "again one"), (1, "again one"), (1, "other")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, bucket string")
    got = fingerprints.fingerprint_rows(df).collect()
    check(got, rows)
    same = [x.fingerprint for x in got if x.doc_id == 1]
    assert len(same) == 4 and len(set(same)) == 3


def test_few_rows(spark):
    for rows in ([], [(5, "one alone. " * 30)], [(5, "a b"), (5, "a b")], [(None, "x" * 50), (None, None)], [(9, "nine " * 30), (-9, "minus " * 90)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        check(fingerprints.fingerprint_rows(df).collect(), rows)


def test_peeling_recovers_the_differing_digests(spark):
    a, b = [f"paragraph {k}." for k in range(40)], [f"paragraph {k}." for k in range(3, 44)]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    keys = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    found = df.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(fingerprints.items(keys(F.col("a")))), fingerprints.sketch(fingerprints.items(keys(F.col("b")))))).alias("x"), keys(F.array_except("a", "b")).alias("up"), keys(F.array_except("b", "a")).alias("down")).first()
    assert sorted((x.key, x.n) for x in found.x) == sorted([(k, 1) for k in found.up] + [(k, -1) for k in found.down])


def test_sketches_alone_recover_every_difference(spark):
    """Unlike texts of many sizes: the digests found are those that differ, whatever level that takes."""
    r = random.Random(20)
    piece = lambda k: f"paragraph {k} of some.\n"
    rows = []
    for n in (0, 1, 5, 15, 30, 60, 120, 700, 3000):
        for share in (0.0, 0.3, 1.0):
            a = [piece(k) for k in range(n)]
            b = [piece(k if r.random() > share else k + 100_000) for k in range(n)]
            rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    got = df.select("a", "b", fingerprints.differing(F.col("a"), F.col("b")).alias("x"), fingerprints.digests(F.col("a")).alias("p"), fingerprints.digests(F.col("b")).alias("q")).collect()
    levels = set()
    for x in got:
        levels.add(x.x.level)
        assert sorted((d.key, d.n) for d in x.x.digests) == sorted([(k, 1) for k in set(x.p) - set(x.q)] + [(k, -1) for k in set(x.q) - set(x.p)])
    assert {0, 1} <= levels and max(levels) >= 2


def test_digests_that_share_all_cells(spark):
    """Keys equal in every bit but two are told apart after as many rounds as it takes."""
    keys = [(1 << 63) - 1, (1 << 63) - 1 - (1 << 36), (1 << 63) - 1 - (1 << 37), 5, 5 | 1 << 38, 5 | 1 << 39]
    df = spark.createDataFrame([(keys[:3], keys[3:]), (keys, []), ([], keys[:2])], "a array<long>, b array<long>")
    side = lambda c: fingerprints.items(F.col(c))
    got = df.select("a", "b", fingerprints.difference(side("a"), side("b"), fingerprints.sketch(side("a")), fingerprints.sketch(side("b"))).alias("x")).collect()
    for x in got:
        assert sorted((d.key, d.n) for d in x.x.digests) == sorted([(k, 1) for k in x.a] + [(k, -1) for k in x.b])
    assert max(x.x.level for x in got) > 2


def test_a_very_long_text(spark):
    text = "".join(f"Sentence {k} says nothing much of note. " + ("\n" if k % 7 == 0 else "") for k in range(30_000))
    rows = [(1, text), (2, text[:600_000] + "cut"), (3, None)]
    check(fingerprints.fingerprint_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)

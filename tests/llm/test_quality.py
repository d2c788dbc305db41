import random
import re

from pagefold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def texts():
    r = random.Random(3)
    out = ["", " ", "\n\n", None, "a b c d e f g h a b c d e f g h", "é \x85 \xa0x y\x0b\x1cz", "x\n x\nx\n\nx", "##**|<>&%$"]
    out += [" ".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(30)]
    out += ["".join(r.choices(["wörd ", "\n", "other ", "#", "日本 ", "\t"], k=r.randint(0, 200))) for _ in range(30)]
    return out


def test_base_equals_brute_force():
    for t in texts():
        assert quality.base((t or "").encode()) == brute(t), repr(t)


def corpus(seed, n):
    r = random.Random(seed)
    good = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "and", "of", "the", "ö"], k=r.randint(25, 80))) for _ in range(n)]
    bad = [" ".join(x + r.choice(["!!", "***", "%%%"]) for x in r.choices(["ALPHA", "beta", "gamma", "delta"], k=r.randint(25, 80))) for _ in range(n // 3)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad]
    r.shuffle(rows)
    return rows


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(1, 240)
    df = spark.createDataFrame([(i, t, "c") for i, (t, _) in enumerate(rows)] + [(None, "null id " * 30, "c"), (5, None, "c")], "doc_id long, text string, found string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (7, None), (10**6, 0)], "doc_id long, quality int")
    model = quality.train(df, labels)
    test = corpus(2, 200)
    p = model.probabilities([t.encode() for t, _ in test])
    y = [y for _, y in test]
    assert sum((a >= 0.5) == b for a, b in zip(p, y, strict=True)) / len(y) > 0.97
    assert sum((a - b) ** 2 for a, b in zip(p, y, strict=True)) / len(y) < 0.05
    kept = quality.keep_quality(df, labels)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    repeats = {i for i, (t, _) in enumerate(rows) if 100 * brute(t)[4] > 30 * brute(t)[0]}
    assert len(ids & {i for i, (_, y) in enumerate(rows) if y == 0}) <= 1
    assert len({i for i, (_, y) in enumerate(rows) if y == 1} - ids - repeats) <= 1


def test_rows(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)] + [(None, "x", 1), (0, "y", 1), (0, "y", 1)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_rows(df, none).collect()
    assert len(rows) == len(ts) + 3
    for r in rows:
        if r.doc_id:
            b = brute(ts[r.doc_id])
            assert tuple(r)[1:6] == b
            failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
            assert r.base_failed == failed and r.kept == (not failed)  # no labels: the base rules alone
    assert quality.quality_rows(df.limit(0), none).count() == 0


def test_a_text_scores_alike_alone_and_in_a_batch():
    rows = [t.encode() for t, _ in corpus(4, 30)] + [b"", b"a", b"  "]
    model = quality.Model(*(__import__("numpy").random.default_rng(k).normal(size=1 << b).astype("f4") for k, b in enumerate((quality.WORD_BITS, quality.CHAR_BITS))), 0.05, 0.0)
    alone = [model.probabilities([t])[0] for t in rows]
    assert abs(model.probabilities(rows) - alone).max() < 1e-6


def test_labels_that_clash_and_more_than_are_used(spark):
    """An id with both labels counts as 0; of more labelled ids than the sample those of the smallest hash fit, the same whenever it runs; of rows that repeat an id the least text."""
    r = random.Random(33)
    good, bad = "river meadow harbour lantern orchard".split(), "buy now click win cash".split()
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=60)), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1, "zzz " * 60, "x")] * 3, "doc_id long, text string, label string").repartition(5)
    labels = [(i, y) for i, _, y in rows] + [(2, 1), (None, 1), (5, None)]
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = quality.train(docs, df, sample=40), quality.train(docs.repartition(2), df.repartition(3), sample=40)
    assert (one.words == two.words).all() and (one.a, one.b) == (two.a, two.b)
    p = one.probabilities([(" ".join(r.choices(w, k=60))).encode() for w in (good, bad) for _ in range(10)])
    assert (p[:10] > 0.5).all() and (p[10:] < 0.5).all()


def test_a_very_long_repetitive_text():
    words = [f"w{k}".encode() for k in range(50_000)]
    text = b" ".join(words + [b"sep"] + words[:30_000])
    n = quality.base(text)
    assert n[0] == 80_001 and n[4] == 60_000

import random
import re

import corpus_pipeline
from pagefold.llm import packing, secrets, simhash
from tests.llm.test_packing import brute as brute_pack
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_simhash import brute_components, brute_fingerprint

DDL = "doc_id long, text string, lang string, source string, n_chars long, found int"


def documents():
    r = random.Random(21)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "the", "of"]
    good = [" ".join(r.choices(words, k=r.randint(40, 90))) for _ in range(60)]
    copies = [good[k] + r.choice(["", " end"]) for k in range(20)]
    bad = [" ".join(x.upper() + "!!" for x in r.choices(words, k=r.randint(40, 90))) for _ in range(25)]
    key = "token = " + "".join(r.choices("0123456789abcdef", k=40))
    leaks = [f"{' '.join(r.choices(words, k=40))} {key} {' '.join(r.choices(words, k=40))}" for _ in range(5)]
    rows = [(t, 1) for t in good + copies + leaks] + [(t, 0) for t in bad] + [("short text", None), ("", None), (None, None), ("again " * 40, None)]
    docs = [(i, t, "en", "s", len(t or ""), 0) for i, (t, _) in enumerate(rows)]
    return docs, [(i, y, 0) for i, (_, y) in enumerate(rows) if y is not None], key


def test_stages(spark, tmp_path):
    docs, labels, key = documents()
    spark.createDataFrame(docs, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns

    first = stages["quality_rules"](spark, now, str(tmp_path))
    assert first.columns == names
    kept = {x.doc_id: x.text for x in first.collect()}
    quality = {i: y for i, y, _ in labels}
    for i, t, *_ in docs:
        n = brute_quality(t)
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            assert i not in kept
        elif i in quality:
            assert (i in kept) == (quality[i] == 1)

    second = stages["simhash_near_dedup"](spark, first, str(tmp_path))
    assert second.columns == names
    order = sorted(kept)
    label = brute_components([brute_fingerprint(kept[i]) for i in order])
    left = {x.doc_id: x.text for x in second.collect()}
    assert left == {order[k]: kept[order[k]] for k in set(label)}

    third = stages["secret_scans"](spark, second, str(tmp_path))
    assert third.columns == names
    masked = {x.doc_id: x.text for x in third.collect()}
    assert masked == {i: re.sub(re.escape(key), secrets.MASK, t) for i, t in left.items()}
    assert all(x.n_chars == len(x.text) for x in third.collect())

    last = stages["packing"](spark, third, str(tmp_path))
    want = brute_pack(list(masked.items()), packing.BUCKETS, packing.BUDGET)
    assert sorted(map(tuple, last.collect()), key=repr) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == want


def test_odd_rows(spark, tmp_path):
    """Empty tables; nulls in any column, and rows that repeat."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, None, None, None, None), (None, text, "en", "s", 1, 0), (1, None, None, "s", None, 0), (2, text + " more", None, None, 5, 0), (2, text + " more", None, None, 5, 0), (3, "other " + " ".join(f"v{k}" for k in range(50)), "en", "s", 3, 0)]
    for some, n in (([], 0), (rows, 2)):  # doc 2's text differs from the null rows' in one word of 61, and links with it
        df = spark.createDataFrame(some, DDL)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == [c.split()[0] for c in DDL.split(", ")]
        out = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
        linked = (brute_fingerprint(text) ^ brute_fingerprint(text + " more")).bit_count() <= simhash.RADIUS
        assert len(out) == (n if linked or not some else n + 1)


def test_simhash_is_the_pipelines(spark):
    assert simhash.RADIUS == 3

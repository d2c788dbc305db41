import random
from itertools import combinations

from pagefold.llm import packing


def brute_cost(sizes, counts, cuts):
    return sum(n * (min(c for c in cuts if c >= s) - s) for s, n in zip(sizes, counts, strict=True))


def test_boundaries_are_optimal():
    r = random.Random(14)
    for _ in range(60):
        sizes = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        counts = [r.randint(1, 20) for _ in sizes]
        k = r.randint(1, 4)
        best = min(brute_cost(sizes, counts, [*c, sizes[-1]]) for n in range(k) for c in combinations(sizes[:-1], n))
        cuts = packing.boundaries(sizes, counts, k)
        assert len(cuts) <= k and cuts[-1] == sizes[-1] and brute_cost(sizes, counts, cuts) == best
    assert packing.boundaries([], []) == []


def test_boundaries_of_many_sizes():
    r = random.Random(16)
    for m, k in ((300, 7), (257, 16), (40, 40), (5, 9)):
        sizes = sorted(r.sample(range(1, 100_000), m))
        counts = [r.choice([1, 2, 50, 10_000]) for _ in sizes]
        least = [s * sum(counts[: j + 1]) for j, s in enumerate(sizes)]
        for _ in range(1, min(k, m)):
            least = [min([least[j], *(least[i - 1] + s * sum(counts[i : j + 1]) for i in range(1, j + 1))]) for j, s in enumerate(sizes)]
        cuts = packing.boundaries(sizes, counts, k)
        assert sum(min(c for c in cuts if c >= s) * n for s, n in zip(sizes, counts, strict=True)) == least[-1]


def brute(rows, buckets, budget):
    """All of it in plain Python: boundaries by trying every last bucket, the earliest of equally good ones."""
    n = [len((t or "").split()) for _, t in rows]
    sizes = sorted({max(x, 1) for x in n})
    counts = [sum(max(x, 1) == s for x in n) for s in sizes]
    best = {0: (0, [])}  # sizes covered: cost and boundaries, of the same number of buckets
    for _ in range(min(buckets, len(sizes))):
        best = {j: min(((c + sizes[j - 1] * sum(counts[i:j]), i, cuts) for i, (c, cuts) in best.items() if i < j), key=lambda v: v[:2]) for j in range(1, len(sizes) + 1) if any(i < j for i in best)}
        best = {j: (c, [*cuts, sizes[j - 1]]) for j, (c, _, cuts) in best.items()}
    cuts = best[len(sizes)][1] if sizes else []
    out = []
    for k, c in enumerate(cuts):
        mine = sorted(((i, x) for (i, _), x in zip(rows, n, strict=True) if x <= c and not any(x <= d for d in cuts[:k])), key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
        room = max(1, budget // c)
        out += [(i, x, k, c, j // room, j % room) for j, (i, x) in enumerate(mine)]
    return sorted(out, key=repr)


def test_rows(spark):
    r = random.Random(15)
    rows = [(i, "w " * r.choice([0, 1, 5, 9, 30, 31, 200, r.randint(0, 60)])) for i in range(300)] + [(None, "a b"), (None, None), (7, "x"), (7, "x"), (999, "long " * 40_000), (998, "long " * 39_999)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, bucket string").repartition(5)
    got = sorted(map(tuple, packing.pack(df, buckets=4, budget=100).collect()), key=repr)
    assert got == brute(rows, 4, 100)
    got = sorted(map(tuple, packing.pack(df).collect()), key=repr)
    assert got == brute(rows, packing.BUCKETS, packing.BUDGET)


def test_one_long_text_costs_the_others_nothing(spark):
    rows = [(i, "w " * (5 if i % 2 else 90)) for i in range(40)] + [(99, "long " * 500_000)]
    got = {r.doc_id: r.padded for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()}
    assert got == {**{i: 5 if i % 2 else 90 for i in range(40)}, 99: 500_000}


def test_long_lengths_are_exact(spark):
    """Lengths that differ far behind their first digits keep their own boundaries."""
    rows = [(i, n) for i, n in enumerate([100_000, 100_001, 100_003, 250_000])]
    got = {r.n_tokens: r.padded for r in packing.assign(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4).collect()}
    assert got == {n: n for _, n in rows}


def test_token_batches(spark):
    r = random.Random(18)
    rows = [(i, [r.randint(1, 60_000) for _ in range(r.randint(0, 12))]) for i in range(60)] + [(None, [5, 6]), (3, [9]), (3, [9]), (70, None), (71, list(range(400)))]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, ids array<int>, padded string")
    got = packing.token_batches(df, pad_id=-1, buckets=3, budget=40).collect()
    back = [(i, [x for x in ids if x != -1]) for b in got for i, ids in zip(b.doc_ids, b.ids, strict=True)]
    assert sorted(back, key=repr) == sorted(((i, x or []) for i, x in rows), key=repr)
    for b in got:
        assert all(len(x) == b.padded for x in b.ids) and (b.padded * len(b.ids) <= 40 or len(b.ids) == 1)
        assert b.padding == sum(x.count(-1) for x in b.ids)
    assert packing.token_batches(df.limit(0)).count() == 0


def test_tokens_of_a_tokenizer(spark):
    """Ids of the tokenization automaton, in padded batches."""
    import public_tokenizers

    from pagefold.llm import bpe

    df = spark.createDataFrame([(i, "some words " * i) for i in range(20)], "doc_id long, text string")
    ids = bpe.encode_documents(df, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "ids")
    want = {r.doc_id: r.ids for r in ids.collect()}
    got = {i: x[: len(want[i])] for b in packing.token_batches(ids, pad_id=0, buckets=2, budget=64).collect() for i, x in zip(b.doc_ids, b.ids, strict=True)}
    assert got == want


def test_batches(spark):
    rows = [(i, "w " * (i % 7)) for i in range(50)] + [(None, "n n"), (3, "w w w "), (60, "long " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.batches(df, buckets=3, budget=20).collect()
    assert sorted(((i, t) for b in got for i, t in zip(b.doc_ids, b.texts, strict=True)), key=repr) == sorted(rows, key=repr)
    for b in got:
        assert b.padded * len(b.doc_ids) <= 20 or len(b.doc_ids) == 1
        assert b.padding == b.padded * len(b.doc_ids) - sum(len(t.split()) for t in b.texts)
    assert packing.batches(df.limit(0)).count() == packing.pack(df.limit(0)).count() == 0

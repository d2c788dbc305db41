import random
import re

import xxhash

from pagefold.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    """Index -> smallest index reachable."""
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_fingerprint():
    r = random.Random(2)
    for t in ["", " \n", "One", "one two", "a b c", "a b c d", "É x Y \x85 z", "x " * 40_000, *(" ".join(r.choices(["Aa", "b", "ç", "d", "é"], k=r.randint(0, 60))) for _ in range(40))]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t), t[:40]


def near(r, n):
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(4 * n):
        x = r.choice(out)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randint(0, 63)
        out.append(x)
    return sorted(set(out))


def test_tree_finds_all_within():
    r = random.Random(4)
    fps = near(r, 60)
    tree = simhash.Tree(simhash.BKTree(fps).packed())
    assert sorted(tree.value) == fps
    for x in [*fps, *(r.getrandbits(64) for _ in range(20))]:
        assert sorted(tree.within(x, 3)) == [y for y in fps if (x ^ y).bit_count() <= 3]


def test_search_follows_edges_within_the_radius():
    r = random.Random(14)
    fps = [r.getrandbits(64) for _ in range(500)]
    whole = simhash.BKTree(fps)
    for node, below in enumerate(whole.children):
        for edge, child in below.items():
            assert edge == (whole.value[node] ^ whole.value[child]).bit_count()


def test_masks_cover_all_links():
    r = random.Random(5)
    for n in (1, 1 << 30, 1 << 40):
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for k in r.sample(range(64), r.randint(0, 3)):
                y ^= 1 << k
            assert any(x & m == y & m for m in simhash.masks(n))


def test_links_and_components(spark):
    fps = near(random.Random(6), 50)
    want = brute_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for shard, most in ((8192, 1 << 20), (3, 1 << 20), (8192, 0), (3, 0)):  # small shards have parts; no bytes: no broadcast
        roots = dict(map(tuple, simhash.components(simhash.links(df, len(fps), shard=shard, tree_bytes=most)).collect()))
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def documents(r):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 120))) for _ in range(40)]
    for _ in range(40):
        w = r.choice(texts).split()
        if w:
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    rows = [(3 * i + 5, t, i) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (None, "", 1), (None, texts[0], 1), (2, None, 1), (8, texts[1], 1), (8, texts[1], 2), (None, "nowhere else is this said", 3), (None, "nowhere else is this said", 4)]


def test_documents(spark):
    rows = documents(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    least = {}
    for (i, _, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((i, f, least.get(c)) for (i, _, _), f, c in zip(rows, fps, label, strict=True)), key=repr)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    nameless = {c for c in label if c not in least}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*least.values(), *([None] * len(nameless))], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one_of_each(df.limit(0)).count() == 0

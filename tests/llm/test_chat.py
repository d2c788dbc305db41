import random

from pagefold.llm import chat

DDL = "conv_id long, turn long, role string, text string, place int"


def brute(rows):
    """The multiset of (conv_id, n_turns, sorted turns) that stays."""
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t, r, x))
    seq = {c: [(r, x) for _, r, x in sorted(v, key=lambda a: (a[0] is not None, a[0] or 0))] for c, v in by.items()}
    out = set()
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seq.values())
        twin = any(d != c and o == s and (c is None or d is not None and d < c) for d, o in seq.items())
        if not longer and not twin:
            out.add(c)
    return {c: seq[c] for c in out}


def corpus(r):
    rows, c = [], 0
    for _ in range(40):
        talk = [(r.choice(["user", "assistant"]), r.choice(["hi", "hello", "what?", None, "", "🙂"])) for _ in range(r.randint(1, 8))]
        for _ in range(r.randint(1, 3)):
            c += 1
            rows += [(c, k, *x, 0) for k, x in enumerate(talk[: r.randint(1, len(talk))])]
    rows += [(900, k, "user", f"turn {k}", 0) for k in range(3000)]  # most rows
    rows += [(901, k, "user", f"turn {k}", 0) for k in range(1500)]
    rows += [(902, k, "user", f"turn {k}", 0) for k in range(3000)]
    rows += [(None, 0, "user", "nobody", 0), (None, 1, None, None, 0), (903, None, "user", "no number", 0), (904, 0, "user", "said twice", 0), (904, 0, "user", "said twice", 0)]
    r.shuffle(rows)
    return rows


def test_collapse(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame(rows, DDL).repartition(6)
        got = {}
        for x in chat.collapse(df).collect():
            got.setdefault(x.conv_id, []).append(x)
        want = brute(rows)
        assert set(got) == set(want)
        for c, found in got.items():
            found.sort(key=lambda x: x.place)
            assert [x.place for x in found] == list(range(1, found[0].n_turns + 1))
            assert [x.rendered for x in found] == [f"<|{r or 'unknown'}|>\n{t or ''}\n" for r, t in want[c]]


def test_empty(spark):
    assert chat.collapse(spark.createDataFrame([], DDL)).count() == 0


def test_prefix_hashes_cross_partitions(spark):
    df = spark.createDataFrame([(c, k, "u", str(k % 11), 0) for c in (5, 6) for k in range(2000)], DDL)
    rows = chat.turns(df).collect()
    by = {}
    for x in rows:
        by.setdefault(x.place, set()).add((x.one, x.two))
    assert sorted(by) == list(range(1, 2001)) and all(len(v) == 1 for v in by.values())

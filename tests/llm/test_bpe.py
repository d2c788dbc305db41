import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagefold.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a", "Don't  stop", "aaaaaaaaaaaaaaaaaaa", "a'sb 'll'd''s 're", "héllo <|endoftext|> ΣΑΣ 12!!<|startoftext|>z", "<|endoftext|><|endoftext|>", "<|x|>", "İstanbul ſ ²³ ½x", "日本語 テスト 한국어 १२३ é İ", "\x1c\x85\xa0 \x00 a", "🙂🙃 z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(library):
    r = random.Random(5)
    letters = [chr(c) for c in range(32, 400)] + list("abcdefghijklmnopqrstuvwxyz'   ") * 8 + list("日本Σς́̇🙂")
    texts = TEXTS + ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)] + ["".join(r.choices("ab' aatheion", k=r.randint(0, 60))) for _ in range(2000)]
    enc = bpe.encoder(PATH)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids, t
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_equals_merges():
    """Random vocabularies: the path equals merging pairs in order, by brute force."""
    r = random.Random(7)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 14:
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            if a + b not in vocab and reachable(a, b, merges):
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        auto = bpe.Automaton(vocab, merges)
        for _ in range(60):
            word = "".join(r.choices("abc", k=r.randint(1, 12)))
            assert [auto.labels[i] for i in auto.encode(word)] == merged(word, merges), (word, merges)


def test_a_very_long_word(library):
    """A word of a million letters takes time in proportion to its length."""
    r = random.Random(8)
    enc = bpe.encoder(PATH)
    for t in ("".join(r.choices("abcdefgh", k=200_000)), "a" * 1_000_000):
        assert enc.encode(t) == library.encode(t, add_special_tokens=False).ids


def merged(word, merges):
    out = list(word)
    for a, b in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == a and out[i + 1] == b:
                out[i : i + 2] = [a + b]
            i += 1
    return out


def reachable(a, b, merges):
    return merged(a + b, merges) == [a, b]


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, None, "x"), (3, "again", "y"), (3, "again", "y"), (99, "wörter " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.token_digests(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    full = bpe.encode_documents(df, PATH).where("doc_id = 2").first()
    assert full.decoded == "don</w> 't</w> stop</w>" and len(full.ids) == full.n_tokens == 3
    assert bpe.token_digests(df.limit(0), PATH).count() == 0

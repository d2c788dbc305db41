import io
import random
import zlib

import numpy as np
import xxhash
import public_tokenizers
from tokenizers import Tokenizer

from pagefold.llm import tokenfile
from pagefold.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_random_access():
    r = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = r.integers(0, 1 << r.integers(1, 32, n) if n else 1, n).astype("<u4") if n else np.zeros(0, "<u4")
        read = tokenfile.Reader(io.BytesIO(tokenfile.pack(np.array([0, n]), np.array([7]), ids)))
        assert read.size == n
        for i in r.integers(0, n, min(n, 60)) if n else []:
            assert read.token(int(i)) == ids[i]
        for _ in range(20):
            a, z = sorted(r.integers(0, n + 1, 2))
            assert (read.run(int(a), int(z - a)) == ids[a:z]).all()


def test_equals_library():
    r = random.Random(5)
    library, enc = Tokenizer.from_file(PATH), tokenfile.byte_encoder(PATH)
    letters = [chr(c) for c in range(0, 400)] + list("abcdefghijklmnopqrstuvwxyz'   \n\t12") * 8 + list("日本Σς́🙂 ")
    texts = ["", " ", "  a", "a  ", "'s 's a's''s don'tx", "<|endoftext|> a<|endoftext|>", "\x1c \x85\xa0x", "\n\n a\n b \n", "I'Ll we'll"]
    texts += ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(4000)] + ["".join(r.choices("ab's  \n2²!", k=r.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(5, "five words are in here"), (2, None), (2, "two"), (2, "two"), (None, "no id"), (-4, ""), (-(1 << 63), "the smallest id"), (None, "nor here"), (70, "Wörter und mehr " * 9000), (8, "日本 <|endoftext|>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string").repartition(3)
    folder = scratch(spark, "t")
    manifest = tokenfile.write_ids(df, folder, PATH, file_ids=8)
    got = sorted(map(tuple, tokenfile.read_documents(manifest, folder, step=2).collect()), key=lambda x: x[1])
    want, start = [], 0
    signed = lambda t: int.from_bytes(xxhash.xxh64_intdigest(t, 42).to_bytes(8, "big"), "big", signed=True)
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1] or ""))):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = scratch(spark, "t")
    assert tokenfile.read_documents(tokenfile.write_ids(df.limit(0), empty, PATH), empty).count() == 0

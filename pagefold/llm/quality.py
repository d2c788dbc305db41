"""Quality rules: fixed base rules, then a calibrated classifier on hashed word and character n-grams.

The classifier is a logistic regression on shares: each hashed n-gram counts as its part of the text's n-grams, so that a
text's score is a mean of weights, and whole texts are scored in one pass over an Arrow batch. It is fitted on labelled
rows (at most SAMPLE of them, by a hash of doc_id), and a fifth of those, held out, calibrate its probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import fresh, small_batches

#: Base rules.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 8, 20, 30
#: Labelled rows used at most; probability of quality from which a text is kept.
SAMPLE, KEEP_AT = 2000, 0.5
WORD_BITS, CHAR_BITS, GRAM = 17, 16, 4
#: A share's scale in the regression, and bytes of text that are scored at a time (a longer text: by itself).
SCALE, CHUNK = 100.0, 1 << 20
#: Features the fit takes at a time, which bounds its working arrays.
FIT_BLOCK = 1 << 19

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_CHARS = _WHITE + bytes(range(0x80, 0xC0))
_IS_WHITE = np.isin(np.arange(256), list(_WHITE))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, _NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW (a power of two) words that occur twice or more; hashes only rule texts without any out."""
    size = WINDOW
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(size):
        w += h[k : k + n] * _POWERS[k]
    w.sort()
    if not (w[1:] == w[:-1]).any():
        return 0
    # ranks of runs of 1, 2, 4 and 8 words, each from the pair of ranks before: equal ranks are equal words, a few numbers a word
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))
    for k in (1, 2, 4):
        _, rank = np.unique(rank[:-k] * len(words) + rank[k:], return_inverse=True)
    often = np.bincount(rank)[rank] > 1
    hit = np.zeros(len(words) + 1, np.int64)
    hit[:n] += often
    hit[size:] -= often
    return int((np.cumsum(hit) > 0).sum())


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Hashed features of texts that stand one after another in data, the k-th up to ends[k]: (words and word pairs, character n-grams), each (text's number, feature), in order of texts."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    white = _IS_WHITE[data]
    first = np.concatenate(([True], white[:-1] | (owner[1:] != owner[:-1])))[: len(data)] & ~white
    starts = np.flatnonzero(first)
    if len(starts):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))))
        value = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 63)]
        value[white] = 0
        h = np.add.reduceat(value, starts)
        who = owner[starts]
        pair = np.flatnonzero(who[1:] == who[:-1])
        both = h[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + h[pair + 1] * np.uint64(0x165667B19E3779F9)
        both[h[pair] == h[pair + 1]] = 1  # a word said again is one feature, whatever the word
        top = lambda x: ((x * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        order = np.argsort(np.concatenate((who, who[pair])), kind="stable")
        words = np.concatenate((who, who[pair]))[order], np.concatenate((top(h), top(both)))[order]
    else:
        words = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < GRAM:
        return words, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    g = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        g |= data[k : len(g) + k].astype(np.uint32) << np.uint32(8 * k)
    inside = owner[: len(g)] == owner[GRAM - 1 :]
    return words, (owner[: len(g)][inside], ((g[inside] * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64))


@dataclass
class Model:
    """Weights of the two kinds of features, and the calibration p = 1 / (1 + exp(-(a * score + b)))."""

    words: np.ndarray
    chars: np.ndarray
    a: float
    b: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out, k = np.zeros(len(texts)), 0
        while k < len(texts):
            z, size = k + 1, len(texts[k])
            while z < len(texts) and size + len(texts[z]) <= CHUNK:
                size += len(texts[z])
                z += 1
            ends = np.cumsum([len(t) for t in texts[k:z]])
            score = np.zeros(z - k)
            for (who, at), weight in zip(grams(np.frombuffer(b"".join(texts[k:z]), np.uint8), ends), (self.words, self.chars), strict=True):
                n = np.bincount(who, minlength=z - k)
                score += np.bincount(who, weight[at], z - k) / np.maximum(n, 1)
            out[k:z] = score
            k = z
        return 1 / (1 + np.exp(-np.clip(self.a * out * SCALE + self.b, -60, 60)))


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150) -> Model:
    """counts: for each row its features (character n-grams after the words') and their shares. One class alone, or no rows: a constant."""
    n_all = (1 << WORD_BITS) + (1 << CHAR_BITS)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 1.0
        return Model(np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << CHAR_BITS, np.float32), 0.0, 60.0 if share > 0.5 else -60.0)
    held = np.arange(len(labels)) % 5 == 4
    held &= len(set(labels[held].tolist())) == 2 and len(set(labels[~held].tolist())) == 2
    use = np.flatnonzero(~held)
    rows = np.repeat(np.arange(len(use), dtype=np.int32), [len(counts[i][0]) for i in use])
    at = np.concatenate([counts[i][0] for i in use]).astype(np.int32)
    x = np.concatenate([counts[i][1] for i in use]).astype(np.float32) * np.float32(SCALE)
    y = labels[use].astype(float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias, m, v = np.zeros(n_all + 1), 0.0, np.zeros(n_all + 1), np.zeros(n_all + 1)
    blocks = [slice(k, k + FIT_BLOCK) for k in range(0, len(at), FIT_BLOCK)]
    for step in range(1, steps + 1):  # Adam over all rows
        z = sum((np.bincount(rows[b], w[at[b]] * x[b], len(y)) for b in blocks), np.zeros(len(y))) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(sum((np.bincount(at[b], error[rows[b]] * x[b], n_all) for b in blocks), np.zeros(n_all)), error.sum()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    bias = w[-1]
    test = np.flatnonzero(held) if held.any() else use
    score = np.array([(w[counts[i][0]] * counts[i][1]).sum() * SCALE for i in test]) + bias
    a, b = platt(score, labels[test])
    return Model(w[: 1 << WORD_BITS].astype(np.float32), w[1 << WORD_BITS : n_all].astype(np.float32), a, a * bias + b)


def platt(score: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * score + b))), by Newton steps; targets are smoothed as Platt does."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    t = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -60, 60)))
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -5, 5)
    return float(max(a, 1e-3)), float(b)


def _texts(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary()).to_pylist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on rows of docs (doc_id, text) that labels (doc_id, quality) names.

    At most sample labelled ids, those of the smallest xxhash64, are used, each with one text: of rows that repeat an id the
    least. An id with both labels counts as 0; null ids, labels and texts are left out. The rows come to the driver as features:
    a text has 2 ** WORD_BITS + 2 ** CHAR_BITS at most, however long it is, so 8 bytes * 196,608 * sample is the bound.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("label"))
    few = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)

    def count(batches):
        for b in batches:
            rows = []
            for text, i, y in zip(_texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = []
                for k, (_, at) in enumerate(grams(np.frombuffer(text, np.uint8), np.array([len(text)]))):
                    u, n = np.unique(at, return_counts=True)
                    parts.append((u + (k << WORD_BITS), n / max(len(at), 1)))
                rows.append({"at": np.concatenate([p[0] for p in parts]).tolist(), "share": np.concatenate([p[1] for p in parts]).tolist(), "label_id": i, "label": y})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("at", pa.list_(pa.int32())), ("share", pa.list_(pa.float32())), ("label_id", pa.int64()), ("label", pa.int32())]))

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.min("text").alias("text"), F.first("label").cast("int").alias("label")).select("text", "label_id", "label")
    got = rows.mapInArrow(count, "at array<int>, share array<float>, label_id long, label int").toArrow()
    ids, y = np.asarray(got.column("label_id")), np.asarray(got.column("label"))
    parts = [[x.values.to_numpy() for chunk in got.column(c).chunks for x in chunk] for c in ("at", "share")]
    at, share = parts
    keys = [(int(i) * 0x9E3779B97F4A7C15 % (1 << 64), len(at[k])) for k, i in enumerate(ids)]
    order = sorted(range(len(ids)), key=keys.__getitem__)
    return fit([(at[k], share[k]) for k in order], y[order] if len(order) else np.zeros(0, int))


FOUND = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, p_quality: double, kept: boolean>"


def judge(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> Column:
    """A column with what the rules find in docs.text (null: a text without words) and whether the text is kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def found(col: pa.Array) -> pa.Array:
        texts = _texts(col)
        counts = np.array([base(t) for t in texts], np.int64).reshape(-1, 5)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        p = shared.value.probabilities(texts)
        names = [x.split(":")[0].strip() for x in FOUND[7:-1].split(",")]
        return pa.StructArray.from_arrays([*(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], names)

    return found(F.coalesce(F.col("text"), F.lit("")))


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and what judge() finds, for every row of docs; other columns are left out. No docs: no rows."""
    model = train(docs, labels)
    return docs.select("doc_id", "text").select("doc_id", judge(docs, model).alias("found")).select("doc_id", "found.*")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    name = fresh(docs, "found")
    return docs.withColumn(name, judge(docs, train(docs, labels))).where(F.col(f"{name}.kept")).drop(name)

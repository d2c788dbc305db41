"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens, not bytes: it accepts exactly the token sequences that the merges produce. It begins
with one state in which every symbol may follow every symbol. Each merge u + v -> w, in order, applies a gadget:
the state that u leads to is replaced by a copy without the arc v, w leads to a copy of the state that v leads to, and
w gets an arc wherever u has one. So every label leads to one state, and the construction keeps, for each gadget, what it
removed and when, and for each state which one it was copied from and when.

That is compiled into a table, a row of bits for each state and a column for each label. Columns are numbered so that what a
removed arc takes with it, the labels that later begin with it, stand next to each other; a state's row is then the sum
of a few intervals for each gadget that touched it or a state it was copied from.

A pre-split word is encoded from left to right, a table look-up for each step: at each place exactly one label that ends there
may follow the state reached where it begins, so there is one state for each place and nothing is tried twice. Decoding emits
the labels of the arcs.

Text outside Latin-1 and Latin Extended-A is normalised and split by the tokenizers library's own parts, so that
all of Unicode is split as there; the usual text takes an equal pattern that is faster. Texts and words may be of any length: a
word takes time in proportion to its length by the longest label's.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import small_batches

#: Letters, numbers and white space of Latin-1 and Latin Extended-A, and the text that has these only.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \\t\\n\\x0b\\x0c\\r\\xa0"
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-įı-ſ]*")
#: Entries of a worker's table of encoded words.
CACHE_WORDS = 700_000


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable, else the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Automaton:
    """Built from a vocabulary and its merges in order; end: suffix of a word's last symbol, or ""."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.labels = {i: s for s, i in vocab.items()}
        n = max(vocab.values(), default=-1) + 1
        #: When a label's arcs came to be (symbols: -1), and its two parts.
        self.made, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        #: By label u, the gadgets on the state it leads to: label of the arc removed -> when.
        self.gone: dict[int, dict[int, int]] = {}
        self.merges: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.left[w] >= 0:
                raise ValueError(f"two merges give {a + b!r}")
            self.made[w], self.left[w], self.right[w] = k, u, v
            self.gone.setdefault(u, {})[v] = k
            self.merges.append((u, v))
        self.occurs = [False] * n
        for label in sorted(self.labels, key=lambda i: self.made[i]):
            self.occurs[label] = self._occurs(label)
        self._number_columns()
        final = lambda label: bool(end) and self.labels[label].endswith(end)
        #: A row for each label that another may follow.
        self.rows: dict[int, bytes] = {i: self._row(i) for i in self.labels if self.occurs[i] and not final(i)}
        #: By their text, labels that end a word, with their columns; those that don't, and the beginnings of these (-1).
        self.last = {t.removesuffix(end): (i, self.column[i]) for i, t in self.labels.items() if self.occurs[i] and (not end or final(i))}
        inner = {t: (i, self.column[i]) for i, t in self.labels.items() if self.occurs[i] and not final(i)}
        self.heads = {t[:k]: (-1, 0) for t in inner for k in range(1, len(t))} | inner
        self.longest = max(map(len, self.last), default=0)
        every = np.zeros(n, bool)
        every[[self.column[i] for i in self.labels if self.occurs[i]]] = True
        self.start = np.packbits(every, bitorder="little").tobytes()

    def _copies(self, label: int) -> Iterator[tuple[int, int]]:
        """The states behind the one label leads to, each by a label x that led there, with the time up to which x's gadgets count."""
        x, until = label, 1 << 60
        while x >= 0:
            yield x, until
            until = min(until, self.made[x])  # a copy has what was removed before it was made
            x = self.right[x]

    def _occurs(self, label: int) -> bool:
        """Whether the label's two parts can follow each other when they are merged; else no path has it."""
        u, x, k, until = self.left[label], self.right[label], self.made[label], 1 << 60
        if u < 0:
            return len(self.labels[label].removesuffix(self.end)) == 1
        if not (self.occurs[u] and self.occurs[x]):
            return False
        while x >= 0:
            if any(0 <= self.gone.get(y, {}).get(x, -1) < min(copied, k, until + 1) for y, copied in self._copies(u)):
                return False
            until, x = self.made[x], self.left[x]
        return True

    def _number_columns(self) -> None:
        """Columns in preorder of the labels' left parts, later labels after earlier ones, and for each gadget the columns it takes: the arc's own, and those of labels that begin with it and were made no sooner."""
        below: dict[int, list[int]] = {}
        for label in sorted(self.labels, key=lambda i: self.made[i]):
            below.setdefault(self.left[label], []).append(label)
        n = len(self.made)
        self.column, stop, at = [0] * n, [0] * n, 0
        todo = [(label, False) for label in reversed(below.get(-1, []))]
        while todo:
            label, done = todo.pop()
            if done:
                stop[label] = at
                continue
            self.column[label], at = at, at + 1
            todo.append((label, True))
            todo += [(c, False) for c in reversed(below.get(label, []))]
        gadgets = {u: [(k, v) for v, k in arcs.items()] for u, arcs in self.gone.items()}
        self.taken: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u, arcs in gadgets.items():  # in order of time: when, first columns, columns after the last
            when, first, after = [], [], []
            for k, v in arcs:
                later = below.get(v, [])
                c = bisect_left(later, k, key=lambda i: self.made[i])
                when.append(k)
                first.append((self.column[v], self.column[later[c]] if c < len(later) else stop[v]))
                after.append((self.column[v] + 1, stop[v]))
            self.taken[u] = np.array(when), np.array(first), np.array(after)

    def _row(self, label: int) -> bytes:
        """Bits of the labels that may follow label."""
        n, first, after = len(self.made), [], []
        for x, until in self._copies(label):
            if x in self.taken:
                when, a, z = self.taken[x]
                k = int(np.searchsorted(when, until))
                first.append(a[:k].ravel())
                after.append(z[:k].ravel())
        gone = np.zeros(n + 1, np.int64)
        if first:
            gone = np.cumsum(np.bincount(np.concatenate(first), minlength=n + 1) - np.bincount(np.concatenate(after), minlength=n + 1))
        return np.packbits(gone[:n] == 0, bitorder="little").tobytes()

    def encode(self, word: str) -> tuple[int, ...]:
        """word: symbols of the vocabulary (byte letters), without the end suffix."""
        if (whole := self.last.get(word)) is not None:
            return (whole[0],)
        if not word:
            return ()
        heads, rows, last, n, tail = self.heads, self.rows, self.last, len(word), len(word) - self.longest
        row, label, back = [self.start] + [b""] * n, [-1] * (n + 1), [-1] * (n + 1)
        for begin in range(n):
            here = row[begin]
            if begin >= tail and (found := last.get(word[begin:])) is not None and here[found[1] >> 3] >> (found[1] & 7) & 1:
                label[n], back[n] = found[0], begin
                break
            for stop in range(begin + 1, n):
                found = heads.get(word[begin:stop])
                if found is None:
                    break
                i, c = found
                if i >= 0 and here[c >> 3] >> (c & 7) & 1:
                    row[stop], label[stop], back[stop] = rows[i], i, begin
        if back[n] < 0:
            raise ValueError(f"no path for {word!r}")
        out, at = [], n
        while at:
            out.append(label[at])
            at = back[at]
        return tuple(out[::-1])


class Encoder:
    """A vocabulary file's whole encoding: special tokens, normalising, splitting, then the automaton for each word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or '"Lowercase"' not in kinds or "invert" not in kinds:
            raise ValueError("a lower-casing word BPE vocabulary is expected")
        self.library = Tokenizer.from_file(path)
        self.auto = Automaton(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
        self.letter = byte_letters()
        n = max([*self.auto.labels, *self.special.values()]) + 1
        names = self.auto.labels | {i: s for s, i in self.special.items()}
        self.label = [names.get(i, "") for i in range(n)]
        self.number = [str(i) for i in range(n)]
        outer = self

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                ids = self[word] = outer.auto.encode("".join([outer.letter[b] for b in word.encode()]))
                return ids

        self.known = Known()

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        if PLAIN.fullmatch(text):
            return map(self.known.__getitem__, self.words.findall(text.lower()))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return (self.auto.encode(piece) for piece, _ in pieces)

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return list(chain.from_iterable(self._plain(text)))
        out: list[int] = []
        for part in self.cut.split(text):
            if (i := self.special.get(part)) is not None:
                out.append(i)
            elif part:
                out += chain.from_iterable(self._plain(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.label.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


OUT = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of docs (doc_id, text; other columns are left out).

    Null text is empty text, which has no tokens and decodes to "". Row by row: repeated rows and null ids stay.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _rows(docs).mapInArrow(work, OUT)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids (decimal, joined by one space) and decoded text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py())
                n.append(len(ids))
                a.append(sha(" ".join(map(enc.number.__getitem__, ids))))
                d.append(sha(enc.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(work, DIGESTS)

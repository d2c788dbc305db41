"""Code extractors: runs of words that have a type's pattern, surer where one of the type's labels stands beside them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import validators as v
from pagefold.operators import rows as r

PAGE = ["docid", "page"]
# Labels in lower case.
LABELS = {
    "iban": ["iban", "international bank", "bankverbindung", "compte bancaire"],
    "bic": ["bic", "swift", "bic/swift", "swift/bic", "bank identifier", "bank code"],
    "account_num": ["account", "konto", "kontonummer", "compte", "conto", "account no", "account number", "bank account", "číslo účtu", "account:", "acc.", "acc no"],
    "bank_num": ["sort code", "routing", "blz", "bankleitzahl", "aba", "bank code", "transit", "routing number", "bank num"],
    "customer_tax_id": ["vat", "tax id", "tax no", "mwst", "tva", "nif", "btw", "dič", "customer vat", "customer tax", "umsatzsteuer", "ust-id", "tax number", "your vat"],
    "vendor_tax_id": ["vat", "tax id", "tax no", "mwst", "tva", "nif", "btw", "dič", "vendor vat", "our vat", "umsatzsteuer", "ust-id", "tax number", "our tax"],
    "customer_registration_id": ["reg", "registration", "kvk", "hrb", "ičo", "company no", "firmenbuch", "registered", "customer reg", "company reg"],
    "vendor_registration_id": ["reg", "registration", "kvk", "hrb", "ičo", "company no", "firmenbuch", "registered", "abn", "vendor reg"],
    "payment_reference": ["ref", "reference", "payment ref", "zahlungsreferenz", "payment reference", "remittance", "use reference", "ref.", "our ref", "your ref"],
    "document_id": ["invoice", "rechnung", "facture", "faktura", "invoice no", "invoice number", "bill no", "document no", "doc no", "inv", "inv.", "inv no", "invoice #", "nr.", "no.", "document id", "bill number"],
}
# The most words of a run, and the pattern of its words without spaces.
CODES = {
    "bic": (2, r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"),
    "account_num": (4, r"(?U)^\d{8,18}$"),
    "bank_num": (4, r"(?U)^\d{8,18}$"),
    "vendor_tax_id": (2, r"(?iu)(?U)^([A-Z]{2}[A-Z0-9]{5,12}|\d{5,15})$"),
    "customer_tax_id": (2, r"(?iu)(?U)^([A-Z]{2}[A-Z0-9]{5,12}|\d{5,15})$"),
    "vendor_registration_id": (2, r"(?iu)(?U)^[A-Z0-9][\w\-./]{5,14}$"),
    "customer_registration_id": (2, r"(?iu)(?U)^[A-Z0-9][\w\-./]{5,14}$"),
    "payment_reference": (2, r"(?iu)(?U)^[A-Z0-9][\w\-./]{4,19}$"),
    "document_id": (2, r"(?iu)(?U)^(?=.*\d)[A-Z0-9][\w\-./]{2,19}$"),
}
IBAN_START, IBAN_WORDS, SURE, UNSURE = r"(?i)^[A-Z]{2}[0-9]{2}", 8, 1.0, 0.7
# Matchers of single words, and of runs of them, by field type.
SIGNS = v.SIGNS
CODES_40 = v.CODES[:40]
MATCHERS = {
    "bic": v.BIC,
    "tax_id": r"(?iu)(?U)^[A-Z]{2}[\w\-./]{5,}$",
    "email": v.EMAIL,
    "payment_reference": r"(?i)^[A-Z0-9\-/]{6,30}$",
    "quantity": r"(?U)^-?\d+([.,]\d+)?$",
    "rate": r"(?U)^\d+(\.\d+)?\s*%?$",
    "position": r"(?U)^\d+$",
    "amount": v.AMOUNT,
    "date": "|".join(f"({p})" for p in (r"(?U)^\d{4}-\d{1,2}-\d{1,2}$", *v.DATES[1:])),
}


def pages(words: DataFrame, scale: float = 50.0) -> DataFrame:
    """docid, page, ws: the page's words (word_id, text) in reading order, as one array."""
    return r.page_arrays(words, [F.bround(F.col("top") * scale).cast("long"), F.col("left")], ("word_id", "text"))


def runs(words: DataFrame, most: int, scale: float = 50.0, radius: int = 3, begins: str | None = None) -> DataFrame:
    """docid, page, pos (place in reading order, from 0), n, ids, spaced, compact, around: every run of 1..most words (with begins: whose first word has this pattern), and the radius words before and after it in lower case."""
    texts = lambda xs: F.transform(xs, lambda w: w["text"])
    sizes = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - i))
    before = lambda i: F.slice("words", F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)))
    after = lambda i, n: F.slice("words", i + n + 1, F.lit(radius))
    one = lambda i, n: F.struct(i.alias("pos"), n.alias("n"), F.slice("words", i + 1, n).alias("run"), F.lower(F.array_join(texts(F.concat(before(i), after(i, n))), " ")).alias("around"))
    places = F.sequence(F.lit(0), F.size("words") - 1)
    if begins is not None:
        places = F.filter(places, lambda i: F.get("words", i)["text"].rlike(begins))
    every = F.flatten(F.transform(places, lambda i: F.transform(sizes(i), lambda n: one(i, n))))
    flat = pages(words, scale).select(*PAGE, F.inline(every))
    return flat.select(*PAGE, "pos", "n", F.transform("run", lambda w: w["word_id"]).alias("ids"), F.array_join(texts(F.col("run")), " ").alias("spaced"), F.array_join(texts(F.col("run")), "").alias("compact"), "around")


def _labelled(labels: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains("around", F.lit(x)) for x in labels])


def finds(words: DataFrame, fieldtype: str) -> DataFrame:
    """docid, page, pos, ids, text, code, score of a type's codes on each page, one for each code, the first.

    At each place the shortest run that has the pattern counts. Score 1 where a label stands within three words before or after, else .7.
    """
    most, pattern = CODES[fieldtype]
    bare = F.regexp_replace("compact", r"(?U)[\s\-]" if fieldtype in ("account_num", "bank_num") else r"(?U)\s", "")
    code = F.upper(bare) if fieldtype in ("bic", "vendor_tax_id", "customer_tax_id") else bare
    real = runs(words, most).withColumn("code", code).where(F.col("code").rlike(pattern))
    first = real.groupBy(*PAGE, "pos").agg(F.min_by(F.struct("ids", "spaced", "code", _labelled(LABELS[fieldtype]).alias("labelled")), "n").alias("x")).select(*PAGE, "pos", "x.*")
    once = first.groupBy(*PAGE, "code").agg(F.min_by(F.struct("pos", "ids", "spaced", "labelled"), "pos").alias("x"))
    return once.select(*PAGE, "x.pos", "x.ids", F.col("x.spaced").alias("text"), "code", F.when(F.col("x.labelled"), SURE).otherwise(UNSURE).alias("score"))


def ibans(words: DataFrame) -> DataFrame:
    """docid, page, pos, ids, text, code, score (1) of the account codes whose checksum holds, in runs of up to eight words that begin like one, from left to right without overlap, one for each code."""
    code = F.replace(F.upper("compact"), F.lit(" "), F.lit(""))
    real = runs(words, IBAN_WORDS, begins=IBAN_START).withColumn("code", code).where((F.length("code") >= 15) & (F.length("code") <= 34)).where(v.iban(F.col("code")) == 1.0)
    shortest = real.groupBy(*PAGE, "pos").agg(F.min_by(F.struct("pos", "n", "ids", "spaced", "code"), "n").alias("x"))
    kind = shortest.schema["x"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda s, x: F.when(x["pos"] < s["free"], s).otherwise(F.struct((x["pos"] + x["n"]).alias("free"), F.array_append(s["out"], x).alias("out")))
    taken = shortest.groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(*PAGE, F.inline(F.aggregate("xs", zero, step, lambda s: s["out"])))
    once = taken.groupBy(*PAGE, "code").agg(F.min_by(F.struct("pos", "ids", "spaced"), "pos").alias("x"))
    return once.select(*PAGE, "x.pos", "x.ids", F.col("x.spaced").alias("text"), "code", F.lit(SURE).alias("score"))


FOUND = ("docid", "page", "fieldtype", "pos", "ids", "text", "score")
RADIUS, AT_ONCE = 3, 1 << 16
# What stands for a character that isn't ASCII in a shape: a digit, a letter that [A-Z] has without regard to case, another of a word, any other.
_DIGIT, _LETTER, _WORD, _OTHER = "٠", "ſ", "é", "¶"
_NO_HYPHENS, _CAPITALS = ("account_num", "bank_num"), ("bic", "vendor_tax_id", "customer_tax_id")


def every_find(words: DataFrame, types: Sequence[str] | None = None, columns: Sequence[str] = FOUND) -> DataFrame:
    """docid, page, fieldtype, pos, ids, text, score (or some of these columns) of all types (or some), the best of each text of a document, the first page's and place's on a tie.

    As ibans() and finds() have them, but in one pass for all types: a document's words come in order, and Arrow batches of whole documents are searched
    column by column. Words dealt by docid are not shuffled. Java decides what class a character is in, as it does for finds(): words that aren't plain
    ASCII come with their shape, in which one character stands for each class.
    """
    chosen = [t for t in ("iban", *CODES) if types is None or t in types]
    order = ["page", F.bround(F.col("top") * 50.0).cast("long"), "left", "word_id"]
    placed = words.withColumn("place", F.row_number().over(W.partitionBy("docid").orderBy(*order)))
    plain = F.col("text").rlike(r"\A[\x21-\x7E]*\z")
    bare = F.regexp_replace("text", r"(?U)\s", "")
    extra = {"bare": bare, "up": F.upper(bare), "key": F.upper(F.replace("text", F.lit(" "), F.lit(""))), "shape": _shape(bare), "up_shape": _shape(F.upper(bare))}
    # place goes along, else Spark drops it and the order with it
    flat = placed.select(*PAGE, "word_id", "place", "text", *(F.when(~plain, c).alias(k) for k, c in extra.items()))
    kinds = {"docid": words.schema["docid"].dataType.simpleString(), "page": words.schema["page"].dataType.simpleString(), "fieldtype": "string", "pos": "int", "ids": f"array<{words.schema['word_id'].dataType.simpleString()}>", "text": "string", "score": "double"}
    return flat.mapInArrow(lambda batches: _whole_documents(batches, lambda t: _best_finds(t, chosen, columns)), ", ".join(f"{c} {kinds[c]}" for c in columns))


def _shape(c: Column) -> Column:
    for pattern, sign in ((r"(?U)(?![\x00-\x7F])\d", _DIGIT), (r"(?![\x00-\x7F])(?iu:[A-Z])", _LETTER), (rf"(?U)(?![\x00-\x7F{_DIGIT}{_LETTER}])\w", _WORD), (rf"[^\x00-\x7F{_DIGIT}{_LETTER}{_WORD}]", _OTHER)):
        c = F.regexp_replace(c, pattern, sign)
    return c


def _re2(pattern: str) -> list[str]:
    """Patterns for shapes that a text must all have to have one of CODES."""
    ahead, digit, word = r"(?=.*\d)", f"0-9{_DIGIT}", f"0-9A-Za-z_{_DIGIT}{_LETTER}{_WORD}"
    letters = f"A-Za-z{_LETTER}" if "(?iu)" in pattern else "A-Z"
    bare = re.sub(r"\(\?(?:iu|U)\)", "", pattern)
    both = [bare.replace(ahead, ""), *[r"\d"] * (ahead in bare)]
    return [x.replace("A-Z", letters).replace(r"\w", word).replace(r"\d", f"[{digit}]") for x in both]


def _whole_documents(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work on AT_ONCE rows or more at a time, cut between documents."""
    held, rows, least = [], 0, AT_ONCE
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = int(_changes(table["docid"].combine_chunks()).nonzero()[0][-1])
        if last:
            yield work(table.slice(0, last))
        held = table.slice(last).combine_chunks().to_batches()
        rows -= last
        least = max(AT_ONCE, 2 * rows)
    if rows:
        yield work(pa.Table.from_batches(held))


def _changes(col: pa.Array) -> np.ndarray:
    ids = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)


_KINDS = tuple(LABELS)
#: By type, the labels that can be in one word of several that are joined, and those of two words; a label that holds another of its type says nothing more.
_NEEDED = {t: [x for x in xs if not any(y != x and y in x for y in xs)] for t, xs in LABELS.items()}
_PAIRS = sorted({x for xs in _NEEDED.values() for x in xs if " " in x})
_PAIR_BITS = {t: sum(1 << _PAIRS.index(x) for x in xs if " " in x) for t, xs in _NEEDED.items()}
if len(_PAIRS) > 62 or any(x.count(" ") > 1 for x in _PAIRS):
    raise ValueError("labels of more than two words, or too many of two")


@lru_cache(maxsize=1 << 17)
def _label_bits(word: str) -> tuple[int, int, int]:
    """Bits of the types of which a label is in the word; of the labels of two words of which it ends with the first; begins with the second."""
    low = word.lower()
    has = sum(1 << k for k, t in enumerate(_KINDS) if any(x in low for x in _NEEDED[t]))
    first, second = (sum(1 << k for k, x in enumerate(_PAIRS) if test(x.split(" "))) for test in (lambda x: low.endswith(x[0]), lambda x: low.startswith(x[1])))
    return has, first, second


@lru_cache(maxsize=1 << 16)
def _checksum(code: str) -> bool:
    """As validators.iban() has it for texts of its pattern, which may end with a line's end."""
    rest = 0
    for ch in code[4:] + code[:4]:
        x = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".find(ch)
        rest = (rest * (100 if x > 9 else 10) + x) % 97
    return rest == 1


def _best_finds(t: pa.Table, chosen: Sequence[str], columns: Sequence[str]) -> pa.RecordBatch:
    n = t.num_rows
    col = {c: t[c].combine_chunks() for c in t.column_names}
    text = pc.fill_null(col["text"], "")
    capitals = pc.ascii_upper(text)
    word = {c: pc.coalesce(col[c], text if c in ("bare", "shape") else capitals) for c in ("bare", "up", "key", "shape", "up_shape")}
    doc_starts = _changes(col["docid"])
    page_starts = doc_starts | _changes(col["page"])
    doc, page = doc_starts.cumsum() - 1, page_starts.cumsum() - 1
    starts = page_starts.nonzero()[0]
    at = np.arange(n)
    start, end = starts[page], np.append(starts[1:], n)[page]
    run = lambda xs, places, k, sep="": pc.binary_join_element_wise(*(xs.take(pa.array(places + j)) for j in range(k)), sep, null_handling="skip")
    ids = lambda xs: xs.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    spelt = text.dictionary_encode()
    bits = np.array([_label_bits(w) for w in spelt.dictionary.to_pylist()], np.int64).reshape(-1, 3)[spelt.indices.to_numpy(zero_copy_only=False)]
    has, first, second = bits.T
    paired = np.zeros(n, np.int64)
    paired[:-1] = np.where(page[:-1] == page[1:], first[:-1] & second[1:], 0)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))

    def labelled(kind: str, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether one of the type's labels is in the RADIUS words before a run and after it, joined by spaces."""
        one, two, mask = sums(has >> _KINDS.index(kind) & 1), sums(paired & _PAIR_BITS[kind] != 0), _PAIR_BITS[kind]
        low, after = np.maximum(p - RADIUS, start[p]), p + k
        high = np.minimum(after + RADIUS, end[p])
        across = (p > low) & (after < high) & (first[p - 1] & second[np.minimum(after, n - 1)] & mask != 0)
        return (one[p] > one[low]) | (one[high] > one[after]) | (two[np.maximum(p - 1, low)] > two[low]) | (two[np.maximum(high - 1, after)] > two[after]) | across

    def first_of(keys: np.ndarray) -> np.ndarray:
        return np.sort(np.unique(keys, return_index=True)[1])

    out = []
    if "iban" in chosen:
        begins = re.compile(IBAN_START, re.ASCII)
        mine = np.array([begins.search(w) is not None for w in spelt.dictionary.to_pylist()], bool)
        left = at[mine[spelt.indices.to_numpy(zero_copy_only=False)]] if len(mine) else at
        ends = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
        real: list[tuple[int, int, str]] = []
        for k in range(1, IBAN_WORDS + 1):
            left = left[end[left] - left >= k]
            code = run(word["key"], left, k)
            maybe = pc.and_(pc.match_substring_regex(code, v.IBAN.removesuffix("$") + ends), pc.less_equal(pc.utf8_length(code), 34)).to_numpy(zero_copy_only=False).nonzero()[0]
            good = [(i, c) for i, c in zip(maybe.tolist(), code.take(pa.array(maybe)).to_pylist(), strict=True) if _checksum(c)]
            real += [(int(left[i]), k, c) for i, c in good]
            left = np.delete(left, [i for i, _ in good])
        free, seen, p, k = (-1, 0), set(), [], []
        for i, m, code in sorted(real):
            if page[i] == free[0] and i < free[1]:
                continue
            free = (page[i], i + m)
            if (doc[i], code) not in seen:
                seen.add((doc[i], code))
                p.append(i)
                k.append(m)
        out.append(("iban", np.array(p, np.int64), np.array(k, np.int64), np.full(len(p), SURE)))
    kinds: dict[tuple, list[str]] = {}
    for kind in chosen:
        if kind != "iban":
            kinds.setdefault((*CODES[kind], kind in _NO_HYPHENS, kind in _CAPITALS), []).append(kind)
    for (most, pattern, no_hyphens, in_capitals), some in kinds.items():
        codes, shapes = (word[c] for c in (("up", "up_shape") if in_capitals else ("bare", "shape")))
        left = at
        if no_hyphens:
            codes, shapes = pc.replace_substring(codes, "-", ""), pc.replace_substring(shapes, "-", "")
            # all words of a run of digits are digits
            left = at[pc.match_substring_regex(shapes, f"^[0-9{_DIGIT}]*$").to_numpy(zero_copy_only=False)]
        tests = _re2(pattern)
        places, sizes, made = [], [], []
        for k in range(1, most + 1):
            left = left[end[left] - left >= k]
            shape = run(shapes, left, k)
            yes = reduce(pc.and_, [pc.match_substring_regex(shape, x) for x in tests]).to_numpy(zero_copy_only=False)
            places.append(left[yes])
            sizes.append(np.full(len(places[-1]), k))
            made.append(run(codes, left[yes], k))
            left = left[~yes]
        p, k = np.concatenate(places), np.concatenate(sizes)
        order = np.argsort(p)
        p, k, code = p[order], k[order], ids(pa.concat_arrays(made).take(pa.array(order)))
        once = first_of(page[p] * (n + 1) + code)
        p, k = p[once], k[once]
        by_size = [(k == m).nonzero()[0] for m in range(1, most + 1)]
        back = np.argsort(np.concatenate(by_size))
        key = ids(pa.concat_arrays([run(word["key"], p[x], m) for m, x in enumerate(by_size, 1)]).take(pa.array(back)))
        text_of = doc[p] * (n + 1) + key
        for kind in some:
            sure = labelled(kind, p, k)
            found, where = np.unique(text_of * 2 + ~sure, return_index=True)
            best = np.sort(where[np.concatenate(([True], found[1:] // 2 != found[:-1] // 2))]) if len(found) else where
            out.append((kind, p[best], k[best], np.where(sure[best], SURE, UNSURE)))
    p, k = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in out)]).astype(np.int64) for c in (1, 2))
    offsets = np.concatenate(([0], np.cumsum(k)))

    def spaced() -> pa.Array:
        by_size = [(k == m).nonzero()[0] for m in range(1, IBAN_WORDS + 1)]
        return pa.concat_arrays([run(col["text"], p[x], m, " ") for m, x in enumerate(by_size, 1)]).take(pa.array(np.argsort(np.concatenate(by_size))))

    make = {
        "docid": lambda: col["docid"].take(pa.array(p)),
        "page": lambda: col["page"].take(pa.array(p)),
        "fieldtype": lambda: pa.concat_arrays([pa.array([], pa.string()), *(pa.repeat(x[0], len(x[1])) for x in out)]),
        "pos": lambda: pa.array((p - start[p]).astype(np.int32)),
        "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), col["word_id"].take(pa.array(np.repeat(p - offsets[:-1], k) + np.arange(offsets[-1])))),
        "text": spaced,
        "score": lambda: pa.array(np.concatenate([np.zeros(0), *(x[3] for x in out)])),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], list(columns))


def matches(fieldtype: str, text: Column) -> Column | None:
    """Whether a text has the matcher's format of the type; None for types without one."""
    from pagefold.functions.catalog import FAMILIES

    family = next((f for f, types in FAMILIES.items() if fieldtype in types), fieldtype)
    s = F.trim(text)
    if family == "iban":
        return v.iban(text) == 1.0
    if family == "bic":
        return F.upper(s).rlike(v.BIC) & F.length(s).isin(8, 11)
    if family == "currency":
        return s.isin(*SIGNS) | F.upper(s).isin(*CODES_40)
    return s.rlike(MATCHERS[family]) if family in MATCHERS else None


def regex_candidates(words: DataFrame, fieldtype: str) -> DataFrame:
    """docid, page, start, n, ids, text, score of runs in order of word_id that have the matcher's format: single words .85; of account codes up to eight words (spaces don't count) that begin like one as they stand, not in capitals alone, of dates and amounts up to four, .80. No matcher: none."""
    from pagefold.functions.catalog import FAMILIES

    many = 8 if fieldtype == "iban" else 4 if fieldtype in FAMILIES["date"] + FAMILIES["amount"] else 1
    found = r.windows(words, many, IBAN_START if fieldtype == "iban" else None)
    ok = matches(fieldtype, F.col("spaced"))
    if ok is None:
        ok = F.lit(False)
    return found.where(ok).select(*PAGE, "start", "n", F.sequence("start", F.col("start") + F.col("n") - 1).alias("ids"), F.col("spaced").alias("text"), F.when(F.col("n") == 1, 0.85).otherwise(0.80).alias("score"))

import random
import re

from pyspark.sql import functions as F

from pagefold.operators import refine

DDL = "docid long, page int, word_id int, text string, left double, top double, right double, bottom double"
MONEY = re.compile("^[$€£¥₹₩₽฿₺₴₪]$|^(usd|eur|gbp|kč|ft)$", re.I)


def bare(w):
    return w["text"].strip().lower()


def label(w, labels):
    return bare(w) in labels or re.sub(":+$", "", bare(w)) in labels


def in_rows(ws, tolerance=0.012):
    rows = []
    for w in sorted(ws, key=lambda w: (w["top"], w["left"])):
        if rows and abs(w["top"] - rows[-1][0]["top"]) <= tolerance:
            rows[-1].append(w)
        else:
            rows.append([w])
    return rows


def run(ws):
    """The words of the longest stretch of numbers, trying all of them."""
    ids = {w["word_id"] for w in ws}
    stretches = [range(a, a + n) for n in range(len(ids), 0, -1) for a in sorted(ids) if ids.issuperset(range(a, a + n))]
    return [w for w in ws if w["word_id"] in stretches[0]] if stretches else []


def first_best(xs, score):
    top = max(map(score, xs))
    return next(x for x in xs if score(x) == top)


def digit(row):
    return any(re.search(r"\d", w["text"]) for w in row)


def expected(fieldtype, ws):
    rule = next((r for r, types in refine.TYPES.items() if fieldtype in types), None)
    if rule is None:
        found = run(ws)
        return ws if len(in_rows(ws)) == 1 and len(found) < len(ws) // 2 else found
    labels = set(refine.LABELS[rule])
    kept = list(ws)
    while kept and label(kept[0], labels):
        del kept[0]
    if not kept:
        return ws
    rows = in_rows(kept, 0.015 if rule == "financial" else 0.012)
    if rule == "name":
        return first_best(rows, len)
    if rule == "financial":
        return rows[0]
    if rule == "id":
        row = first_best(rows, lambda r: 2 * digit(r) + len(r))
        return run(row) if len(row) > 5 else row
    if rule == "date":
        row = first_best(rows, lambda r: 3 * digit(r) + 2 * (len(r) <= 3) + len(r))
        return run(row)[:3] if len(row) > 3 else row
    if rule == "amount":
        row = first_best(rows, lambda r: 3 * digit(r) + len(r))
        if len(row) <= 3:
            return row
        kinds = "".join("m" if MONEY.search(w["text"].strip()) else "n" if re.fullmatch(r"[\d,.\s]+", w["text"].strip()) and re.search(r"\d", w["text"]) else "x" for w in row)
        n = kinds.find("n")
        if n < 0:
            return [w for w, k in zip(row, kinds, strict=True) if k == "m"] or row
        end = n + len(re.match("n+m?", kinds[n:])[0])
        return [w for i, (w, k) in enumerate(zip(row, kinds, strict=True)) if (i < n and k == "m") or n <= i < end]
    while rows and all(label(w, labels) for w in rows[0]):
        del rows[0]
    if not rows:
        return kept
    blocks = [[rows[0]]]
    for above, row in zip(rows, rows[1:], strict=False):
        if min(w["top"] for w in row) - max(w["bottom"] for w in above) < 0.04:
            blocks[-1].append(row)
        else:
            blocks.append([row])
    return [w for row in first_best(blocks, lambda b: sum(map(len, b))) for w in row]


def guarded(fieldtype, ws, after):
    if fieldtype.startswith("line_item_") or len(after) >= len(ws):
        return after
    labels = next((set(refine.LABELS[r]) for r, types in refine.TYPES.items() if fieldtype in types), set())
    kept = {w["word_id"] for w in after}
    if all(re.sub(":+$", "", bare(w)) in labels for w in ws if w["word_id"] not in kept):
        return after
    rest = list(ws)
    while rest and label(rest[0], labels):
        del rest[0]
    return rest or ws


TYPES = [types[0] for types in refine.TYPES.values()] + ["payment_terms", "line_item_description", "line_item_code", "line_item_date", "line_item_tax"]


def test_rules_against_brute_force(spark):
    r = random.Random(41)
    texts = "To: Total: no. date Invoice bank: vendor: 12.50 EUR € 7 x2 Acme Ltd Street 1,234 kč # 2024 usd".split()
    words, spans, want = [], [], {}
    for doc in range(120):
        n = r.randint(1, 14)
        page = [{"word_id": i, "text": r.choice(texts), "left": round(r.random(), 2), "top": r.choice([0.1, 0.105, 0.113, 0.13, 0.2, 0.21, 0.3])} for i in range(n)]
        for w in page:
            w |= {"right": w["left"] + 0.05, "bottom": w["top"] + 0.01}
        words += [(doc, 0, *(w[c] for c in refine.WORD)) for w in page]
        for k, kind in enumerate(TYPES):
            ids = r.sample(range(n), r.randint(1, n)) if r.random() < 0.4 else [i for i in range(n) if r.random() < 0.8] or [0]
            spans.append((doc, 0, k, kind, [*ids, 99] if r.random() < 0.1 else ids))
            ws = [page[i] for i in ids]
            after = expected(kind, ws)
            want[doc, k] = [w["word_id"] for w in after], [w["word_id"] for w in guarded(kind, ws, after)], kind, [w["text"] for w in ws]
    df = spark.createDataFrame(words, DDL).repartition(4)
    some = spark.createDataFrame(spans, "docid long, page int, span_id int, fieldtype string, word_ids array<int>")
    for k in (0, 1):
        for x in refine.refine(some, df, guarded=bool(k)).collect():
            assert x.ids == want[x.docid, x.span_id][k], (k, want[x.docid, x.span_id])
            box = [w for w in words if w[0] == x.docid and w[2] in x.ids]
            assert (x.l, x.t, x.r, x.b) == (min(w[4] for w in box), min(w[5] for w in box), max(w[6] for w in box), max(w[7] for w in box))
    assert refine.refine(some.limit(0), df).count() == 0


def test_answers_get_boxes(spark):
    words = spark.createDataFrame([(1, 0, i, t, 0.1 * i, 0.1, 0.1 * i + 0.05, 0.12) for i, t in enumerate("Vendor: Acme Ltd 12.00 EUR".split())], DDL)
    answers = spark.createDataFrame([(1, 0, 0, "vendor_name", "Acme Ltd", [0, 1, 2], 0.8, None), (1, 0, 1, "amount_due", "twelve", [3], 0.9, None), (1, 0, 2, "vendor_name", "Acme Ltd", [], 0.7, 4), (1, 0, 3, "iban", "nowhere", [77], 0.7, None)], "docid long, page int, ord int, fieldtype string, text string, word_ids array<int>, score double, line_item_id int")
    got = {x.ord: (round(x.l, 2), round(x.r, 2), x.score, x.line_item_id) for x in refine.resolve(answers, words).collect()}
    assert got == {0: (0.1, 0.25, 0.8, None), 1: (0.3, 0.35, 0.0, None), 2: (0.1, 0.25, 0.7, 4)}
    plain = {x.ord: round(x.l, 2) for x in refine.resolve(answers, words, use_refiner=False).collect()}
    assert plain == {0: 0.0, 1: 0.3, 2: 0.1}
    assert F is not None

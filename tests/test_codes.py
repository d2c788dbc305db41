import random
import re

import pytest

from pagefold.functions import validators
from pagefold.operators import codes, joins, learning

DDL = "docid long, page int, word_id int, text string, left double, top double, right double, bottom double"


def page(*texts, docid=1, number=0, top=0.1):
    return [(docid, number, i, t, 0.05 * i, top, 0.05 * i + 0.04, top + 0.02) for i, t in enumerate(texts)]


def python(pattern):
    return re.compile(re.sub(r"\(\?(?:iu|U)\)", "", pattern), re.I if "(?iu)" in pattern else 0)


def brute(texts, fieldtype):
    """code -> (place, score), place by place; texts are in reading order."""
    most, pattern = codes.CODES[fieldtype]
    out = {}
    for i in range(len(texts)):
        for n in range(1, min(most, len(texts) - i) + 1):
            code = "".join(texts[i : i + n])
            code = re.sub(r"[\s\-]", "", code) if fieldtype in ("account_num", "bank_num") else code
            code = code.upper() if fieldtype in ("bic", "vendor_tax_id", "customer_tax_id") else code
            if python(pattern).search(code):
                around = " ".join(texts[max(0, i - 3) : i] + texts[i + n : i + n + 3]).lower()
                out.setdefault(code, (i, 1.0 if any(x in around for x in codes.LABELS[fieldtype]) else 0.7))
                break
    return out


def test_finds_against_brute_force(spark):
    r = random.Random(51)
    some = "DEUTDEDB DEUT DEFF500 12345678 1234 5678-90 DE123456789 DE 12345 HRB-77/12 INV.2024 VAT swift account no. ref Invoice x reg 99 Ümlaut-22".split()
    texts = {d: r.choices(some, k=r.randint(0, 14)) for d in range(80)}
    df = spark.createDataFrame([w for d, ts in texts.items() for w in page(*ts, docid=d)], DDL).repartition(4)
    for kind in codes.CODES:
        got = {(x.docid, x.code): (x.pos, x.score) for x in codes.finds(df, kind).collect()}
        assert got == {(d, c): v for d, ts in texts.items() for c, v in brute(ts, kind).items()}, kind


def test_account_codes(spark):
    whole, parts = "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19".split()
    df = spark.createDataFrame(page("IBAN", whole, *parts, "x", whole, "DE00370400440532013000") + page("Bank", *parts, number=1), DDL)
    got = sorted((x.page, x.pos, x.ids, x.code) for x in codes.ibans(df).collect())
    assert got == [(0, 1, [1], whole), (0, 2, [2, 3, 4, 5, 6, 7], "".join(parts)), (1, 1, [1, 2, 3, 4, 5, 6], "".join(parts))]
    best = [(x.page, x.text) for x in codes.every_find(df, ["iban"]).orderBy("page", "pos").collect()]
    assert best == [(0, whole), (0, " ".join(parts))]
    assert codes.every_find(df.limit(0)).count() == 0


def test_every_type_has_a_matcher_that_agrees(spark):
    df = spark.createDataFrame([(t,) for t in ("1,234.56", "€12", "2024-1-5", "5 Jan 2024", "DEUTDEDB", "deutdedb", "usd", "ARS", "$", "12%", "7", "a@b.co", "AB-12/34", "x", "DE12345")], "t string")
    for kind, yes in {"amount_due": {"1,234.56", "€12", "7"}, "date_due": {"2024-1-5", "5 Jan 2024"}, "bic": {"DEUTDEDB", "deutdedb"}, "line_item_currency": {"usd", "$"}, "tax_detail_rate": {"12%", "7"}, "line_item_position": {"7"}, "vendor_email": {"a@b.co"}, "vendor_tax_id": {"DE12345", "deutdedb", "DEUTDEDB", "AB-12/34"}, "payment_reference": {"2024-1-5", "AB-12/34", "DEUTDEDB", "deutdedb", "DE12345"}}.items():
        assert {x.t for x in df.where(codes.matches(kind, df.t)).collect()} == yes, kind
    assert codes.matches("vendor_name", df.t) is None and len(codes.CODES_40) == 40 and validators.CODES[40] == "ARS"


def test_candidates(spark):
    df = spark.createDataFrame(page("due", "5", "Jan", "2024", "DE89370400440532013000"), DDL)
    assert [(x.start, x.n, x.score) for x in codes.regex_candidates(df, "date_due").collect()] == [(1, 3, 0.80)]
    assert [(x.start, x.n, x.score) for x in codes.regex_candidates(df, "iban").where("n = 1").collect()] == [(4, 1, 0.85)]
    assert codes.regex_candidates(df, "vendor_name").count() == 0


def nearest(span, words, vocabulary):
    """(left, right, above, below, label, distance) by looking at every word."""
    l, t, r, b, ids = span
    best, label = {}, ("", 2.0)
    for _, _, i, text, wl, wt, wr, wb in words:
        if i in ids:
            continue
        x, y = (wl + wr) / 2, (wt + wb) / 2
        if abs(y - (t + b) / 2) <= 0.045:
            side = ("left", l - wr) if x < l else ("right", wl - r) if x > r else None
        else:
            side = ("above", t - wb) if y < t else ("below", wt - b) if y > b else None
        if side and side[1] < best.get(side[0], (float("inf"),))[0]:
            best[side[0]] = side[1], text
        dist = ((x - (l + r) / 2) ** 2 + (y - (t + b) / 2) ** 2) ** 0.5
        if text.strip().lower() in vocabulary and dist < label[1]:
            label = text.strip().lower(), dist
    return *(best.get(k, (0, ""))[1] for k in ("left", "right", "above", "below")), label


def test_surroundings_against_brute_force(spark):
    r = random.Random(52)
    words, spans = [], []
    for doc in range(30):
        n = r.randint(1, 25)
        for i in range(n):
            l, t = round(r.random(), 2), round(r.random(), 2)
            words.append((doc, 0, i, r.choice(["Total", "date ", "x", "y", "12"]), l, t, round(l + 0.05, 3), round(t + 0.02, 3)))
        for k in range(6):
            ids = r.sample(range(n), r.randint(1, min(3, n)))
            own = [w for w in words if w[0] == doc and w[2] in ids]
            spans.append((doc, 0, k, ids, min(w[4] for w in own), min(w[5] for w in own), max(w[6] for w in own), max(w[7] for w in own)))
    df = spark.createDataFrame(words, DDL).repartition(3)
    some = spark.createDataFrame(spans, "docid long, page int, span_id int, word_ids array<int>, l double, t double, r double, b double")
    got = {(x.docid, x.span_id): x for x in joins.surroundings(some, df, ["total", "date"]).collect()}
    for doc, _, k, ids, *box in spans:
        x = got[doc, k]
        *texts, (label, dist) = nearest((*box, ids), [w for w in words if w[0] == doc], {"total", "date"})
        assert (x.left_text, x.right_text, x.above_text, x.below_text) == tuple(texts) and (x.label, x.dist) == (label, pytest.approx(min(dist, 2.0)))
    assert joins.surroundings(some.limit(0), df, []).count() == 0


def test_vectors_and_training(spark):
    df = spark.createDataFrame(page("Invoice", "No", "12/03/2024", "Total", "€12.50", "x", "y", "z"), DDL)
    spans = spark.createDataFrame([(1, 0, 0, [2]), (1, 0, 1, [4])], "docid long, page int, span_id int, word_ids array<int>")
    a = {x.span_id: x for x in learning.attributes(spans, df).collect()}
    assert (a[0].left_text, a[0].right_text, a[0].like_date, a[0].has_letters, a[1].has_currency, a[1].like_amount, a[1].label) == ("No", "Total", True, False, True, True, "total")
    rows = learning.attributes(spans, df).select("span_id", learning.vector().alias("v")).collect()
    assert all(len(x.v) == 71 for x in rows)
    own = {x.span_id: x.v for x in rows}[1]
    assert own[0] == 0.06 and own[14] == 1.0 and own[31 + learning.LABELS.index("total")] == 1.0 and sum(own[31:]) == 1.0
    fields = spark.createDataFrame([(1, 0, "amount_due", 0.2, 0.1, 0.24, 0.12)], "docid long, page int, fieldtype string, l double, t double, r double, b double")
    made = learning.training_set(fields, df, "amount_due").collect()
    assert sorted(x.label for x in made) == [0, 0, 0, 0, 0, 1] and all(len(x.features) == 71 for x in made)
    train, held = learning.split(learning.training_set(fields, df, "amount_due"))
    assert train.count() + held.count() == 6 and train.intersect(held).count() == 0


def test_validation(spark):
    r = random.Random(53)
    rows = [(r.randint(0, 1), round(r.random(), 1)) for _ in range(200)]
    got = learning.validation(spark.createDataFrame(rows, "label int, p double")).first()
    ups, downs = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert got.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in ups for b in downs) / (len(ups) * len(downs)))
    assert got.recall == pytest.approx(sum(p >= 0.5 for p in ups) / len(ups)) and got.n == 200

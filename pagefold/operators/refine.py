"""Refining a span's words by its field type. Each span is one array, and all rules are functions of arrays, so one shuffle serves all types."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.lambdas import best, let
from pagefold.operators import rows as r

PAGE = ["docid", "page"]
# Words that may lead a value and are no part of it.
LABELS = {
    "address": "bill ship to: address: from: vendor: customer: billing delivery sold invoice attn: attention: recipient: consignee: shipper: sender:".split(),
    "name": "vendor: customer: bill ship sold name: client: to: from: buyer: seller:".split(),
    "id": "invoice invoice: no. no: number: # id: order: ref: reference: document: doc: po: p.o.: contract: code: num: nr: nr no number document order".split(),
    "financial": "account: acct: account acct bank: bank bic: bic swift: swift iban: iban routing: sort sort: code: tax: vat: vat tax id: no: number: reg: reg registration: kvk: hrb: iňo: ico: abn: nif: btw:".split(),
    "amount": "total: total amount: amount due: due paid: paid gross: gross net: net tax: tax subtotal: subtotal balance: balance sum: sum".split(),
    "date": "date: date due: due issued: issued invoice payment valid: expiry: expires: from: to: period:".split(),
}
# The field types of each rule; all others go by the generic one.
TYPES = {
    "address": "customer_billing_address customer_delivery_address customer_other_address vendor_address".split(),
    "name": "customer_billing_name customer_delivery_name vendor_name customer_other_name line_item_person_name".split(),
    "id": """document_id order_id customer_id customer_order_id vendor_order_id customer_registration_id vendor_registration_id payment_reference
    line_item_code line_item_order_id line_item_position line_item_hts_number""".split(),
    "financial": "account_num bank_num bic iban vendor_tax_id customer_tax_id".split(),
    "amount": """amount_due amount_paid amount_total_gross amount_total_net amount_total_tax tax_detail_gross tax_detail_net tax_detail_tax tax_detail_rate
    currency_code_amount_due line_item_amount_gross line_item_amount_net line_item_discount_amount line_item_discount_rate line_item_tax line_item_tax_rate
    line_item_unit_price_gross line_item_unit_price_net line_item_quantity line_item_weight line_item_units_of_measure line_item_currency""".split(),
    "date": "date_due date_issue line_item_date".split(),
}
# A currency's sign or code, and a number.
CURRENCY = r"(?iu)^[\$€£¥₹₩₽฿₺₴₪]$|^(USD|EUR|GBP|CHF|JPY|CAD|AUD|NZD|SEK|NOK|DKK|PLN|CZK|HUF|RON|BGN|HRK|RUB|UAH|TRY|CNY|INR|BRL|MXN|SGD|HKD|KRW|ZAR|AED|SAR|THB|MYR|IDR|PHP|VND|kr|Kč|zł|Ft|lei|kn)$"
NUMBER, DIGIT = r"(?U)^[\d,.\s]+$", r"(?U)\d"
WORD = ("word_id", "text", "left", "top", "right", "bottom")


def _clean(w: Column) -> Column:
    return F.lower(F.trim(w["text"]))


def _is_label(w: Column, labels: Sequence[str]) -> Column:
    """Whether a word is a label, as it stands or without colons at its end."""
    return _clean(w).isin(list(labels)) | F.regexp_replace(_clean(w), ":+$", "").isin(list(labels))


def strip_labels(ws: Column, labels: Sequence[str]) -> Column:
    """Words from the first that is no label on; all labels: none."""
    plain = F.transform(ws, lambda w: ~_is_label(w, labels))
    return let(F.array_position(plain, True), lambda k: F.when(k > 0, F.slice(ws, k.cast("int"), F.size(ws))).otherwise(F.slice(ws, 1, 0)))


def rows_of(ws: Column, tolerance: float = 0.012) -> Column:
    """Words as an array of rows, from the top; in a row by top, then left."""
    ordered = F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(w["top"].alias("t"), w["left"].alias("l"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    pick = lambda o, n: F.transform(F.sequence(F.lit(0), F.array_max(n)), lambda k: F.filter(o, lambda w, i: F.element_at(n, i + 1) == k))
    return let(ordered, lambda o: F.when(F.size(o) == 0, F.array(o)).otherwise(let(r.anchored(o, tolerance), lambda n: pick(o, n))))


def _digits(row: Column) -> Column:
    return F.exists(row, lambda w: w["text"].rlike(DIGIT)).cast("int")


def longest_run(ws: Column) -> Column:
    """The words of the longest run of consecutive word_ids, the first of equals, in their order; a word that comes twice stays twice."""
    return let(r.longest_run(F.transform(ws, lambda w: w["word_id"])), lambda ids: F.filter(ws, lambda w: F.array_contains(ids, w["word_id"])))


def address(ws: Column, gap: float = 0.04) -> Column:
    """Of the rows after those that are labels alone, the largest block of rows each less than gap under the one before."""

    def block(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda row: ~F.forall(row, lambda w: _is_label(w, LABELS["address"]))), True)
        rest = F.slice(rows, first.cast("int"), F.size(rows))
        start = F.struct(F.lit(None).cast("double").alias("bottom"), F.slice(F.array(rows), 1, 0).alias("blocks"))

        def step(s: Column, row: Column) -> Column:
            top, bottom = F.array_min(F.transform(row, lambda w: w["top"])), F.array_max(F.transform(row, lambda w: w["bottom"]))
            near = F.coalesce(top - s["bottom"] < gap, F.lit(False))
            grown = F.concat(F.slice(s["blocks"], 1, F.size(s["blocks"]) - 1), F.array(F.array_append(F.element_at(s["blocks"], -1), row)))
            return F.struct(bottom.alias("bottom"), F.when(near, grown).otherwise(F.array_append(s["blocks"], F.array(row))).alias("blocks"))

        blocks = F.aggregate(rest, start, step, lambda s: s["blocks"])
        words = lambda b: F.aggregate(b, F.lit(0), lambda n, row: n + F.size(row))
        return F.when(first == 0, ws).otherwise(F.flatten(best(blocks, words)))

    return let(rows_of(ws), block)


def name(ws: Column) -> Column:
    """The row with the most words."""
    return best(rows_of(ws), F.size)


def single_value(ws: Column) -> Column:
    """The row with a digit, then the most words; of more than five words the longest run."""
    return let(best(rows_of(ws), lambda row: 2 * _digits(row) + F.size(row)), lambda x: F.when(F.size(x) > 5, longest_run(x)).otherwise(x))


def financial_code(ws: Column) -> Column:
    """The first row."""
    return F.element_at(rows_of(ws, 0.015), 1)


def amount(ws: Column) -> Column:
    """The row with a digit, then the most words; of more than three words the first run of numbers with the currencies before it and one right after."""
    money = lambda w: F.coalesce(F.trim(w["text"]).rlike(CURRENCY), F.lit(False))
    number = lambda w: w["text"].rlike(DIGIT) & F.replace(F.trim(w["text"]), F.lit(" "), F.lit("")).rlike(NUMBER)

    def run(row: Column) -> Column:
        start = F.struct(F.lit(0).alias("phase"), F.slice(row, 1, 0).alias("kept"))  # 0 before a number, 1 in the run, 2 past it

        def step(s: Column, w: Column) -> Column:
            state = lambda phase, keep: F.struct(F.lit(phase).alias("phase"), (F.array_append(s["kept"], w) if keep else s["kept"]).alias("kept"))
            before = F.when(money(w), state(0, True)).when(number(w), state(1, True)).otherwise(state(0, False))
            inside = F.when(number(w), state(1, True)).when(money(w), state(2, True)).otherwise(state(2, False))
            return F.when(s["phase"] == 2, s).when(s["phase"] == 1, inside).otherwise(before)

        return let(F.aggregate(row, start, step, lambda s: s["kept"]), lambda k: F.when(F.size(k) > 0, k).otherwise(row))

    return let(best(rows_of(ws), lambda row: 3 * _digits(row) + F.size(row)), lambda x: F.when(F.size(x) > 3, run(x)).otherwise(x))


def date(ws: Column) -> Column:
    """The row with a digit, then few words, then the most; of more than three words the first three of the longest run."""
    score = lambda row: 3 * _digits(row) + F.when(F.size(row) <= 3, 2).otherwise(0) + F.size(row)
    return let(best(rows_of(ws), score), lambda x: F.when(F.size(x) > 3, F.slice(longest_run(x), 1, 3)).otherwise(x))


def generic(ws: Column) -> Column:
    """The longest run; words of one row stay as they are if that would keep less than half of them."""
    run = lambda x: F.when((F.size(rows_of(ws)) == 1) & (F.size(x) < F.floor(F.size(ws) / 2)), ws).otherwise(x)
    return let(longest_run(ws), run)


RULES = {"address": address, "name": name, "id": single_value, "financial": financial_code, "amount": amount, "date": date}


def _unless_empty(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda ws: F.when(F.size(ws) > 0, rule(ws)).otherwise(ws)


def refined(fieldtype: Column, ws: Column) -> Column:
    """ws after the rule of the field type; ws itself where nothing would be left. No words: none."""
    out = generic(ws)
    for rule, types in TYPES.items():
        out = F.when(fieldtype.isin(types), let(strip_labels(ws, LABELS[rule]), _unless_empty(RULES[rule]))).otherwise(out)
    kept = let(out, lambda x: F.when(F.size(x) > 0, x).otherwise(ws))
    return F.when(F.size(ws) == 0, ws).otherwise(kept)


def guard(fieldtype: Column, ws: Column, after: Column) -> Column:
    """after, unless a word was taken away that is no label of the type: then ws without its leading labels. Row-grouped types are not guarded."""
    kept = F.transform(after, lambda w: w["word_id"])

    def by(labels: Sequence[str]) -> Column:
        lost = F.exists(ws, lambda w: ~F.array_contains(kept, w["word_id"]) & ~F.regexp_replace(_clean(w), ":+$", "").isin(list(labels)))
        bare = strip_labels(ws, labels) if labels else ws
        return F.when((F.size(after) < F.size(ws)) & lost, F.when(F.size(bare) > 0, bare).otherwise(ws)).otherwise(after)

    out = by([])
    for rule, types in TYPES.items():
        out = F.when(fieldtype.isin(types), by(LABELS[rule])).otherwise(out)
    return F.when(fieldtype.startswith("line_item_"), after).otherwise(out)


def span_words(spans: DataFrame, words: DataFrame) -> DataFrame:
    """spans (docid, page, span_id, word_ids, and others) with ws: the words they name, in the order of word_ids; unknown ids are left out."""
    named = spans.select(*PAGE, "span_id", F.posexplode("word_ids").alias("i", "word_id")).join(words.select(*PAGE, *WORD), [*PAGE, "word_id"])
    held = named.groupBy(*PAGE, "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(*WORD).alias("w")))), lambda x: x["w"]).alias("ws"))
    return spans.join(held, [*PAGE, "span_id"])


def refine(spans: DataFrame, words: DataFrame, guarded: bool = False) -> DataFrame:
    """docid, page, span_id, fieldtype, ids, l, t, r, b of spans (docid, page, span_id, fieldtype, word_ids) after their types' rules. A span without known words is dropped."""
    held = span_words(spans, words)
    out = refined(F.col("fieldtype"), F.col("ws"))
    held = held.withColumn("after", let(out, lambda x: guard(F.col("fieldtype"), F.col("ws"), x)) if guarded else out)
    side = lambda f, c: f(F.transform("after", lambda w: w[c]))
    box = [side(F.array_min, "left").alias("l"), side(F.array_min, "top").alias("t"), side(F.array_max, "right").alias("r"), side(F.array_max, "bottom").alias("b")]
    return held.select(*PAGE, "span_id", "fieldtype", F.transform("after", lambda w: w["word_id"]).alias("ids"), *box)


def resolve(answers: DataFrame, words: DataFrame, use_refiner: bool = True, guarded: bool = False, least: float = 0.7) -> DataFrame:
    """docid, page, ord, fieldtype, l, t, r, b, score, line_item_id of parsed answers (docid, page, ord, fieldtype, text, word_ids, score, line_item_id).

    The box is that of the refined words, or of the named words as they are; an answer that names no known word takes the run of the page most
    like its text, from least on; one that has neither is dropped. The score is times the format confidence of the text.
    """
    from pagefold.functions.validators import format_confidence
    from pagefold.operators import align, joins

    keys = [*PAGE, "span_id"]
    spans = answers.withColumn("span_id", F.col("ord"))
    named = spans.where(F.size("word_ids") > 0).select(*keys, "fieldtype", "word_ids")
    if use_refiner:
        boxes = refine(named, words, guarded).select(*keys, "l", "t", "r", "b")
    else:
        boxes = joins.union_of_words(named, words, ["span_id"]).select(*keys, *(F.col(a).alias(b) for a, b in zip(("left", "top", "right", "bottom"), "ltrb", strict=True)))
    left = spans.join(boxes.select(*keys), keys, "left_anti").where(F.trim("text") != "").select(*PAGE, F.col("span_id").cast("long").alias("qid"), F.col("text").alias("query"))
    aligned = align.text_fields(left, words, least).select(*PAGE, F.col("qid").cast(spans.schema["span_id"].dataType).alias("span_id"), *(F.col(a).alias(b) for a, b in zip(("left", "top", "right", "bottom"), "ltrb", strict=True)))
    both = spans.join(boxes.unionByName(aligned), keys)
    score = F.col("score") * format_confidence(F.col("fieldtype"), F.coalesce("text", F.lit("")))
    return both.select(*PAGE, "ord", "fieldtype", "l", "t", "r", "b", score.alias("score"), "line_item_id")

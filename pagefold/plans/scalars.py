"""Queries of the scalar functions, over fixed values and columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import catalog, geometry, text, validators
from pagefold.sources import views as v

VALUES = [
    ("iban", "GB29NWBK60161331926819"), ("iban", "GB00NWBK60161331926819"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "de89370400440532013000"), ("iban", "DE89"), ("iban", ""),
    ("iban", "MT84MALT011000012345MTLCAST001S"), ("bic", "DEUTDEDB"), ("bic", " deutdedbxxx "), ("bic", "DEUTDEDBX"), ("bic", "1EUTDEDB"), ("vendor_tax_id", "DE123456789"), ("vendor_tax_id", "12345"),
    ("vendor_tax_id", "DE 123"), ("vendor_tax_id", "a#b"), ("customer_tax_id", "x"), ("customer_tax_id", " "), ("vendor_registration_id", "HRB 12345"), ("vendor_registration_id", "a!"), ("vendor_registration_id", "ab"),
    ("amount_due", "EUR 1,234.56"), ("amount_due", "$12"), ("amount_due", "12 USD"), ("amount_due", "abc"), ("amount_due", "1;2"), ("amount_due", "€ 1.234,56"), ("amount_due", "1 234,00 kr"), ("amount_due", "1234,5"),
    ("amount_due", "1.234"), ("amount_due", "1,234"), ("amount_due", "1,23"), ("amount_due", ""), ("amount_due", "1e5"), ("amount_due", "-7"), ("amount_due", "1.234.567,89"), ("tax_detail_rate", "19%"), ("tax_detail_rate", "19.5 %"), ("tax_detail_rate", "119"), ("tax_detail_rate", "x"),
    ("date_issue", "2024-01-15"), ("date_issue", "1/15/24"), ("date_issue", "15.1.2024"), ("date_issue", "15 Jan 2024"), ("date_issue", "January 15, 2024"), ("date_issue", "soon"), ("date_issue", "15-01-2024"), ("date_due", "2024-1-5"),
    ("currency_code_amount_due", "eur"), ("currency_code_amount_due", "$"), ("currency_code_amount_due", "XYZ"), ("currency_code_amount_due", "euro"), ("vendor_email", "a.b@c.de"), ("vendor_email", "a@b"),
    ("line_item_quantity", "-3,5"), ("line_item_quantity", "3x"), ("line_item_position", "12"), ("line_item_position", "1a"), ("vendor_name", "Any Thing"),
]
_MORE = """select 'date_issue' as fieldtype, cast(cast(o_orderdate as date) as string) as text from {orders}
union all select 'amount_due', cast(cast(l_extendedprice as decimal(12,2)) as string) from {lineitem} union all select 'line_item_quantity', cast(cast(l_quantity as int) as string) from {lineitem}
union all select 'vendor_tax_id', c_name from {customer} union all select 'bic', upper(c_mktsegment) from {customer} union all select 'vendor_registration_id', s_name from {supplier}
union all select 'tax_detail_rate', concat(cast(cast(l_discount * 1000 as int) as string), '%') from {lineitem} union all select 'currency_code_amount_due', l_shipdate_code from (select upper(substring(p_name, 1, 3)) as l_shipdate_code from {part}) x
union all select 'vendor_email', concat(replace(c_name, '#', '.'), '@example.com') from {customer}"""
TABLES = ("orders", "lineitem", "customer", "supplier", "part")
_INLINE = ", ".join("('" + a + "', '" + b + "')" for a, b in VALUES)
VALUES_SQL = f"vals as (select fieldtype, text from (values {_INLINE}) t(fieldtype, text) union all {_MORE.format(**{t: t for t in TABLES}).replace('as string)', 'as varchar)')}), d as (select distinct fieldtype, text from vals)"


def values(spark, d):
    more = spark.sql(_MORE, **{t: v.read(spark, d, t) for t in TABLES})
    return spark.createDataFrame(VALUES, "fieldtype string, text string").union(more).distinct()


def _checked(family):
    types = catalog.FAMILIES[family]
    return lambda s, d: values(s, d).where(F.col("fieldtype").isin(types)).withColumn("confidence", validators.format_confidence(F.col("fieldtype"), F.col("text")))


_S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_M = validators.MONTHS
_SIGN = validators.SIGNS
_CODES = tuple(validators.CODES)
_CONFIDENCE = {
    "iban": "case when length(n) between 15 and 34 and regexp_matches(n, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$') and list_reduce(list_prepend(0, list_transform(string_split(n[5:] || n[:4], ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97) = 1 then 1.0 else 0.0 end",
    "bic": "case when length(u) in (8, 11) and regexp_matches(u, '^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$') then 1.0 else 0.0 end",
    "tax_id": r"case when s = '' or regexp_matches(s, '[^\w\s\-./]') then 0.0 when regexp_matches(s, '\s') then 0.5 when regexp_matches(s, '(?i)^[A-Z]{2}[\w\-./]{5,}$') or regexp_matches(s, '^\d[\d\-./]{4,}$') then 1.0 else 0.5 end",
    "registration_id": r"case when s = '' then 0.0 when regexp_matches(s, '[^\w\s\-./]') then 0.5 when regexp_matches(s, '(?i)^[A-Z0-9][\w\-./\s]{3,14}$') then 1.0 else 0.5 end",
    "amount": rf"case when s = '' or regexp_matches(s, '(?i)[^\d,.\s{_SIGN}A-Z%-]') then 0.0 when regexp_matches(s, '(?i)^(?:[{_SIGN}]|[A-Z]{{3}}\s*)?\d[\d,.\s]*(?:\s*(?:[A-Z]{{3}}|[{_SIGN}]))?$') then 1.0 else 0.0 end",
    "rate": r"case when regexp_matches(s, '^\d+(\.\d+)?\s*%?$') and cast(regexp_replace(s, '[%\s]', '', 'g') as double) between 0 and 100 then 1.0 else 0.0 end",
    "date": rf"case when regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}$|^\d{{1,2}}/\d{{1,2}}/\d{{2,4}}$|^\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}$|^\d{{1,2}}-\d{{1,2}}-\d{{2,4}}$|(?i)^\d{{1,2}}\s+(?:{_M})[a-z]*\.?\s*,?\s*\d{{2,4}}$|(?i)^(?:{_M})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}}$') or (regexp_matches(s, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') and try_cast(s as date) is not null) then 1.0 else 0.0 end",
    "currency": f"case when u in {tuple(_SIGN)} or u in {_CODES} then 1.0 when regexp_matches(u, '^[A-Z]{{3}}$') then 0.5 else 0.0 end",
    "email": r"case when regexp_matches(s, '^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$') then 1.0 else 0.0 end",
    "quantity": r"case when regexp_matches(s, '^-?\d+([.,]\d+)?$') then 1.0 else 0.0 end",
    "position": r"case when regexp_matches(s, '^\d+$') then 1.0 else 0.0 end",
}


def _confidence_sql(family):
    types = ", ".join(f"'{t}'" for t in catalog.FAMILIES[family])
    return f"with {VALUES_SQL}, x as (select *, {_S} as s, upper({_S}) as u, upper(replace(text, ' ', '')) as n from d where fieldtype in ({types})) select fieldtype, text, cast({_CONFIDENCE[family]} as double) as confidence from x"


def _docs(s, d):
    return v.read(s, d, "documents").select(F.col("doc_id").alias("docid"), F.coalesce("text", F.lit("")).alias("text"))


_TEXT = "select doc_id as docid, coalesce(text, '') as text from documents"
_STOP = tuple(text.STOPWORDS)

QUERIES = {f"format_confidence_{f}": _checked(f) for f in validators.VALIDATORS}
SQL = {f"format_confidence_{f}": _confidence_sql(f) for f in validators.VALIDATORS}
QUERIES |= {
    "format_confidence": lambda s, d: values(s, d).withColumn("confidence", validators.format_confidence(F.col("fieldtype"), F.col("text"))).groupBy("fieldtype", "confidence").agg(F.count("*").alias("n")),
    "validator_check": lambda s, d: values(s, d).where("fieldtype = 'bic'").select("text", validators.validator_check(F.col("fieldtype"), F.col("text")).alias("kept")),
    "parse_amount": lambda s, d: values(s, d).where("fieldtype = 'amount_due'").select("text", text.parse_amount(F.col("text")).alias("amount")),
    "text_shape": lambda s, d: values(s, d).select("text", text.shape(F.col("text")).alias("shape")).distinct(),
    "metric_text": lambda s, d: values(s, d).select("text", text.metric_text(F.col("text")).alias("normal"), text.digits_only(F.col("text")).alias("digits"), text.compact(F.col("text")).alias("compact")).distinct(),
    "keyword_tokens": lambda s, d: _docs(s, d).select("docid", F.size(text.keyword_tokens(F.col("text"))).cast("long").alias("n")),
    "vocab_tokens": lambda s, d: v.words(s, d).select("docid", text.vocab_token(F.col("text")).alias("token")).where("token is not null").groupBy("docid").agg(F.countDistinct("token").alias("n")),
    "scale_thousand": lambda s, d: v.words(s, d).select("docid", "page", "word_id", geometry.to_thousand(F.col("left")).alias("rounded"), geometry.to_thousand_cut(F.col("left")).alias("cut")),
    "l2_normalised": lambda s, d: v.read(s, d, "embeddings").select("vec_id", F.round(geometry.dot(geometry.normalised(F.col("embedding")), geometry.normalised(F.col("embedding"), added=True)), 6).alias("self")),
    "align_text": lambda s, d: v.read(s, d, "part").select("p_partkey", text.align_text("p_name").alias("a"), text.nfkc_lower("p_name").alias("b"), text.ocr_code(F.col("p_name")).alias("c")),
    "sequence_ratio": lambda s, d: v.read(s, d, "part").select("p_partkey", text.sequence_ratio("p_name", "p_type").alias("ratio"), text.partial_ratio("p_brand", "p_name").alias("partial")),
}
_AMOUNT = r"regexp_replace(text, '[€$£¥₹₣a-df-zA-DF-Z\s]', '', 'g')"
SQL |= {
    "format_confidence": "with " + VALUES_SQL + ", x as (select *, " + _S + " as s, upper(" + _S + ") as u, upper(replace(text, ' ', '')) as n from d), c as (select fieldtype, cast(case " + " ".join(f"when fieldtype in ({', '.join(repr(t) for t in catalog.FAMILIES[f])}) then {e}" for f, e in _CONFIDENCE.items()) + " else 1.0 end as double) as confidence from x) select fieldtype, confidence, count(*) as n from c group by all",
    "validator_check": f"with {VALUES_SQL}, x as (select text, upper({_S}) as u from d where fieldtype = 'bic') select text, cast(case when {_CONFIDENCE['bic']} >= 0.5 then 1.0 end as double) as kept from x",
    "parse_amount": rf"""with {VALUES_SQL}, x as (select text, {_AMOUNT} as c from d where fieldtype = 'amount_due'), y as (select text, case
  when regexp_matches(c, '\.\d{{3}},\d{{2}}$') or (contains(c, ',') and contains(c, '.') and instr(reverse(c), ',') < instr(reverse(c), '.')) then replace(replace(c, '.', ''), ',', '.')
  when contains(c, ',') and not contains(c, '.') then case when instr(reverse(c), ',') = 4 then replace(c, ',', '') else replace(c, ',', '.') end else c end as n from x)
select text, case when regexp_matches(n, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then cast(n as double) end as amount from y""",
    "text_shape": rf"with {VALUES_SQL} select distinct text, left(regexp_replace(regexp_replace(text, '\p{{L}}', 'A', 'g'), '\p{{Nd}}', '9', 'g'), 20) as shape from d",
    "metric_text": rf"with {VALUES_SQL} select distinct text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as normal, regexp_replace(text, '\D', '', 'g') as digits, regexp_replace(text, '\s+', '', 'g') as compact from d",
    "keyword_tokens": f"select docid, cast(len(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2 and w not in {_STOP})) as bigint) as n from ({_TEXT})",
    "vocab_tokens": f"with {v.WORDS}, t as (select docid, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as token from words) select docid, count(distinct token) as n from t where length(token) >= 2 group by 1",
    "scale_thousand": f"""with {v.WORDS} select docid, page, word_id, cast(round_even("left" * 1000, 0) as int) as rounded, cast(trunc("left" * 1000) as int) as cut from words""",
    "l2_normalised": "select vec_id, round(cast(list_dot_product(embedding::double[], embedding::double[]) / (greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-8) * (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-8)) as double), 6) as self from embeddings",
    "align_text": r"select p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) as a, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) as b, translate(trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')), 'ol ', '01') as c from part",
}

"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import bpe, chat, fingerprints, licenses, packing, quality, secrets, simhash, tokenfile, warc
from pagefold.llm.common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to archives, then reads all of them back through the index."""
    folder = scratch(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).selectExpr("page_id", "payload_bytes", "digest as payload_digest", "record_type", "refers_to")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of every conversation that no longer one begins with."""
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    return fingerprints.fingerprint_rows(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_rows(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the tokenization automaton, and back."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids into directly addressable files, and read from them."""
    folder = scratch(spark, "ids")
    manifest = tokenfile.write_ids(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_documents(manifest, folder)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the classifier's verdict on every document."""
    return quality.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return licenses.license_rows(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and place."""
    return packing.pack(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4_secrets: the base spans."""
    return op4_secrets(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7_quality: the base rules."""
    return op7_quality(spark, sf_dir).drop("p_quality", "kept")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_licenses: the base phrases."""
    return op10_licenses(spark, sf_dir).drop("labels", "score")


def fingerprints_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3_fingerprints: the edited texts."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "secrets_base": secrets_base,
    "quality_base": quality_base,
    "licenses_base": licenses_base,
    "fingerprints_base": fingerprints_base,
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_fingerprints": op3_fingerprints,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_token_file": op6_token_file,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
}

SQL = {
    "op1_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when first_id < page_id then 'revisit' else 'response' end as record_type,
  case when first_id < page_id then first_id end as refers_to
from f""",
    "op2_chat": """
with t as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as place,
    md5(coalesce('r' || role, 'n') || chr(10) || coalesce('t' || text, 'n')) as h from conversations
), p as (
  select *, list(h) over (partition by conv_id order by place rows between unbounded preceding and current row) as prefix,
    count(*) over (partition by conv_id) as n_turns from t
), w as (
  select prefix, min(conv_id) as conv_id from p where place = n_turns group by prefix
), m as (
  select conv_id from w where not exists (select 1 from p where p.prefix = w.prefix and p.place < p.n_turns)
)
select conv_id, turn, place, n_turns, role,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) as rendered
from p where conv_id in (select conv_id from m)""",
    "op9_packing": r"""
with recursive lens as (
  select doc_id, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as n_tokens from documents
), h as (
  select greatest(n_tokens, 1) as size, count(*) as c from lens group by 1
), s as (
  select row_number() over (order by size) as j, size, cast(sum(c) over (order by size) as bigint) as upto from h
), dp as (
  select 1 as k, j, size * upto as cost, cast(1 as bigint) as i from s
  union all
  select k + 1, s.j, min(cost + s.size * (s.upto - q.upto)), arg_min(q.j + 1, (cost + s.size * (s.upto - q.upto), q.j))
  from dp join s q on q.j = dp.j join s on s.j > q.j where k < 16 and q.j >= k group by k, s.j
), cut as (
  select k, j, i from dp where k = (select least(16, max(j)) from s) and j = (select max(j) from s)
  union all
  select dp.k, dp.j, dp.i from cut join dp on dp.k = cut.k - 1 and dp.j = cut.i - 1
), cuts as (
  select cast(row_number() over (order by size) - 1 as int) as bucket, size as padded, coalesce(lag(size) over (order by size), 0) as low from cut join s using (j)
), placed as (
  select doc_id, n_tokens, bucket, padded, row_number() over (partition by bucket order by doc_id nulls first, n_tokens) - 1 as r
  from lens join cuts on greatest(n_tokens, 1) > low and greatest(n_tokens, 1) <= padded
)
select doc_id, n_tokens, bucket, padded, cast(r // greatest(1, 65536 // padded) as bigint) as batch, cast(r % greatest(1, 65536 // padded) as bigint) as slot from placed""",
    "secrets_base": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
k as (
  select doc_id, t, 0 as kind, 'assign' as name, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' as p from d
  union all select doc_id, t, 1, 'access', 'AKIA[A-Z0-9]+' from d union all select doc_id, t, 2, 'hex', '[0-9a-f]+' from d
), m as (
  select *, regexp_extract_all(t, p) as found, string_split_regex(t, p) as gaps from k
), e as (
  select doc_id, kind, name, p, gaps, found, unnest(range(1, len(found) + 1)) as i from m
), s as (
  select doc_id, kind, name, found[i] as x, p, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) as start from e
  where case kind when 0 then true when 1 then length(found[i]) >= 16 else length(found[i]) >= 32 end
), b as (
  select *, cast(start as bigint) as a, cast(start + length(x) as bigint) as z from s where kind <> 0 or length(regexp_extract(x, p, 2)) >= 8
), g as (
  select doc_id, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex, string_agg(concat(name, ':', a, ':', z), ',' order by a, kind) as spans from b group by 1
)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join g using (doc_id)""",
    "quality_base": r"""
with d as (
  select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents
), v as (
  select doc_id, w, unnest(range(1, len(w) - 6)) as i from d
), g as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') as eight from v
), r as (
  select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from (select doc_id, i, count(*) over (partition by doc_id, eight) as n from g) where n > 1) group by 1
), c as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from d left join r using (doc_id)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c""",
    "licenses_base": r"""
with d as (
  select doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents
), p as (
  select * from (values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) t(phrase, label)
), h as (
  select doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) as i from (select * from d where list_contains(w, 'license')) d, p
), g as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from h group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join g using (doc_id)""",
    "fingerprints_base": """
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over (order by doc_id), first(coalesce(text, '')) over (order by doc_id)) as following from documents
)
select doc_id, cast(length(t) as bigint) as n_chars, sha256(left(t, length(t) - length(t) // 4) || left(following, length(t) // 4)) as edited_sha256 from d""",
}

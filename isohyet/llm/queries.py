"""Registered queries of this folder and the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm.common import collapsed, documents
from isohyet.llm.exact_dedup import exact_duplicates
from isohyet.llm.language_id import predict_languages
from isohyet.llm.license_scan import license_scan
from isohyet.llm.merkle import merkle_manifest
from isohyet.llm.mixing import mix
from isohyet.llm.near_dedup import near_duplicates
from isohyet.llm.packing import pack
from isohyet.llm.pii import pii_digest, pii_scan
from isohyet.llm.quality_gam import quality_scores
from isohyet.llm.quality_rules import quality_rules
from isohyet.llm.secrets import secret_digest, secret_scan
from isohyet.llm.simhash import simhash_duplicates
from isohyet.llm.spelling import spelling_variants, word_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
 doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder), carry={"text_sha256": F.sha2(collapsed("text"), 256)})


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), vocabulary())


@query("op10_minhash", r"""
with recursive
w as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x20\x09-\x0D]+') if x <> ''] ws from documents),
g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws]
 else [list_slice(ws, i, i + 1) for i in range(1, len(ws))] end) sh from w),
n as (select doc_id, count(*) n from g group by 1),
pair as (select x.doc_id a, y.doc_id b, count(*) k from g x join g y on x.sh = y.sh and x.doc_id <> y.doc_id group by all),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
walk as (select doc_id a, doc_id b from documents union select walk.a, link.b from walk join link on walk.b = link.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.m as component_id, d.doc_id = c.m as kept
from documents d left join n using (doc_id) join (select a, min(b) m from walk group by 1) c on c.a = d.doc_id""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), words=2, percent=80)


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder))


@query("op1_secrets")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(secret_scan(documents(spark, folder)))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(pii_scan(documents(spark, folder)))


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    labels = documents(spark, folder, "labels").filter(fold(5) != 0)
    scored = quality_scores(documents(spark, folder), labels)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    predicted = predict_languages(docs, docs.filter(fold(3) != 1))
    return predicted.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    # Documents have no paths: source, thousand of the id and id stand for directories and file name.
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return license_scan(documents(spark, folder).withColumn("path", path), carry={"doc_id": F.col("doc_id")})


#: The unsigned CRC-32 of a list of bytes `{0}` in DuckDB, where `t` is the table of 256 remainders.
CRC_TABLE = "(select list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) order by b) from range(256) r(b))"


def crc_sql(bytes_sql: str, table: str) -> str:
    step = f"xor(c >> 8, {table}[xor(c & 255, b) + 1])"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {bytes_sql}), lambda c, b: {step}))"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: str) -> str:
    return f"coalesce(concat(octet_length(encode({value}::varchar)), ':', {value}::varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field(c if c != "text" else text) for c in ("doc_id", "source", "lang", "n_chars", "text")) + "))"


@query("op11_merkle_manifest", f"""
with recursive t as (select {CRC_TABLE} t),
d as (select doc_id, source, {_leaf("text")} leaf,
 case when {crc_sql("[ascii(x)::bigint for x in string_split(doc_id::varchar, '')]", "t")} % 5 = 0 then {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")}
  else {_leaf("text")} end other from documents, t),
p as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 pos, count(*) over (partition by source) n,
 dense_rank() over (order by source nulls first) - 1 tree from d),
up as (
 select 0 lv, tree, pos, n, leaf digest from p
 union all select lv + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from up where n > 1 group by lv, tree, pos // 16, n),
nodes as materialized (select * from up),
subs as (select tree, digest from nodes where n = 1),
top as (
 select 0 lv, tree pos, count(*) over () n, digest from subs
 union all select lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by lv, pos // 16, n),
tops as materialized (select * from top),
steps as (
 select p.tree, p.pos, x.lv, string_agg(case when x.pos < (p.pos >> (4 * x.lv)) then x.digest end, '' order by x.pos) a,
  string_agg(case when x.pos > (p.pos >> (4 * x.lv)) then x.digest end, '' order by x.pos) b
 from p join nodes x on x.tree = p.tree and x.n > 1 and (x.pos >> 4) = (p.pos >> (4 * x.lv + 4)) group by all
 union all
 select p.tree, p.pos, 100 + x.lv, string_agg(case when x.pos < (p.tree >> (4 * x.lv)) then x.digest end, '' order by x.pos),
  string_agg(case when x.pos > (p.tree >> (4 * x.lv)) then x.digest end, '' order by x.pos)
 from p join tops x on x.n > 1 and (x.pos >> 4) = (p.tree >> (4 * x.lv + 4)) group by all),
proof as (
 select tree, pos, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} order by lv) s,
  sha256(string_agg(concat(a, b), '' order by lv)) h from steps group by all),
last as (
 select p.doc_id, p.leaf, subs.digest subroot, (select digest from tops where n = 1) root, coalesce(h, sha256('')) proof_sha256,
  coalesce(list_reduce(list_concat([other], list_transform(s, lambda x: x.a || chr(0) || x.b)), lambda c, x: sha256(replace(x, chr(0), c))), other) folded_root
 from p join subs using (tree) left join proof using (tree, pos))
select *, folded_root = root as verified from last""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.when(fold(5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest(documents(spark, folder), tampered)


#: UTF-8 bytes of a text of ASCII and Latin-1 letters.
BYTES = "flatten([case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end for x in string_split({0}, '')])"


@query("op12_spelling_variants", f"""
with recursive t as (select {CRC_TABLE} t),
r as (
 select doc_id, translate(run, '{UPPER}', '{LOWER}') run, count(*) k
 from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) run from documents) group by all),
h as (select run, k, {crc_sql(BYTES.format("(coalesce(doc_id::varchar, '') || ':' || run)"), "t")} h from r, t),
w as materialized (
 select word, sum(k)::bigint n from (
  select case when h % 199 = 0 then run[:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end word, k from h)
 where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, word[:i - 1] || word[i + 1:] rest from (select *, unnest(range(1, length(word) + 1)) i from w)),
near as (
 select distinct a.word, a.n, b.word other, b.n other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
 union select a.word, a.n, b.word, b.n from cut a join w b on a.rest = b.word
 union select b.word, b.n, a.word, a.n from cut a join w b on a.rest = b.word),
best as (select word, any_value(n) n, count(*) n_near, max(other_n) top from near group by word),
form as (
 select b.word, min(x.other) form, any_value(b.top) form_n from best b join near x on x.word = b.word and x.other_n = b.top
 where b.top >= 5 * b.n group by b.word),
walk as (select word, word root, 0 step from w union all select k.word, f.form, step + 1 from walk k join form f on f.word = k.root)
select w.word, w.n, coalesce(b.n_near, 0) n_near, f.form, f.form_n, (select arg_max(root, step) from walk k where k.word = w.word) root
from w left join best b using (word) left join form f using (word)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(word_counts(documents(spark, folder), drop_one_in=199))


@query("op13_simhash")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_duplicates(documents(spark, folder))

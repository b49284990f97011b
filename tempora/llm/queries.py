"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, lexical, line_dedup, mixing, quality, secrets, simhash, spelling, token_counts, topk, warc
from .shared import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(_table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; then those labelled toxic are withdrawn, and of the others those labelled bad are revised, runs of marks
    becoming blanks. The second batch is committed twice, as after a failure."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ledger = token_counts.Ledger(spark, table_path(spark, "token-counts"))
    ledger.commit("load", token_counts.count(docs).withColumn("op", F.lit("insert")))
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    clean = F.regexp_replace("text", "[#$%&*|!]+", " ")
    revised = token_counts.count(docs, text=clean).join(marked.where("toxic = 0 and quality = 0").select("doc_id"), "doc_id")
    withdrawn = docs.select("doc_id").join(marked.where("toxic = 1"), "doc_id").select(
        F.lit("delete").alias("op"), "doc_id", *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "tokenizer")], F.lit(None).cast("long").alias("n_tokens")
    )
    changes = revised.withColumn("op", F.lit("revise")).unionByName(withdrawn)
    for _ in range(2):
        ledger.commit("labels", changes)
    return ledger.totals()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    each = (
        op1_secrets, op2_line_dedup, op3_warc, op4_topk, op5_quality, op6_simhash, op7_token_counts, op8_decontaminate, op9_language, op10_mixing, op11_bpe, op12_lexical, op13_spelling,
    )
    return {f.__name__: f for f in each}


OP3_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages
), f as (select h, min(page_id) as first from p where n >= 100 group by h)
select page_id, n::bigint as payload_bytes, p.h as payload_digest,
       case when f.first is null or page_id is not distinct from f.first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from f.first then f.first end as refers_to
from p left join f on p.h = f.h
"""

OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, p.vec_id, coalesce(list_sum(list_transform(list_zip(q.c, p.c), lambda z: z[1] * z[2])), 0)::bigint as score
  from v q join v p on q.vec_id % 100 = 0 and q.vec_id <> p.vec_id
)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
) where rank <= 10
"""

OP7_SQL = r"""
with m as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
d as (
  select d.doc_id, source, lang,
         case when m.toxic = 0 and m.quality = 0 then regexp_replace(text, '[#$%&*|!]+', ' ', 'g') else text end as text
  from documents d left join m using (doc_id) where coalesce(m.toxic, 0) <> 1
), t as (
  select source, lang, 'words-1' as tokenizer, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) as n from d
  union all
  select source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^ 	-
\p{L}\p{N}]')), 0) from d
)
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from t group by all
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as k
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source is null, source) - 1)::bigint as nth
  from d group by source
), w as (
  select *, case nth % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), r as (
  select *, sum(source_size) over () as all_size, sum(weight) over () as all_weight,
         coalesce(sum(source_size) over b, 0) as capped, coalesce(sum(weight) over b, 0) as gone
  from w window b as (order by source_size / weight, nth rows between unbounded preceding and 1 preceding)
), q as (
  select *, (all_size::double * 1.5::double - capped::double * 2) / (all_weight - gone) as rate from r
), l as (
  select arg_min(rate, (source_size / weight, nth)) filter (rate * weight <= source_size * 2) as level from q
), t as (
  select source, source_size,
         case when rate * weight > source_size * 2 or level is null then source_size * 2.0::double else level * weight end as target
  from q, l
), p as (
  select d.*, t.source_size, t.target, round(t.target)::bigint as words,
         coalesce(sum(d.size) over (partition by d.source order by k, d.size, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as lo
  from d join t on d.source is not distinct from t.source
)
select doc_id, size::bigint as size, source, source_size, target,
       case when source_size = 0 then 0 else
         (size * (words // source_size) + greatest(0, least(lo + size, words % source_size) - lo))::bigint end as taken
from p
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
with t as (
  select doc_id, row_number() over () as row, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as all_of from documents where text is not null
), d as (select doc_id, row, len(all_of)::bigint as n, all_of from t where len(all_of) > 0
), c as (select count(*)::bigint as docs, sum(n)::bigint as len from d
), i as (
  select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null
), f as (
  select doc_id, row, n, term, count(*)::bigint as tf from (select doc_id, row, n, unnest(all_of) as term from d)
  where term in (select term from i) group by all
), w as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, c group by term, docs
), s as (
  select i.item_id, f.row, any_value(f.doc_id) as doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * c.docs) // c.len))))::bigint as score
  from i join f using (term) join w using (term), c group by i.item_id, f.row
)
select item_id, rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::integer as rank from s where score > 0
) where rank <= 50
"""

#: crc32 byte by byte with its table of 256 steps; 3988292384 is the reversed polynomial.
OP13_SQL = rf"""
with recursive step as (
  select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by b) as tab from range(256) r(b)
), r as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]{{6,}}')) as run from documents
), o as (select run, hex(encode(id || ':' || run)) as code, count(*) as n from r group by id, run
), h as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, len(code), 2), lambda i: ('0x' || substr(code, i::int, 2))::bigint)),
    lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]))) as h
  from o, step
), w as (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then substr(run, 1, (h % len(run))::int) || substr(run, (h % len(run))::int + 2) else run end as word, n from h
  ) where len(word) >= 6 group by word having sum(n) >= 5
), l as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as less from (select *, unnest(range(len(word))) as i from w)
), p as (
  select distinct a, b from (
    select x.word as a, y.word as b from l x join l y on x.less = y.less and x.i = y.i and x.word <> y.word
    union all select l.word, w.word from l join w on l.less = w.word
    union all select w.word, l.word from l join w on l.less = w.word
  )
), e as (
  select a, count(*)::bigint as n_near, (list(b order by w.n desc, b))[1] as best, max(w.n)::bigint as best_n from p join w on p.b = w.word group by a
), f as (
  select w.word, case when best_n >= 5 * n then best end as form, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * n then best_n end as form_n
  from w left join e on w.word = e.a
), g as (
  select word, word as spot, 0 as depth from f
  union all select g.word, f.form, depth + 1 from g join f on g.spot = f.word where f.form is not null
)
select f.word, f.form, root, n, n_near, form_n from f join (select word, arg_max(spot, depth) as root from g group by word) using (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_topk": OP4_SQL, "op7_token_counts": OP7_SQL, "op10_mixing": OP10_SQL, "op12_lexical": OP12_SQL, "op13_spelling": OP13_SQL}

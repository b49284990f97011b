"""Phrases of several words and replaced habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import recordings, words
from ..functions.scalars import word_key
from ..operators import phrases as H
from ..operators import speech as P
from ..registry import query
from ..sources.shared import written
from .speech_queries import KEY, W

#: The most frequent words and pairs stand for phrases, as the test texts are invented.
PHRASES_CTE = f"""
kw as (select source_id, idx, {KEY} as key, lead({KEY}) over (partition by source_id order by idx) as k2, lead({KEY}, 2) over (partition by source_id order by idx) as k3 from words),
ones as (select key as phrase, row_number() over (order by count(*) desc, key) as r from kw where key <> '' group by key),
twos as (select key || ' ' || k2 as phrase, row_number() over (order by count(*) desc, key || ' ' || k2) as r from kw where key <> '' and k2 <> '' group by key, k2),
phrases as (
  select phrase, case when r % 2 = 0 then 'from' else 'with' end as kind from ones where r between 3 and 12
  union all select phrase, case when r % 2 = 0 then 'with' else 'from' end from twos where r <= 40 union all select phrase, 'alone' from ones where r = 13
)"""


def _phrases(w: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("idx")
    k = w.withColumn("key", word_key(F.col("word"))).withColumn("k2", F.lead("key").over(order))
    ones = k.where("key <> ''").groupBy(F.col("key").alias("phrase")).count().orderBy(F.desc("count"), "phrase").limit(13)
    twos = k.where("key <> '' and k2 <> ''").groupBy(F.concat_ws(" ", "key", "k2").alias("phrase")).count().orderBy(F.desc("count"), "phrase").limit(40)
    r = F.row_number().over(Window.orderBy(F.desc("count"), "phrase"))  # 13 and 40 rows
    one, two = written(ones.withColumn("r", r), "phrases"), written(twos.withColumn("r", r), "phrases")
    return (
        one.where("r between 3 and 12").select("phrase", F.when(F.col("r") % 2 == 0, "from").otherwise("with").alias("kind"))
        .unionByName(two.select("phrase", F.when(F.col("r") % 2 == 0, "with").otherwise("from").alias("kind")))
        .unionByName(one.where("r = 13").select("phrase", F.lit("alone").alias("kind")))
    )


@query(W + "," + PHRASES_CTE + """ select source_id, idx, kind, max(size)::integer as size from (
  select source_id, idx, kind, 1 as size from kw join phrases on phrase = key union all select source_id, idx, kind, 2 from kw join phrases on phrase = key || ' ' || k2 where k2 is not null) group by all""")
def match_phrases(spark, sf_dir):
    w = written(words(spark, sf_dir), "words")
    return H.match_phrases(w, _phrases(w))


@query()
def replacements(spark, sf_dir):
    w = written(words(spark, sf_dir), "words")
    return H.replacements(w, P.sentences(w), recordings(w), _phrases(w))

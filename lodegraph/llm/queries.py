"""The thin registered queries over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import byte_bpe, decontaminate, jaccard_join, langid, pitman_yor, quality, sharding, surrogates, token_counts, topk
from lodegraph.llm.common import documents, remainder, ship


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
    scored = quality.score_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("__quality").alias("score"),
        (F.col("__quality") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score_texts(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = topk.integer_terms(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) w
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id vec_id,
         coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])), 0)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, rank::int rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s
) where rank <= 20
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, remainder("doc_id", 5) != 0)
    return langid.predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Key of the registered queries; a deployment passes its own secret.
SURROGATE_KEY = b"lodegraph registered query"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    replaced = surrogates.replace(docs, SURROGATE_KEY)
    return replaced.select("doc_id", F.col("__n_mentions").alias("n_mentions"), "text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), percent=80, shingle=5)


OP9_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents
), s as (
  select distinct doc_id, w[p + 1 : p + least(5, len(w))] g from d, unnest(range(0, len(w) - least(5, len(w)) + 1)) t(p) where len(w) > 0
), n as (
  select doc_id, count(*) n from s group by doc_id
), e as (
  select a.doc_id x, b.doc_id y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r as (
  select x, y from e union select r.x, e.y from r join e on r.y = e.x
)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) component_id
from d left join n on n.doc_id = d.doc_id left join r on r.x = d.doc_id group by d.doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80, shingle=5)
    return found.select("doc_id", "item_id", "window_start", "n_shared", "similarity")


OP10_SQL = r"""
with i as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark where text is not null
), d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents where text is not null
), ig as (
  select item_id, len(w) n, least(5, len(w)) k, w[p + 1 : p + least(5, len(w))] g, count(*) c
  from i, unnest(range(0, len(w) - least(5, len(w)) + 1)) t(p) where len(w) > 0 group by all
), dg as (
  select doc_id, len(w) l, k, p, w[p + 1 : p + k] g
  from d, (select distinct k from ig), unnest(range(0, len(w) - k + 1)) t(p)
), hit as (
  select doc_id, l, item_id, n, ig.k, p, g, c from dg join ig using (k, g)
), win as (
  select distinct doc_id, item_id, n, k, l, greatest(0, least(p, l - n)) s from hit
), got as (
  select win.doc_id, win.item_id, win.s, win.n, win.k, win.l, h.g, least(count(*), any_value(h.c)) m
  from win join hit h on win.doc_id = h.doc_id and win.item_id = h.item_id and h.p between win.s and win.s + win.n - win.k
  group by all
), sim as (
  select doc_id, item_id, s, sum(m) m, (n - k + 1) + least(n - k + 1, l - s - k + 1) - sum(m) u
  from got group by doc_id, item_id, s, n, k, l
)
select doc_id, item_id, arg_max(s, (m / u, -s))::int window_start, arg_max(m, (m / u, -s))::int n_shared, max(m / u) similarity
from sim where 100 * m >= 80 * u group by doc_id, item_id
"""


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_pitman_yor": op2_pitman_yor, "op3_topk": op3_topk, "op4_token_counts": op4_token_counts, "op5_byte_bpe": op5_byte_bpe, "op6_sharding": op6_sharding, "op7_langid": op7_langid, "op8_surrogates": op8_surrogates, "op9_jaccard_join": op9_jaccard_join, "op10_decontaminate": op10_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op9_jaccard_join": OP9_SQL, "op10_decontaminate": OP10_SQL}

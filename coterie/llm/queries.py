"""Registered queries: the given tables mapped to each operator's interface, and its results back."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm import (
    divergence, exchanges, histories, languages, licences, mainpage, near, neighbours, packing, prefix_tokens, quality, recipes,
    transducer)
from coterie.sources.scratch import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.col("text").alias("narrative"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a null id is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_exchange_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "archive")
    exchanges.write_archive(pages.select(
        F.col("page_id").alias("order_id"), F.col("url").alias("endpoint"), F.col("html").alias("response_body")), path)
    captures = exchanges.assemble_captures(exchanges.read_records(spark, path))
    return captures.select(
        F.col("order_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def language_model(documents: DataFrame) -> languages.LanguageModel | None:
    return languages.fit_languages(documents.where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("narrative"), F.col("lang").alias("language")))


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(_documents(spark, sf_dir))
    out = languages.identify_languages(_narratives(spark, sf_dir), model)
    return out.select(F.col("case_id").alias("doc_id"), held_out(F.col("case_id")).alias("held_out"), F.col("language").alias("lang_pred"), "score")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_narratives(
        _narratives(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("case_id", "doc_id")


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(_narratives(spark, sf_dir)).withColumnRenamed("case_id", "doc_id")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return licences.find_licences(documents, licences.fit_licences(documents))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return mainpage.extract_pages(pages, mainpage.fit_blocks(pages)).withColumn("n_chars", F.length("text").cast("long"))


def quality_model(spark: SparkSession, sf_dir: str, documents: DataFrame) -> quality.AdditiveModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("good"))
    return quality.fit_quality(documents.select("doc_id", F.col("text").alias("narrative")).join(labels, "doc_id")
                               .select(F.col("doc_id").alias("case_id"), "narrative", "good"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_model(spark, sf_dir, _documents(spark, sf_dir))
    scored = quality.score_quality(_narratives(spark, sf_dir), model)
    return scored.select(F.col("case_id").alias("doc_id"), held_out(F.col("case_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.floor(256 * v.cast("double")).cast("double")))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("order_id"), x.alias("features"))
    out = neighbours.nearest_orders(vectors, vectors.where("order_id % 50 = 0"), 5)
    return out.select("query_id", "rank", F.col("order_id").alias("vec_id"), F.col("score").cast("long").alias("score"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encoding_digests(
        _narratives(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ).withColumnRenamed("case_id", "doc_id")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_narratives(spark, sf_dir), words=3, percent=85).withColumnRenamed("case_id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.category_divergence(_documents(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("narrative"), F.col("lang").alias("language"), F.col("source").alias("merchant_category")))
    return out.withColumnsRenamed({"language": "lang", "merchant_category": "source"})


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_digests(
        _narratives(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("case_id", "doc_id")


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's conversations as steps: up to three first turns of the conversation at the group's head, then the own later ones."""
    turns = histories.number_steps(conversations.select(
        F.col("conv_id").alias("case_id"), "turn", histories.step_digest(F.col("role"), F.col("text")).alias("step"),
        histories.step_words(F.col("text")).alias("words")), ["turn", "step"])
    borrowed = (F.crc32(F.col("case_id").cast("string").cast("binary")) % 4).alias("borrowed")
    cases = turns.where("position = 1").select("case_id", (F.col("case_id") - F.col("case_id") % 20).alias("head"), borrowed)
    firsts = turns.where("case_id % 20 = 0 and position <= 3").select(F.col("case_id").alias("head"), "position", "step", "words")
    heads = cases.join(firsts, "head").where("position <= borrowed").select("case_id", "position", "step", "words")
    own = turns.withColumn("borrowed", borrowed).where("position > borrowed")
    # what a short or missing head lacks moves the own turns forward
    short = cases.join(firsts.groupBy("head").agg(F.count("*").alias("size")), "head", "left").select(
        "case_id", "borrowed", (F.col("borrowed") - F.coalesce("size", F.lit(0))).alias("lack")).where("lack > 0")
    moved = own.join(short.select("case_id", "lack"), "case_id", "left").select(
        "case_id", (F.col("position") - F.coalesce("lack", F.lit(0))).alias("position"), "step", "words")
    nothing = short.where("lack = borrowed").join(own.where("position = borrowed + 1"), "case_id", "left_anti").select(
        "case_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("step"), F.lit(0).cast("long").alias("words"))
    return heads.unionByName(moved).unionByName(nothing)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = histories.history_trie(rebuilt_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie.withColumnsRenamed({"case_id": "conv_id", "parent_case_id": "parent_conv_id", "n_cases": "n_convs"})


QUERIES = {f.__name__: f for f in (
    op1_exchange_archive, op2_languages, op3_pattern_packing, op4_exact_duplicates, op5_licences, op6_main_text, op7_quality, op8_nearest_vectors, op9_byte_bpe,
    op10_near_duplicates, op11_source_divergence, op12_prefix_bpe, op13_conversation_trie)}

_EMPTY = "coalesce(html, '')"
_SHA1_32 = "translate(upper(" + " || ".join(
    f"to_base(('0x' || substr(sha1({_EMPTY}), {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8)
) + "), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

_SHARES = "1 + (1000000000 * (coalesce({n}, 0) + 1)::hugeint) // ({size} + v)::hugeint"

_STEP = "sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))"

#: CRC-32 by bytes, in SQL: a table of 256 remainders, then one step a digit of the decimal id (all digits are ASCII).
_CRC = """
    crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) as t
                  from range(256) r(i)),
    ids as (select distinct conv_id from conversations where conv_id is not null),
    borrowed as (select conv_id, conv_id - conv_id % 20 as head,
                        xor(list_reduce(list_prepend(4294967295, [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]),
                                        lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)])), 4294967295) % 4 as h
                 from ids, crc_table)"""

ORACLES = {
    "op11_source_divergence": f"""
        with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as r from documents),
             w as (select lang, source, r, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as word from d),
             kept as (select lang, word from w group by all having count(distinct r) >= 3),
             n as (select lang, source, word, count(*) as n from w semi join kept using (lang, word) group by all),
             g as (select lang, source, coalesce(size, 0) as size, coalesce(v, 0) as v, coalesce(all_size, 0) as all_size
                   from (select distinct lang, source from d)
                   left join (select lang, source, sum(n) as size from n group by all) using (lang, source)
                   left join (select lang, count(distinct word) as v, sum(n) as all_size from n group by all) using (lang)),
             p as (select g.lang, g.source, k.word, {_SHARES.format(n="n.n", size="g.size")} as p, n.n as n
                   from g join kept k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.word = k.word),
             q as (select lang, word, {_SHARES.format(n="s", size="all_size")} as q
                   from (select lang, word, sum(n) as s from n group by all) join (select distinct lang, v, all_size from g) using (lang)),
             pair as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
                      from g a join g b on a.lang = b.lang and a.source <> b.source
                      left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.word = x.word
                      where x.word is null or y.word is not null group by all),
             term as (select lang, source, word as item, (p - q) * (p - q) // q as value from p join q using (lang, word) where n > 0 and p > q),
             r as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term),
             ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r)
        select lang, source, part, item, cast(value as bigint) as value, rank from ranked where part = 'pair' or rank <= 200""",
    "op13_conversation_trie": f"""
        with {_CRC},
             turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, {_STEP}) as pos,
                              coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
             rebuilt as (select b.conv_id, 0 as own, t.pos, t.role, t.text from borrowed b join turns t on t.conv_id = b.head and t.pos <= h
                         union all select b.conv_id, 1, t.pos, t.role, t.text from borrowed b join turns t on t.conv_id = b.conv_id and t.pos > h),
             steps as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, text,
                              {_STEP} as step from rebuilt),
             paths as (select conv_id, depth, text, string_agg(step, '/') over (partition by conv_id order by depth) as key from steps
                       union all select conv_id, 0, '', '' from ids),
             lasts as (select conv_id, max(depth) as depth, max_by(key, depth) as key from paths group by all),
             nodes as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs,
                              (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) as saved,
                              case when depth = 0 then null when depth = 1 then '' else left(key, length(key) - 65) end as up from paths group by all),
             kids as (select up as key, depth - 1 as depth, count(*) as n_children from nodes where up is not null group by all),
             full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (key, depth)),
             sums as (select x.depth, x.key, sum(case when y.n_children = 0 then 1 else 0 end) as n_leaves, sum(y.saved) as saved_tokens
                      from full_nodes x join full_nodes y on y.depth >= x.depth and (x.depth = 0 or left(y.key, 65 * x.depth - 1) = x.key) group by all),
             ended as (select depth, key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from lasts group by all)
        select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves,
               cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
        from full_nodes f join sums using (depth, key) left join ended e using (depth, key)
        left join full_nodes p on p.depth = f.depth - 1 and p.key = f.up""",
    "op1_exchange_archive": f"""
        with p as (select page_id, octet_length(encode({_EMPTY})) as payload_bytes, {_SHA1_32} as payload_digest,
                          min(page_id) over (partition by {_EMPTY}) as first_id from pages)
        select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id <> first_id then first_id end as refers_to from p""",
    "op8_nearest_vectors": """
        with v as (select vec_id, [cast(floor(256 * x::double) as bigint) for x in embedding] as q from embeddings
                   where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
             s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score
                   from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
             r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op4_exact_duplicates": """
        with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as n from documents),
             r as (select doc_id, n, first_value(doc_id) over (partition by n order by length(text) desc, doc_id
                          rows between unbounded preceding and unbounded following) as keep_id, count(*) over (partition by n) as group_size from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from r""",
}

"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns: others, whatever their names, play no part."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file: GRADELOOM_TOKENIZERS, or the installed package."""
    if top := os.environ.get("GRADELOOM_TOKENIZERS"):
        return os.path.join(top, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.mixing import SEED, mix
    from gradeloom.llm.shared import n_words

    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_key"))
    return mix(sized, counted=True).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.jaccard import similar

    found, _ = similar(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.language import held_out, identify

    labelled = table(spark, sf_dir, "documents", "text", "lang", "doc_id").where(~held_out(F.col("doc_id"))).select("text", "lang")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, labelled).select("doc_id", "held_out", "lang_pred", "score")


#: Shards and their weights; the grown tree has one more.
SHARDS = [1.0] * 40


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.sharding import shard

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return shard(docs, SHARDS, [*SHARDS, 1.0]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.warc import archive, keys_of, look_up

    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    directory, _ = archive(pages)
    read = look_up(spark, directory, keys_of(pages))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.token_files import token_table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_table(docs, tokenizer("word_bpe_49k.json"), digest=True)


#: A conversation whose texts are control strings of a template.
CONFLICT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.chat import chat_digests

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat_digests(turns.union(spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.fingerprints import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.html_text import extract

    found = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


#: Rows that arrived before it are laid out first; shares of the table that files hold.
FIRST_UNTIL, SHARES = "2024-04-01 00:00:00", 800


def moment(ts: Column, click_id: Column) -> Column:
    """When a click counts as made: some are old, some are known by their week only."""
    k, ts = F.crc32(click_id.cast("string").cast("binary")) % 128, ts.cast("timestamp_ntz")
    monday = F.date_sub(ts.cast("date"), F.weekday(ts)).cast("timestamp_ntz")
    days = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    return F.when(k < 16, ts - F.make_dt_interval(days)).when(k > 111, monday).otherwise(ts)


def op12_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.time_parts import rewrite

    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    limit = 1 + clicks.count() // SHARES
    first = F.col("arrived_at") < F.lit(FIRST_UNTIL).cast("timestamp_ntz")
    return rewrite(clicks, moment(F.col("ts"), F.col("click_id")), ["arrived_at", "click_id"], limit, first, "click_id")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.llm.lexical import index, search

    return search(index(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


SQL = {
    "op3_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS g
            FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 85 * (m.n + o.n - c)),
        r(doc_id, reach) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
                   CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
            FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM g""",
    "op9_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, regexp_replace(text, '(<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*\|startoftext\|>|<\\*s>|<\\*/s>|<\\*unk>|<\\*pad>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>)', '?\1', 'g') AS shown
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>') + length(role) + 1 + length(shown) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS uid,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents WHERE text IS NOT NULL),
        l AS (SELECT uid, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
        q AS (
            SELECT item_id, t, count(*) AS r
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
            GROUP BY ALL),
        p AS (SELECT uid, t, count(*) AS tf FROM (SELECT uid, unnest(ts) AS t FROM l) GROUP BY ALL),
        w AS (
            SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
        s AS (
            SELECT item_id, uid, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
            FROM q JOIN p USING (t) JOIN w USING (t) JOIN l USING (uid), c GROUP BY ALL),
        o AS (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM s JOIN l USING (uid) WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

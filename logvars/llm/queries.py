"""The registered queries of these operators: (spark, sf_dir) -> DataFrame, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, langid, quality
from .common import fold
from .decontaminate import find_contamination
from .hmm import language_model_scores
from .lexical import search
from .minhash import near_duplicates
from .packing import pack
from .sharding import shard
from .token_files import read_token_files, write_token_files
from .warc import number_column, read_archives, write_archives
from .whitening import whiten
from .winnow import edited_likeness


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes by a K-d tree."""
    found = shard(table(spark, sf_dir, "documents"), shards=40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting-stock packing of all documents into sequences of 1024 ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte_level", end_id=0)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    scored = quality.rate(docs, quality.learn(docs, labels), out="score")
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", predicted)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of ten benchmark words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    items = F.col("contamination.items")
    named = F.concat_ws(",", F.array_sort(items.cast("array<string>")))
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts."""
    found = edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written and read back."""
    records = read_archives(spark, write_archives(table(spark, sf_dir, "pages")))
    return records.select(
        number_column("record_id").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        number_column("refers_to").alias("refers_to"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the dictionaries of rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id")) == 0
    languages = langid.learn(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), languages)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to Arrow files and read back."""
    index = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "words", end_id=2)
    return read_token_files(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree by 85 per cent or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, rows=10)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov log probabilities of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model_scores(docs, fold(F.col("doc_id")) == 1)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of a byte-level BPE, and the ids as bytes again."""
    import public_tokenizers

    how = {"path": tokenizer_path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.decode(byte_bpe.encode(docs, **how).drop("text"), **how)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_token_files": op8_token_files,
    "op9_minhash": op9_minhash,
    "op10_language_model": op10_language_model,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

# Windows of ten words (or whole shorter items) by position, joined on their words.
DECONTAMINATION_SQL = r"""
with recursive
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as window_text
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from item_words where len(w) > 0)),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
doc_windows as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as window_text
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p
        from doc_words, (select distinct n from item_windows) where len(w) >= n)),
hits as (select distinct doc_id, item_id, p, n from doc_windows join item_windows using (n, window_text)),
covered as (select doc_id, count(distinct q) as n_hit
            from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from hits)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
          from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join covered using (doc_id) left join found using (doc_id)
"""
# Base32 of a SHA-1, four characters for each five hexadecimal digits.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as f from p),
v as (select *, [cast('0x' || h[5 * g + 1:5 * g + 5] as integer) for g in range(0, 8)] as five from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((five[i // 4 + 1] >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1]
                        for i in range(0, 32)], '')
         as payload_digest,
       case when f = page_id then 'response' else 'revisit' end as record_type,
       case when f = page_id then null else f end as refers_to
from v
"""
# All pairs that share a shingle, then everything that can be reached.
NEAR_DUPLICATE_SQL = r"""
with recursive
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, s
  from (select doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 3, 2))]) as s from doc_words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a as s, b as d from links union all select b, a from links),
reached as (select doc_id as id, doc_id as r from documents union select id, d from reached join both_ways on r = s)
select id as doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id, id = min(r) as kept
from reached left join sizes on doc_id = id group by id
"""
# All postings of the items' terms, summed by item and document.
LEXICAL_SEARCH_SQL = r"""
with
doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
item_terms as (
  select item_id, term, count(*) as times
  from (select item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark)
  group by item_id, term),
lengths as (select doc_id, count(*) as n from doc_terms group by doc_id),
totals as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
measures as (select doc_id, 100 - 25 + ((25 * n * docs) // terms) as m from lengths, totals),
tf as (select doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by term),
scores as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from item_terms join tf using (term) join weights using (term) join measures using (doc_id) group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scores where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked where r <= 20
"""
ORACLE_SQL: dict[str, str] = {
    "op9_minhash": NEAR_DUPLICATE_SQL,
    "op6_warc": WARC_SQL,
    "op4_decontamination": DECONTAMINATION_SQL,
    "op12_lexical_search": LEXICAL_SEARCH_SQL,
}

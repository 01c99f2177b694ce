"""The operators' queries over the driver's tables, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tactus.llm import ann, fim, mixing, ogg, packing, quality, secrets, sharding, simhash, spelling, tokencount, wavelet, wrappers
from tactus.session import durable

QUERIES: dict = {}
ORACLES: dict = {}

SHARDS = 16
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_sharding(spark, sf_dir):
    """Whole documents are placed; sizes and digests are those of the texts that lie in the shards."""
    placed = sharding.shard_rows(documents(spark, sf_dir), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query()
def op2_secret_scans(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", secrets.secret_spans("text").alias("found"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in kinds),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


@query()
def op3_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    crf = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.select("doc_id", quality.quality("text", crf).alias("q"))
    return judged.select("doc_id", "q.*")


@query()
def op5_mixing(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


@query()
def op6_media_columns(spark, sf_dir):
    """The media are written as a table; everything else comes from what is read back."""
    media = durable(documents(spark, sf_dir).select("doc_id", ogg.media_column("text").alias("media")), "ogg-media", "zstd")
    return media.select("doc_id", ogg.media_features("media").alias("f")).select("doc_id", "f.*")


@query()
def op8_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), BYTE_TOKENIZER)


@query()
def op9_token_counts(spark, sf_dir):
    counted = documents(spark, sf_dir).select("doc_id", tokencount.token_counts("text", PIECE_MODEL).alias("c"))
    return counted.select("doc_id", "c.*")


@query()
def op10_token_ids(spark, sf_dir):
    return wavelet.token_files(documents(spark, sf_dir), WORD_TOKENIZER)


@query()
def op4_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return wrappers.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("""with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as x from documents),
    drawn as (select *, len(u) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from units),
    cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
    parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cuts)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from parts""")
def op13_fill_in_middle(spark, sf_dir):
    formed = documents(spark, sf_dir).select("doc_id", fim.fill_in_middle("text", "doc_id").alias("f"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored("f.output", "f.form")
    return formed.select("doc_id", "f.n", "f.form", "f.prefix_chars", "f.middle_chars", sha(F.col("f.output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


#: Of the query's words: the least code points and occurrences, and one run in how many loses a letter.
WORD_CHARS, WORD_COUNT, LOSSY = 7, 2, 31


@query()
def op12_spelling_variants(spark, sf_dir):
    """Some runs, as a hash of document and run decides, lose a code point before they are words."""
    runs = documents(spark, sf_dir).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.long_runs("text", WORD_CHARS)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    lossy = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % LOSSY == 0, lossy).otherwise(F.col("run")).alias("word"), F.lit(1).cast("long").alias("n"))
    return spelling.variants(words.where(F.length("word") >= WORD_CHARS), least=WORD_COUNT).select("word", "form", "root", "n", "n_near", "form_n")


#: Every how many ids one is a query, and how many neighbours it gets.
ASKED, NEIGHBOURS = 50, 5


@query()
def op11_nearest_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest_neighbours(vectors, "vec_id", "embedding", F.col("vec_id") % ASKED == 0, NEIGHBOURS)

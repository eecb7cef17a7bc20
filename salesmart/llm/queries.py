"""The operators applied to the whole tables of a directory, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, lm_scoring, merkle, ngram_join, packing, quality_classifier, quality_rules, spelling, token_files, toxicity, urls
from .columns import crc_of_id
from .labelled import label_sample


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A conversation that says the marks of the template.
MARKED_ID, MARKED_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    own = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))]))
    marked = spark.range(1).select(roles.alias("t")).select(F.lit(MARKED_ID).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(MARKED_TEXT).alias("text"))
    formatted = chat.format_trees(chat.chains(own.unionByName(marked)))
    turns = chat.read_turns(F.col("formatted"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("tree_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op2_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Labelled outcomes: a page shows the document whose number ends its path."""
    pages = table(spark, directory, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1)
    shown = pages.where(number != "").select("url", number.cast("long").alias("doc_id"))
    labels = table(spark, directory, "labels").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    judged = urls.judge(pages, shown.join(labels, "doc_id").select("url", "good"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    settings = quality_classifier.KnnSettings()
    documents = table(spark, directory, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    sample = label_sample(table(spark, directory, "labels"), "doc_id", "quality", settings.max_labelled, ~held_out)
    fitted = quality_classifier.fit(documents, sample, settings=settings)
    scored = quality_classifier.score(documents, fitted, ["doc_id"], settings=settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    documents, benchmark = table(spark, directory, "documents"), table(spark, directory, "benchmark")
    return decontamination.decontaminate(documents, benchmark, ["doc_id"])


def op5_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, directory, "documents"))


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    settings = toxicity.FmSettings()
    documents = table(spark, directory, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    sample = label_sample(table(spark, directory, "labels"), "doc_id", "toxic", settings.max_labelled, ~held_out)
    model = toxicity.fit(documents, sample, settings=settings)
    scored = toxicity.score(documents, model, ["doc_id"], settings=settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(table(spark, directory, "documents"), tokenizer_path())


def op8_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, directory, "documents"))


def op9_token_files(spark: SparkSession, directory: str) -> DataFrame:
    return token_files.write_and_read(table(spark, directory, "documents"), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 7 == 2
    model = lm_scoring.train(documents.where(~held_out))
    scored = lm_scoring.score(documents, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, directory, "documents"))


def op12_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Every leaf is proved; where 7 divides the crc32 of the id, of a row with one more n_chars."""
    documents = table(spark, directory, "documents")
    tampered = crc_of_id(F.col("doc_id")) % 7 == 0
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = merkle.leaf_digest(list(fields.values()))
    other = merkle.leaf_digest(list((fields | {"n_chars": F.col("n_chars") + 1}).values()))
    rows = documents.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, other).alias("claim"))
    manifest = merkle.build(rows, "lang", "doc_id", "leaf", ["doc_id", "claim"])
    as_hex = lambda c: F.lower(F.hex(c))
    proved = merkle.folded(manifest.proofs(), F.coalesce("claim", as_hex("digest")))
    root = F.lit(manifest.root).cast("string")
    return proved.select(
        "doc_id",
        as_hex("digest").alias("leaf"),
        as_hex("subroot").alias("subroot"),
        root.alias("root"),
        F.sha2(as_hex("path"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def op13_bpe_coding(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    coded = bpe.decode(bpe.encode(documents, tokenizer_path(), ["doc_id"]), tokenizer_path())
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_chat_formatting, op2_url_filter, op3_quality_classifier, op4_decontamination, op5_quality_rules, op6_toxicity, op7_packing, op8_ngram_join, op9_token_files, op10_lm_scoring, op11_spelling_variants, op12_merkle_manifest, op13_bpe_coding]
    return {query.__name__: query for query in own}

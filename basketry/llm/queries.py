"""The registered queries over the documents, pages, labels and benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace, release_shuffles, session_workspace
from . import (
    chosenpath,
    collisions,
    collocations,
    decontaminate,
    fingerprints,
    htmltext,
    linededup,
    mixing,
    quality,
    secrets,
    sketchtables,
    spelling,
    tokenids,
    toxicity,
)
from .labelled import crc_bucket
from .ordering import with_next


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's digests, its edited text's and the next text's, written as a table."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fingerprints.allow_deep_plans(docs)
    own = {"a": fingerprints.digests(F.col("text")), "a_cells": fingerprints.cells(F.col("a"), F.lit(0))}
    pairs = with_next(docs, "doc_id", ["text"], "text", "next_text", own)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    versions = fingerprints.with_sketch(pairs.withColumn("edited", edited), "edited", "b", "b_cells")
    # the next document's were computed in its own row; only the last of a bucket needs its text
    versions = versions.withColumn("c", F.coalesce("next_a", fingerprints.digests(F.col("next_text"))))
    versions = versions.withColumn("c_cells", F.coalesce("next_a_cells", fingerprints.cells(F.col("c"), F.lit(0))))

    def blocks(version: str) -> Column:
        sketches = F.col("a_cells"), F.col(f"{version}_cells")
        return sketchtables.first_blocks(*sketches, F.col("a"), F.col(version)).alias(f"{version}_parts")

    return session_workspace(spark).table(
        versions.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            n.cast("bigint").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "a", "b", "c", blocks("b"), blocks("c"),
        ),
        "op1-digests",
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _text_digests(spark, sf_dir)
    release_shuffles(spark)

    def compared(version: str, number: int) -> Column:
        return F.struct(
            (F.col("row") * 2 + number).alias("pair"), F.col(f"{version}_parts").alias("parts"), "a", F.col(version).alias("b")
        )

    with Workspace(spark) as work:
        both = written.select(F.inline(F.array(compared("b", 0), compared("c", 1))))
        apart = sketchtables.differing(both, work, session_workspace(spark))
    by_row = apart.groupBy(F.shiftright("pair", 1).alias("row")).agg(
        *[F.sum(F.when(F.col("pair") % 2 == i, F.col("apart"))).alias(f"{v}_apart") for i, v in enumerate("bc")]
    )

    def near(version: str) -> Column:
        total = (F.size("a") + F.size(version)).cast("double")
        return (total - F.col(f"{version}_apart")) / (total + F.col(f"{version}_apart"))

    def sketch(version: str) -> Column:
        return fingerprints.fingerprint(fingerprints.cells(F.col(version), F.lit(0)))

    return written.join(by_row, "row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch("a").alias("fingerprint"),
        sketch("b").alias("edited_fingerprint"),
        near("b").alias("near_edited"),
        near("c").alias("near_next"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan_benchmark(docs, _table(spark, sf_dir, "benchmark"))
    return scanned.select("doc_id", F.explode("benchmark_hits").alias("hit")).select("doc_id", "hit.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with Workspace(spark) as work:
        return session_workspace(spark).table(chosenpath.jaccard_join(docs, workspace=work), "op3")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session_workspace(spark).path("op4-tokens")
    tokenids.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_file())
    return tokenids.document_index(spark, path)


def _judged(scored: DataFrame, score: str, held_out: Column, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= threshold).cast("int").alias("predicted"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return _judged(toxicity.score_toxicity(docs, model), "toxicity", held_out, 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 4) == 2
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return _judged(quality.score_quality(docs, model), "quality_score", held_out, 0.7)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.replicate(docs)
    return mixed.select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"), "copy", "shuffle_key")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup_lines(docs)
    return kept.select(
        "doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("n_lines", "n_equal", "n_near")],
        F.md5("text").alias("kept_md5"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan_secrets(docs)
    base = F.filter("secret_spans", lambda s: s["ord"] < len(secrets.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(r.kind) for r in secrets.BASE_RULES],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("secret_spans")).alias("spans"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = htmltext.extract_main_text(pages)
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars")
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    with Workspace(spark) as work:
        return session_workspace(spark).table(collisions.near_vectors(vectors, work), "op11")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with Workspace(spark) as work:
        return session_workspace(spark).table(spelling.spelling_variants(docs, work), "op12")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    with Workspace(spark) as work:
        return session_workspace(spark).table(collocations.collocations(docs, work), "op13")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_decontamination": op2_decontamination,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_token_ids": op4_token_ids,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_main_text": op10_main_text,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_collocations": op13_collocations,
    }

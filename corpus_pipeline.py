"""Corpus preparation: filters, deduplicates, decontaminates, mixes and encodes the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``, further ones included: what a stage doesn't read travels in one column of
its own, so no name of it can clash. A stage decides on its own input alone; its decisions
take effect. Null texts count as empty, null keys as one key; empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.workspace import Workspace, session_workspace
from basketry.llm import chosenpath, decontaminate, mixing, tokenids, toxicity
from basketry.llm.queries import tokenizer_file


_CARRIED = "_carried"


def _slim(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that a stage reads, and all others in one."""
    rest = [c for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)]).alias(_CARRIED))


def _full(rows: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*[F.col(f"`{c}`") if c in read else F.col(_CARRIED)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, by a model fitted on the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    scored = toxicity.score_toxicity(_slim(docs, "doc_id", "text"), model)
    return _full(scored.filter("toxicity < 0.5"), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that copies and links connect.

    Equal rows count as one; a text without words is a copy of any other such text."""
    with Workspace(spark) as work:
        classes = chosenpath.jaccard_join(docs.select("doc_id", "text"), workspace=work)
        first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept"))
        kept = session_workspace(spark).table(first.distinct(), "kept")
    # plain equality on the key, so that one exchange serves the join and the removal of equal rows
    keyed = docs.filter("doc_id is not null").join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    found = keyed.dropDuplicates(["doc_id", "text"])
    if not kept.filter("_kept is null").isEmpty():
        found = found.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    scanned = decontaminate.scan_benchmark(_slim(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _full(scanned.filter(F.size("benchmark_hits") == 0), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    read = ("doc_id", "text", "source")
    return _full(mixing.replicate(_slim(docs, *read)), docs, *read)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as coded blocks of token ids, in the order in which the mixed table is
    read; returns the document index read back from them: doc_id, start, n_tokens, ids_crc32."""
    path = session_workspace(spark).path("corpus-tokens")
    tokenids.write_tokens(docs, path, tokenizer_file(), ordered=False)
    return tokenids.document_index(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", encode_tokens),
]

#: A trained model and a tokenizer decide the rows, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; a stage's input goes once its output is written."""
    work = session_workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        path = work.path(f"stage-{name}")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before is not None:
            work.remove(before)
        before = path
    return docs

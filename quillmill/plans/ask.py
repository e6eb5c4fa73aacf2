"""Questions to answers, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GenerationConfig, RetrievalConfig
from ..functions import answers as A
from ..functions.keywords import with_keywords
from ..operators.retrieve import build_context, retrieve
from ..sources.providers import Embedder, ExtractiveGenerator, Generator, HashingEmbedder, embed, generate
from ..sources.store import ChunkStore


def ask(
    store: ChunkStore, questions: DataFrame, retrieval: RetrievalConfig = RetrievalConfig(), generation: GenerationConfig = GenerationConfig(),  # noqa: B008  both are immutable
    embedder: Embedder | None = None, generator: Generator | None = None,
) -> DataFrame:
    """Answers to ``questions`` (question_id, question, tenant_id).

    Columns: question_id, status (200, 400 for a blank question or tenant, 404
    for an unknown tenant), answer (without its list of sources), sources,
    response (as it is streamed), error, from_cache.
    """
    asked = questions.withColumns({"tenant_id": F.trim(F.coalesce("tenant_id", F.lit(""))), "question": F.coalesce("question", F.lit(""))})
    blank = ~F.col("question").rlike(r"(?U)\S") | (F.col("tenant_id") == "")
    known = store.tenants().withColumn("_known", F.lit(True))
    asked = asked.join(known, "tenant_id", "left").withColumn("status", F.when(blank, 400).when(F.col("_known").isNull(), 404).otherwise(200)).drop("_known")
    good = with_keywords(asked.where("status = 200"), "question", retrieval.max_keywords).withColumn("vector", embed("question", embedder or HashingEmbedder()))
    chunks = retrieve(good, store.chunks(), retrieval)
    # at most ``max_results`` chunks a question
    ranked = chunks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rn", "doc_name", "page", "section_title", "text", "score"))).alias("chunks"))
    full = good.select("question_id", "question").join(ranked, "question_id", "left").withColumn("footer", A.sources_footer("chunks"))
    if generation.mode == "ContextOnly":
        full = full.join(build_context(chunks, retrieval).select("question_id", "context"), "question_id", "left")
        full = full.withColumn("response", A.context_only(F.coalesce("context", F.lit("")), F.col("footer")))
    else:
        full = full.withColumn("body", F.array_join(generate(A.prompt("question", A.prompt_context("chunks")), generator or ExtractiveGenerator()), ""))
        full = full.withColumn("response", F.when(A.lacks_information("body"), F.col("body")).otherwise(F.concat("body", "footer")))
    full = full.withColumn("response", F.when(F.col("chunks").isNull(), F.lit(A.NO_CONTENT)).otherwise(F.col("response")))
    out = asked.select("question_id", "status").join(full.select("question_id", "response"), "question_id", "left")
    error = F.when(F.col("status") == 400, F.lit("Question and TenantId are required.")).when(F.col("status") == 404, F.lit(A.NO_TENANT))
    answer = F.when(F.col("status") == 200, A.clean_answer("response"))
    return out.select("question_id", "status", answer.alias("answer"), A.parse_sources("response").alias("sources"), "response", error.alias("error"), F.lit(False).alias("from_cache"))

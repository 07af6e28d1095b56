"""Whole jobs: each takes and returns tables, with the options its step of the work has."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contexts, evalset, evaluation, keywords, preparation, retrieval, rewriting, validation
from ..plugins import Embedder, Generator, Rewriter
from ..session import kept


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval and serving; 0 or None mean the default."""

    top_k: int = 5
    threshold: float | None = retrieval.DEFAULT_THRESHOLD
    max_chars: int = contexts.MAX_CHARS
    debug: bool = True
    #: One generation at a time, for a model that can't be shared; of generators that can take turns.
    serial: bool = False


def prepare(items: DataFrame, index: DataFrame, *, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(question records, knowledge documents) from raw items and the nested index of their files."""
    files = preparation.split_files(preparation.index_files(index), seed=seed)
    symbols = preparation.distinct_symbolism(F.transform("questions", lambda q: preparation.symbolism(q["additional_context"]["symbolism"])))
    known = preparation.join_items(files, items).withColumns({
        "caption": preparation.caption(F.col("image_analysis.overall_description"), F.col("image_analysis.main_objects"), F.col("image_analysis.visual_details.composition")),
        "knowledge": preparation.knowledge(F.col("cultural_context.historical_context"), symbols, F.col("cultural_context.regional_significance")),
    })
    return preparation.question_records(known), preparation.knowledge_documents(known)


def build_standalone_questions(records: DataFrame, *, existing: DataFrame | None = None, cache: DataFrame | None = None, rewriter: Rewriter | None = None) -> tuple[DataFrame, DataFrame]:
    """(rewritten records, records still pending): rules, then earlier output, then cache, then the model."""
    done = rewriting.apply_rules(validation.require_valid_ids(records))
    if existing is not None:
        done = rewriting.restore_existing(done, existing)
    left = rewriting.pending(done)
    if cache is not None:
        done, left = rewriting.apply_cache(done, cache)
    if rewriter is not None:
        done = rewriting.apply_model(done, left, rewriter)
        left = done.where("rewrite_method = 'failed'")
    return done, left


def validate_knowledge_base(raw: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid documents, issues, statistics) of rows of JSON text."""
    checked = validation.check_documents(validation.parse_documents(raw), strict=strict)
    return validation.valid_documents(checked), validation.issue_table(checked), validation.validation_stats(checked)


def embedded_documents(valid: DataFrame, embedder: Embedder) -> DataFrame:
    """The valid documents as rows of an index."""
    flat = valid.select("row_index", "schema_version", "doc_id", "content", "metadata.*")
    return embedder.embed(preparation.embedding_documents(flat), "text")


def build_vector_index(valid: DataFrame, embedder: Embedder, *, index: DataFrame | None = None, recreate: bool = False) -> DataFrame:
    """The index with the valid documents in it, embedded; an error if it then lacks any."""
    new = embedded_documents(valid, embedder)
    out = new if index is None or recreate else retrieval.upsert(index, new, order="row_index")
    validation.require_counts(out.select("doc_id").count(), valid.select("doc_id").distinct().count(), "the index")
    return out


def clean_keywords(df: DataFrame, mapping: DataFrame, *, mode: str) -> DataFrame:
    """mode: processed (question records) or knowledge (documents)."""
    keys = keywords.key_table(mapping)
    if mode not in ("processed", "knowledge"):
        raise ValueError("mode must be processed or knowledge")
    return keywords.clean_records(df, keys) if mode == "processed" else keywords.clean_documents(df, keys)


def build_eval_queries(splits: dict[str, DataFrame], documents: DataFrame, *, max_per_split: int | None = None, max_per_category: int | None = None, seed: int = 42) -> DataFrame:
    """Eval queries of all splits, each sampled with its own seed; split after split, ordered by id within each."""
    out = None
    for i, (name, rows) in enumerate(splits.items()):
        kept = evalset.deduplicate(evalset.covered(evalset.build_records(rows, name), documents))
        chosen = evalset.sample(kept, max_per_split=max_per_split, max_per_category=max_per_category, seed=seed + i)
        out = chosen if out is None else out.unionByName(chosen)
    if out is None:
        raise ValueError("no splits are given")
    return out.orderBy(F.array_position(F.array(*map(F.lit, splits)), F.col("source_split")), "id")


def search_texts(requests: DataFrame, index: DataFrame, embedder: Embedder, *, k: int, threshold: float | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits with the index's columns for requests (query_id, query and the filter columns); blank queries find nothing.

    Embedded requests are kept in a scratch folder, as the search looks at them more than once and a model should not.
    """
    asked = kept(embedder.embed(requests.where(F.col("query") != ""), "query"))
    return retrieval.with_documents(retrieval.search(asked, index, k=k, threshold=threshold, by=by), index)


def evaluate_retrieval(queries: DataFrame, index: DataFrame, embedder: Embedder, *, k: int = 5, threshold: float | None = retrieval.DEFAULT_THRESHOLD, use_category_filter: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results per query, summary)."""
    known = evaluation.require_expectations(queries)
    asked = known.select(F.col("id").alias("query_id"), F.col("retrieval_query").alias("query"), (F.col("expected_category") if use_category_filter else F.lit("")).alias("category"))
    hits = search_texts(asked, index, embedder, k=k, threshold=threshold, by=("category",)).withColumnRenamed("query_id", "id")
    results = evaluation.evaluate(known, hits, k=k)
    return results, evaluation.summarize(results, k=k)


def search_contents(requests: DataFrame, index: DataFrame, embedder: Embedder, *, k: int, threshold: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, rank, content: what ``search_texts`` finds, contents only."""
    return search_texts(requests, index, embedder, k=k, threshold=threshold, by=by).select("query_id", "rank", "content")


def _prepared(requests: DataFrame, index: DataFrame, embedder: Embedder, settings: Settings) -> DataFrame:
    """query_id, query, context_block, prompt, contexts and filters of requests."""
    asked = requests.select("query_id", T.first_text("normalized_question", "question").alias("query"), T.clean_optional("category").alias("category"), T.clean_optional("keyword").alias("keyword"))
    hits = kept(search_texts(asked, index, embedder, k=settings.top_k, threshold=settings.threshold, by=("category", "keyword")))
    filters = asked.select("query_id", F.struct("category", "keyword").alias("filters"))
    prompts = contexts.prepare_prompts(requests, hits, max_chars=settings.max_chars).join(filters, "query_id")
    return prompts.join(contexts.context_list(asked, hits), "query_id") if settings.debug else prompts


def _generated(prompts: DataFrame, generator: Generator, settings: Settings) -> DataFrame:
    in_turn = getattr(generator, "in_turn", None) if settings.serial else None
    answered = (in_turn() if in_turn else generator).generate(prompts)
    answered = answered.withColumn("answer", T.postprocess_answer("answer")).withColumnRenamed("query", "retrieval_query")
    return answered if settings.debug else answered.drop("context_block", "prompt")


def answer(requests: DataFrame, index: DataFrame, embedder: Embedder, generator: Generator, settings: Settings = Settings()) -> DataFrame:
    """One row per request (query_id, question, normalized_question, category, keyword): retrieval_query, filters, answer and, if debugging, context, prompt and the list of contexts.

    A category or keyword that is given always filters.
    """
    return _generated(_prepared(requests, index, embedder, settings), generator, settings)


def answer_with_timing(requests: DataFrame, index: DataFrame, embedder: Embedder, generator: Generator, settings: Settings = Settings()) -> DataFrame:
    """As ``answer``, with ``timing``: the seconds that these requests together took to prepare, to generate and in all.

    Each part is run to its end and kept, so that the next doesn't count it again; a lost executor's share is made again.
    """
    start = time.perf_counter()
    prompts = _prepared(requests, index, embedder, settings).persist()
    prompts.count()
    ready = time.perf_counter()
    answered = _generated(prompts, generator, settings).persist()
    answered.count()
    done = time.perf_counter()
    prompts.unpersist()
    took = {"rag_seconds": ready - start, "generation_seconds": done - ready, "total_seconds": done - start}
    return answered.withColumn("timing", F.struct(*(F.lit(v).alias(k) for k, v in took.items())))


def top_contexts(records: DataFrame, index: DataFrame, embedder: Embedder, *, use_category_filter: bool = True, use_keyword_filter: bool = False, threshold: float | None = None) -> DataFrame:
    """Records with ``retrieve_context``: the content of the nearest document to their question, or blank."""
    by = ("category",) * use_category_filter + ("keyword",) * use_keyword_filter
    asked = records.select("query_id", T.first_text("standalone_question", "question").alias("query"), "category", "keyword")
    return contexts.top_context_column(records, search_texts(asked, index, embedder, k=1, threshold=threshold, by=by))

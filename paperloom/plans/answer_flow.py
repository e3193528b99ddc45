"""Answers for tables of questions and of chat turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions import prompt_texts
from paperloom.operators import conversations, generation, prompting, retrieval, tasks
from paperloom.operators.embedding import Embedder, HashedEmbedder, embed


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    make_model: Callable[[], generation.Model] = generation.extractive_model,
    k: int = fixed.TOP_K,
    embedder: Embedder | None = None,
    min_score: float | None = None,
    template: str = prompt_texts.RAG_PROMPT,
) -> DataFrame:
    """Every row of ``questions`` with ``response``, ``status`` and ``error``.

    The first column holds the question. A question that occurs more than once is
    answered once. ``chunks`` have their vectors in ``embedding``, made by the same
    embedder, or only ``chunk_text``, which is then embedded on the way.
    """
    text = F.coalesce(F.col(questions.columns[0]).cast("string"), F.lit(""))
    asked = questions.select(text.alias("query")).distinct()
    numbered = asked.select(F.sha2("query", 256).alias("query_id"), "query")
    embedder = embedder or HashedEmbedder()
    stored = "embedding" in chunks.columns
    ranked = retrieval.top_k_chunks(
        embed(numbered, "query", embedder),
        chunks,
        k,
        min_score,
        embedder=None if stored else embedder,
    )
    texts = retrieval.with_chunk_text(ranked, chunks)
    prompts = prompting.rag_prompts(retrieval.contexts(numbered, texts), template)
    answers = generation.generate(prompts, make_model).select(
        F.col("query").alias("_query"), "response", "status", "error"
    )
    return (
        questions.withColumn("_asked", text)
        .join(answers, F.col("_asked") == F.col("_query"))
        .drop("_asked", "_query")
    )


def answer_turns(
    turns: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    make_model: Callable[[], generation.Model],
    registry: DataFrame,
    cap: int = fixed.MESSAGE_CAP,
    embedder: Embedder | None = None,
    sources: DataFrame | None = None,
    with_agents: bool = True,
) -> DataFrame:
    """Answer every user turn that its conversation takes in.

    The model sees the system prompt in force, the conversation's documents
    (``conv_id, position, text``), the answered questions before the turn, and the
    turn. Turns that name a task go through that task instead, on the documents;
    the language to translate into is the one the turn names. ``sources`` and
    ``with_agents`` are those of :func:`tasks.call_agents`. Returns ``conv_id,
    turn, steps, response, status, error``; see :func:`assistant_turns` for the
    answers as turns.
    """
    contexts = conversations.documents_context(documents)
    called = prompting.agent_messages(
        conversations.paired_history(conversations.admitted_turns(turns, cap)),
        contexts,
        template=prompting.templates_in_force(registry)["orchestrator_agent_prompt"],
    ).join(contexts.select("conv_id", F.col("numbered").alias("documents")), "conv_id", "left")
    requests = called.select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"),
        "conv_id",
        "turn",
        F.col("text").alias("query"),
        tasks.named_language(F.col("text")).alias("target_language"),
        "messages",
        "has_documents",
        "documents",
    )
    answered = tasks.call_agents(
        requests,
        chunks,
        make_model,
        registry,
        embedder,
        F.col("has_documents"),
        sources=sources,
        with_agents=with_agents,
    )
    return answered.select("conv_id", "turn", "steps", "response", "status", "error")


def assistant_turns(answered: DataFrame) -> DataFrame:
    """Answers of :func:`answer_turns` as turns (``conv_id, turn, role, text``), each after
    the user turn it answers. A conversation ends with its first failed answer."""
    turns = answered.select(
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.lit("assistant").alias("role"),
        F.col("response").alias("text"),
        (F.col("status") == "error").alias("_failed"),
    )
    return conversations.closed_conversations(turns, F.col("_failed")).drop("_failed")

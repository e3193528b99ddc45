"""Requests that name a task: retrieve, summarise, translate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions import prompt_texts
from paperloom.operators import chunking, generation, prompting, retrieval
from paperloom.operators.embedding import Embedder, HashedEmbedder, embed_packed, words_of

# Words that tell what a request asks for: a rule in place of a model's choice.
STEP_PATTERNS = {
    "retrieve": r"\b(find|search|look up|retrieve|documents? about)\b",
    "summarize": r"\b(summari[sz]e|summary|shorten|tl;dr)",
    "translate": r"\b(translate|translation|translated)\b",
}
# Sentences kept in a summary, and in that of a text of more than so many sentences.
SUMMARY_SENTENCES = 5
COMPLEX_SENTENCES = 50
COMPLEX_SUMMARY_SENTENCES = 8
# Requests of one task while models are asked: their prompts hold whole documents, and
# each step's Python worker has a batch of them.
REQUESTS_PER_TASK = 500
# The agent whose system prompt goes with a task.
AGENTS = {
    "retrieve_document": "document_retrieval_agent_prompt",
    "summarize_text": "summarization_agent_prompt",
    "translate_text": "translation_agent_prompt",
}


def route_requests(
    requests: DataFrame, text: str = "text", has_documents: Column | None = None
) -> DataFrame:
    """One row per step of a request: ``step_no`` (from 1) and ``step``.

    Steps come in the order retrieve, summarize, translate. Requests that bring
    their documents retrieve nothing. A request without a step is answered.
    """
    steps = request_steps(F.col(text), has_documents)
    return requests.select(
        *requests.columns, F.posexplode(steps).alias("_at", "step")
    ).select(*requests.columns, (F.col("_at") + 1).alias("step_no"), "step")


def named_language(text: Column) -> Column:
    """The language that a request wants its text in, null if it names none: the word
    with a capital letter after "to", "into" or "in"."""
    found = F.regexp_extract(text, r"\b(?:to|into|in)\s+([A-Z][a-z]+)\b", 1)
    return F.when(found != "", found)


def request_steps(text: Column, has_documents: Column | None = None) -> Column:
    supplied = F.lit(False) if has_documents is None else F.coalesce(has_documents, F.lit(False))
    lowered = F.lower(text)
    wanted = []
    for step, pattern in STEP_PATTERNS.items():
        asked = lowered.rlike(pattern)
        wanted.append(F.when(asked & ~supplied if step == "retrieve" else asked, F.lit(step)))
    steps = F.array_compact(F.array(*wanted))
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("answer")))


def summarize(text: str | None, kept: int | None = None) -> str | None:
    """The ``kept`` sentences of a text with the most frequent words on average, in
    their order: five, and eight of a text of more than 50, if it is not given.

    Of equal sentences the earlier one is taken.
    """
    if text is None:
        return None
    sentences = [(s, words) for s in generation.sentences_of(text) if (words := words_of(s))]
    if kept is None:
        many = len(sentences) > COMPLEX_SENTENCES
        kept = COMPLEX_SUMMARY_SENTENCES if many else SUMMARY_SENTENCES
    frequency = Counter(word for _, words in sentences for word in words)
    weights = [sum(frequency[word] for word in words) / len(words) for _, words in sentences]
    chosen = sorted(range(len(sentences)), key=lambda i: (-weights[i], i))[:kept]
    return " ".join(sentences[i][0] for i in sorted(chosen))


def summary_column(text: Column, kept: int | None = None) -> Column:
    """Extractive summary of each text. A text is one row, so nothing is shuffled."""

    @F.pandas_udf("string")
    def summaries(texts: pd.Series) -> pd.Series:
        return pd.Series([summarize(text, kept) for text in texts], dtype=object)

    return summaries(text)


def call_agents(
    requests: DataFrame,
    chunks: DataFrame,
    make_model: Callable[[], generation.Model],
    registry: DataFrame,
    embedder: Embedder | None = None,
    has_documents: Column | None = None,
    min_score: float | None = None,
    sources: DataFrame | None = None,
    with_agents: bool = True,
) -> DataFrame:
    """Answer requests (``query_id, query, target_language``) step by step.

    Each step's output is the next one's input: passages are retrieved for the
    requests that ask for them, then summaries are made, then translations. The
    first step is given what was retrieved, else the request's documents (column
    ``documents``, if there is one) followed by the request, else the request.
    Requests are dealt to tasks of some hundreds, which bounds what Python holds.
    Requests without a step go to the model with their ``messages``, if they have
    that column, or as they are. Steps run over all requests at once. Adds
    ``steps``, ``response``, ``status`` and ``error`` in place of the messages.

    With agents, each step's prompt follows its agent's system prompt, which holds the
    request and no history, and passages go to the model too, as the context in which
    it is asked to retrieve; without, they are the step's output as they are. After a
    failed step its error text is the answer. ``sources`` (``document_id, text``): the
    documents whose fixed windows the chunks are, which then give the passages' texts.
    """
    kept = [name for name in requests.columns if name not in ("messages", "documents")]
    steps = request_steps(F.col("query"), has_documents)
    whole = F.col("query")
    if "messages" in requests.columns:
        whole = prompting.transcript(F.col("messages"))
    material = F.col("query")
    if "documents" in requests.columns:
        both = F.concat("documents", F.lit("\n\n"), "query")
        material = F.coalesce(both, F.col("query"))
    routed = requests.withColumn("steps", steps).select(
        *kept,
        "steps",
        material.alias("_material"),
        F.when(F.array_contains("steps", "answer"), whole).alias("_whole"),
    )
    searching = routed.filter(F.array_contains("steps", "retrieve")).select("query_id", "query")
    ranked = retrieval.top_k_chunks(
        embed_packed(searching, "query", embedder),
        chunks,
        min_score=min_score,
        embedder=None if "embedding" in chunks.columns else embedder or HashedEmbedder(),
        held=None if sources is None else lambda: chunking.fixed_count(sources),
    )
    if sources is None:
        texts = retrieval.with_chunk_text(ranked, chunks)
    else:
        texts = retrieval.with_window_text(ranked, sources, searching.count() * fixed.TOP_K)
    found = retrieval.excerpts(searching, texts, prompt_texts.NO_EXCERPTS)
    tasks = max(-(-requests.count() // REQUESTS_PER_TASK), 1)
    dealt = routed.repartition(tasks, "query_id")
    state = dealt.join(found.select("query_id", "excerpts"), "query_id", "left").select(
        *[name for name in routed.columns if name != "_material"],
        F.coalesce("excerpts", "_material").alias("text"),
        F.lit(None).cast("string").alias("_error"),
    )

    templates = prompting.templates_in_force(registry)
    asked = [("retrieve", "retrieve_document")] if with_agents else []
    for step, task in [*asked, ("summarize", "summarize_text"), ("translate", "translate_text")]:
        text = F.col("query") if step == "retrieve" else F.col("text")
        prompt = prompting.task_prompt(templates[task], text, F.col("target_language"))
        if step == "retrieve":
            slots = {"context": F.col("text"), "question": prompt}
            prompt = prompting.render_fixed(prompt_texts.RAG_PROMPT, slots)
        if with_agents:
            prompt = prompting.agent_call(templates[AGENTS[task]], F.col("query"), prompt)
        wanted = F.array_contains("steps", step)
        state = _model_step(state, wanted, task, make_model, prompt)
    answered = generation.generate(
        state, make_model, "call_agent", "_whole", F.col("_whole").isNotNull()
    )
    failure = F.coalesce("_error", "error")
    return answered.select(
        *kept,
        "steps",
        F.coalesce("response", "text").alias("response"),
        F.when(failure.isNull(), "ok").otherwise("error").alias("status"),
        failure.alias("error"),
    )


def _model_step(
    state: DataFrame,
    wanted: Column,
    task: str,
    make_model: Callable[[], generation.Model],
    prompt: Column,
) -> DataFrame:
    """Run one task for the rows that want it and have not failed before."""
    due = wanted & F.col("_error").isNull()
    prompted = state.withColumn("_prompt", F.when(due, prompt))
    answered = generation.generate(prompted, make_model, task, "_prompt", due)
    return answered.select(
        *[name for name in state.columns if name not in ("text", "_error")],
        F.coalesce("response", "text").alias("text"),
        F.coalesce("_error", "error").alias("_error"),
    )

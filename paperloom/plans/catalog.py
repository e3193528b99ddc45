"""The registered queries: each operator over the given tables, whole.

``documents`` stand for uploaded files, ``benchmark`` texts for questions,
``conversations`` for chat turns, ``events`` for user actions, ``orders`` for
versions per key and ``embeddings`` for stored chunk vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions import prompt_texts
from paperloom.functions import text as texts
from paperloom.operators import (
    chunking,
    conversations,
    documents,
    embedding,
    feedback,
    generation,
    ingest,
    naming,
    prompting,
    retrieval,
    tasks,
)
from paperloom.plans import answer_flow, history_flow, index_flow
from paperloom.plans.layout import fill_cores
from paperloom.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]

BATCH_TIME = "2024-05-01 12:00:00"
LANDING = naming.landing_folder("main", "default")
SMALL_CAP = 5
DOCUMENTS_PER_CONVERSATION = 4
LOOKUP_KEY = 7
# Conversations here have up to eight turns; some have more than one block.
MESSAGES_PER_BLOCK = 3
# Of the ten cells: as many as find 0.9 of the true neighbours (README).
CELL_PROBES = 8
# Of the quantised index; probes as above.
QUANTISED_CELLS = 32
QUANTISED_PROBES = 20
REGISTRY = [
    ("translate_text", 1, "Say in {target_language}: {text}"),
    ("translate_text", 2, "Put into {target_language}:\n{text}\n(from {target_language} only)"),
    ("summarize_text", 3, "Shorten: {text}"),
    ("orchestrator_agent_prompt", 1, "Plan this: {input}\nSo far:\n{chat_history}"),
    ("unknown_prompt", 1, "Never used {text}"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


# ---- files and documents ----


def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a file name: with a UUID in lower or upper case, or without."""
    identity = texts.uuid_from(F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 3
    name = (
        F.when(kind == 0, F.concat(F.upper(identity), F.lit(".PDF")))
        .when(kind == 1, F.concat(F.lit("scan_"), identity, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("note."), F.col("lang"), F.lit(".txt")))
    )
    path = F.concat_ws(
        "/", F.lit("landing"), "source", F.col("doc_id").cast("string"), "file_name"
    )
    table = _table(spark, folder, "documents").withColumn("file_name", name)
    return table.withColumn("path", path)


def landing_filter(spark: SparkSession, folder: str) -> DataFrame:
    uploads = _uploads(spark, folder)
    return uploads.filter(texts.has_document_suffix(F.col("file_name"))).select("doc_id", "file_name")


def landing_names(spark: SparkSession, folder: str) -> DataFrame:
    named = naming.landing_paths(_uploads(spark, folder), "file_name", F.col("doc_id"), LANDING)
    return named.select("doc_id", "upload_id", "landing_path")


def document_uuid(spark: SparkSession, folder: str) -> DataFrame:
    return _uploads(spark, folder).select(
        "doc_id", texts.document_uuid(F.col("path"), F.col("n_chars")).alias("document_uuid")
    )


def document_meta(spark: SparkSession, folder: str) -> DataFrame:
    now = texts.as_timestamp(BATCH_TIME)
    uploads = fill_cores(_uploads(spark, folder).select("doc_id", "path", "text"))
    return uploads.select(
        "doc_id",
        texts.file_name(F.col("path")).alias("file_name"),
        texts.word_count(F.col("text")).cast("long").alias("word_count"),
        _stamp(now).alias("upload_timestamp"),
        _stamp(now).alias("created_at"),
        _stamp(texts.expiry(now)).alias("expires_at"),
    )


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a line is a page, every tenth file has a broken byte."""
    pages = F.encode(F.translate("text", "\n", "\f"), "UTF-8")
    broken = F.concat(pages, F.unhex(F.lit("FF")))
    files = fill_cores(_uploads(spark, folder)).select(
        "path",
        texts.as_timestamp(BATCH_TIME).alias("modificationTime"),
        F.when(F.col("doc_id") % 10 == 0, broken).otherwise(pages).alias("content"),
    )
    return ingest.decode_files(files)


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.document_rows(_decoded(spark, folder), BATCH_TIME)
    return rows.select(
        "file_path",
        "file_name",
        F.col("page_count").cast("long").alias("page_count"),
        F.col("word_count").cast("long").alias("word_count"),
        _stamp(F.col("created_at")).alias("created_at"),
        _stamp(F.col("expires_at")).alias("expires_at"),
        F.md5("text").alias("text_digest"),
    )


def ingest_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.error_rows(_decoded(spark, folder), BATCH_TIME)
    stamp = _stamp(F.col("error_timestamp"))
    return rows.select(
        "file_path", "file_name", "error_message", stamp.alias("error_timestamp")
    )


def document_assemble(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "page_text")
    )
    return ingest.assemble_pages(pages, "doc_id").select(
        "doc_id", F.col("page_count").cast("long").alias("page_count"), "text"
    )


def archive_names(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    name = (
        F.when(kind == 0, F.concat("lang", F.lit(".pdf")))
        .when(kind == 1, F.concat("lang", F.lit("_1.pdf")))
        .when(kind == 2, F.concat("source", F.lit(".v2.pdf")))
        .otherwise(F.col("source"))
    )
    origin = F.concat_ws("/", F.lit("landing"), F.col("doc_id").cast("string"), "file_name")
    uploads = _table(spark, folder, "documents").withColumn("file_name", name)
    labelled = _table(spark, folder, "labels").select("doc_id")
    taken = (
        _table(spark, folder, "documents")
        .join(labelled, "doc_id", "left_semi")
        .select(
            F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias(
                "file_name"
            )
        )
    )
    files = uploads.select(origin.alias("src_path"), "file_name")
    return naming.archive_names(files, taken)


# ---- look-ups and checks ----


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "documents")
    return fill_cores(table.select(F.col("doc_id").alias("document_id"), "text"))


def _fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.fixed_chunks(_texts(spark, folder))


def _chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("chunk_text").alias("chunk_size")
    return _fixed(spark, folder).select("document_id", "chunk_index", size)


def latest_document(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    newest = documents.latest_ids(orders, "o_custkey", "o_orderdate", "o_orderkey")
    return newest.withColumn("o_orderdate", _stamp(F.col("o_orderdate")))


def latest_one(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    newest = documents.latest_one(orders, LOOKUP_KEY, "o_custkey", "o_orderdate", "o_orderkey")
    return newest.select("o_custkey", "o_orderkey", _stamp(F.col("o_orderdate")).alias("o_orderdate"))


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    found = documents.duplicate_keys(_table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    return found.withColumn("o_orderdate", _stamp(F.col("o_orderdate")))


def chunk_document_join(spark: SparkSession, folder: str) -> DataFrame:
    """A text uploaded again has the same key: its chunks go to the newest upload."""
    return _keyed_chunks(spark, folder, documents.attach_document_ids, F.lit(True))


def chunk_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the documents are stored; chunks of other texts are rejected."""
    stored = F.col("doc_id") % 3 > 0
    found = _keyed_chunks(spark, folder, documents.rejected_chunks, stored)
    return found.drop("document_id")


def _keyed_chunks(spark: SparkSession, folder: str, match, stored: Column) -> DataFrame:
    table = _table(spark, folder, "documents").filter(stored).select(
        F.col("doc_id").alias("id"),
        texts.uuid_from(F.col("text")).alias("document_uuid"),
        (F.col("doc_id") * 7919 % 1000).alias("created_at"),
    )
    keyed = fill_cores(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", texts.uuid_from(F.col("text")).alias("document_uuid"), "text"
    )
    joined = match(chunking.fixed_chunks(keyed), table)
    return joined.select(
        "doc_id",
        "document_uuid",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.length("chunk_text").cast("long").alias("chunk_size"),
        "document_id",
    )


def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunk_sizes(spark, folder)
    found = documents.orphan_chunks(chunks, _table(spark, folder, "labels"), "doc_id")
    return _long(found, "chunk_index", "chunk_size")


def unchunked_documents(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"))
    chunked = _table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    chunks = chunking.fixed_chunks(chunked.join(labelled, "document_id", "left_semi"))
    table = _table(spark, folder, "documents").select("doc_id", "lang", "source")
    return documents.unchunked_documents(table, chunks, "doc_id").select("doc_id", "lang", "source")


def pending_chunks(spark: SparkSession, folder: str) -> DataFrame:
    done = _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.pmod("label", F.lit(3)).alias("chunk_index")
    )
    pending = documents.pending_chunks(_chunk_sizes(spark, folder), done)
    return _long(pending, "chunk_index", "chunk_size")


def _long(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("long") for name in names})


# ---- chunks ----


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _fixed(spark, folder).select(
        "document_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "chunk_text",
        F.length("chunk_text").cast("long").alias("chunk_size"),
    )


def _recursive(spark: SparkSession, folder: str, splitter=None) -> DataFrame:
    rows = _texts(spark, folder)
    return chunking.recursive_chunks(rows, ["document_id"], splitter=splitter)


def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.chunk_rows(
        _recursive(spark, folder).filter(F.col("error").isNull()),
        BATCH_TIME,
        "document_id",
        F.concat(F.lit("landing/"), F.col("document_id").cast("string")),
    )
    return _long(rows, "chunk_index", "chunk_size").select(
        "document_id",
        "chunk_index",
        "chunk_text",
        "chunk_size",
        "processed_for_embedding",
        "document_uri",
    )


def chunk_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    splitter = chunking.RecursiveSplitter(overlap=0)
    return chunking.rebuilt_digest(_recursive(spark, folder, splitter))


def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    return _long(chunking.chunk_report(_fixed(spark, folder)), "last_index")


# ---- embeddings and retrieval ----


def hashed_embedding(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["document_id", "chunk_index"]
    entries = embedding.vector_entries(embedding.embed(_fixed(spark, folder), "chunk_text"), keys)
    return _long(entries, "chunk_index").withColumn("unit_value", F.round("unit_value", 6))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return fill_cores(_table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))


def _vector_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    questions = _vectors(spark, folder).select(F.col("vec_id").alias("query_id"), "embedding")
    chunks = _vectors(spark, folder).select(
        F.col("vec_id").alias("document_id"), F.col("label").alias("chunk_index"), "embedding"
    )
    return questions, chunks


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = _vector_sides(spark, folder)
    return _scored(retrieval.top_k_chunks(questions, chunks))


def vector_topk_approximate(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = _vector_sides(spark, folder)
    centres = retrieval.mean_centres(chunks, "chunk_index")
    cells = retrieval.assign_cells(chunks, centres)
    return _scored(retrieval.approximate_top_k(questions, cells, centres, CELL_PROBES))


def _indexed(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Questions, and a store with the quantised index of all vectors."""
    questions, chunks = _vector_sides(spark, folder)
    store = new_folder(spark, "vectors")
    index_flow.build_quantised_index(chunks, store, QUANTISED_CELLS)
    return questions, store


def vector_topk_quantised(spark: SparkSession, folder: str) -> DataFrame:
    questions, store = _indexed(spark, folder)
    return _scored(index_flow.search_quantised(questions, store, QUANTISED_PROBES))


def vector_topk_bounds(spark: SparkSession, folder: str) -> DataFrame:
    questions, store = _indexed(spark, folder)
    return _scored(index_flow.search_by_bounds(questions, store))


def _scored(ranked: DataFrame) -> DataFrame:
    return _long(ranked, "rank").withColumn("score", F.round("score", 4))


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    store = new_folder(spark, "postings")
    index_flow.build_postings(_fixed(spark, folder), store)
    ranked = index_flow.search_postings(_questions(spark, folder), store)
    return _long(ranked, "rank").withColumn("score", F.round("score", 6))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _ranked(spark: SparkSession, folder: str, questions: DataFrame) -> DataFrame:
    """Chunks are cut, embedded and ranked in the pass that reads the documents."""
    return retrieval.top_k_chunks(
        embedding.embed(questions, "query"),
        _fixed(spark, folder),
        embedder=embedding.HashedEmbedder(),
    )


def _ranked_texts(spark: SparkSession, folder: str, questions: DataFrame) -> DataFrame:
    most = questions.count() * fixed.TOP_K
    ranked = _ranked(spark, folder, questions)
    return retrieval.with_window_text(ranked, _texts(spark, folder), most)


def rag_topk(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _ranked(spark, folder, _questions(spark, folder))
    return _scored(ranked)


def rag_context(spark: SparkSession, folder: str) -> DataFrame:
    questions = _questions(spark, folder)
    return retrieval.contexts(questions, _ranked_texts(spark, folder, questions))


def rag_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return prompting.rag_prompts(rag_context(spark, folder))


def rag_answer(spark: SparkSession, folder: str) -> DataFrame:
    answered = generation.generate(rag_prompt(spark, folder), generation.extractive_model)
    return answered.select("query_id", "response", "status")


def retrieve_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    questions = _questions(spark, folder)
    ranked = _ranked_texts(spark, folder, questions)
    return retrieval.excerpts(questions, ranked, prompt_texts.NO_EXCERPTS)


# ---- conversations ----


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def _uploaded(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation has up to four of the documents."""
    return _table(spark, folder, "documents").select(
        F.call_function("div", "doc_id", F.lit(DOCUMENTS_PER_CONVERSATION)).alias("conv_id"),
        F.col("doc_id").alias("position"),
        "text",
    )


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.documents_context(_uploaded(spark, folder))


def visible_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.visible_turns(_turns(spark, folder))


def conversation_cap(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversation_sizes(_turns(spark, folder), SMALL_CAP)


def admitted_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.admitted_turns(_turns(spark, folder), SMALL_CAP)


def history_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.history_pairs(_turns(spark, folder))


def _histories(rows: DataFrame) -> DataFrame:
    messages = F.transform("history", lambda one: F.concat(one["role"], F.lit(": "), one["text"]))
    return rows.select(
        "conv_id",
        "turn",
        F.size("history").cast("long").alias("messages"),
        F.array_join(messages, "\n").alias("history"),
    )


def turn_history(spark: SparkSession, folder: str) -> DataFrame:
    return _histories(conversations.turn_history(_turns(spark, folder)))


def turn_history_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored blocks, which turns of a conversation share."""
    store = new_folder(spark, "history")
    history_flow.store_conversations(_turns(spark, folder), store, MESSAGES_PER_BLOCK)
    return _histories(history_flow.stored_histories(spark, store))


def closed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    steps = _table(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "event_type"
    )
    return conversations.closed_conversations(steps, F.col("event_type") == "error")


def chat_segments(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    reset = F.col("event_type") == "signup"
    numbered = conversations.chat_segments(events, "user_id", "ts", reset, ["ts", "event_id"])
    return numbered.select("event_id", "user_id", "segment")


def documents_context(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder).select("conv_id", "documents", "plain", "numbered")


def seeded_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.seeded_turns(
        _turns(spark, folder), _contexts(spark, folder), prompt_texts.DOCUMENT_SEED
    )


def feedback_text(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.feedback_text(_turns(spark, folder), _contexts(spark, folder))


def feedback_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings as users might send them: missing, whole, with a fraction, as a word."""
    points = F.floor(F.col("value") / 70).cast("string")
    rating = (
        F.when(F.col("event_type") == "view", F.lit(None).cast("string"))
        .when(F.col("event_id") % 7 == 0, F.concat(points, F.lit(".5")))
        .when(F.col("event_id") % 7 == 1, F.lit("good"))
        .otherwise(points)
    )
    submitted = _table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("text"),
        rating.alias("rating"),
        F.col("props").alias("comments"),
    )
    rows = _long(feedback.feedback_rows(submitted, BATCH_TIME), "rating")
    return rows.withColumn("created_at", _stamp(F.col("created_at")))


def clean_response(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as model outputs: some with traces around the text, some missing."""
    body = F.col("text")
    kind = F.col("turn") % 4
    output = (
        F.when(F.col("role") == "system", F.lit(None).cast("string"))
        .when(kind == 0, F.concat(F.lit("<think>"), body, F.lit("</think>\n "), body, F.lit("\t\n")))
        .when(kind == 1, F.concat(F.lit("Thought: "), body, F.lit("\nObservation: "), body))
        .when(
            kind == 2,
            F.concat(
                body,
                F.lit(" Action: find\nAction Input: "),
                body,
                F.lit("\nObservation:<think>a</think>"),
                body,
            ),
        )
        .otherwise(F.concat(F.lit("<think>open "), body))
    )
    return _turns(spark, folder).select("conv_id", "turn", texts.clean_response(output).alias("response"))


# ---- tasks ----


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as requests of different kinds."""
    kind = F.col("conv_id") % 5
    opening = (
        F.when(kind == 0, "Summarize this: ")
        .when(kind == 1, "Translate to French: ")
        .when(kind == 2, "Find documents about ")
        .when(kind == 3, "Find texts, summarise and translate them: ")
        .otherwise("")
    )
    return (
        _turns(spark, folder)
        .filter(F.col("role") == "user")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.concat(opening, F.col("text")).alias("query"),
            F.when(kind == 1, "French").when(kind == 3, "German").alias("target_language"),
            (F.col("turn") % 3 == 1).alias("has_documents"),
        )
    )


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "name string, version int, template string")


def route_requests(spark: SparkSession, folder: str) -> DataFrame:
    routed = tasks.route_requests(_requests(spark, folder), "query", F.col("has_documents"))
    return _long(routed, "step_no").select("query_id", "step_no", "step")


def task_prompts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("query_id") % 4
    name = (
        F.when(kind == 0, "translate_text")
        .when(kind == 1, "summarize_text")
        .when(kind == 2, "retrieve_document")
        .otherwise("unknown_prompt")
    )
    asked = _requests(spark, folder).select(
        "query_id", F.col("query").alias("text"), "target_language", name.alias("task")
    )
    return prompting.task_prompts(asked, _registry(spark)).select("query_id", "task", "prompt")


def agent_messages(spark: SparkSession, folder: str) -> DataFrame:
    history = conversations.paired_history(_turns(spark, folder))
    called = prompting.agent_messages(history, _contexts(spark, folder))
    joined = F.transform("messages", lambda one: F.concat(one["role"], F.lit("> "), one["text"]))
    return called.select(
        "conv_id",
        "turn",
        F.size("messages").cast("long").alias("messages"),
        F.md5(F.array_join(joined, "\n")).alias("digest"),
    )


def extractive_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_cores(_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", tasks.summary_column(F.col("text")).alias("summary"))


def _echo() -> generation.Model:
    """Gives the prompts back, so that the answers show what each step was given."""
    return lambda prompts: prompts


def agent_answers(spark: SparkSession, folder: str) -> DataFrame:
    answered = tasks.call_agents(
        _requests(spark, folder),
        _fixed(spark, folder),
        _echo,
        _registry(spark),
        has_documents=F.col("has_documents"),
        sources=_texts(spark, folder),
    )
    return answered.select(
        "query_id", F.array_join("steps", ",").alias("steps"), "response", "status"
    )


def _picky() -> generation.Model:
    """Refuses prompts by their length, so that each step's errors occur."""

    def answer(prompts: list[str]) -> list[str]:
        for prompt in prompts:
            if len(prompt) % 3 == 0:
                raise ValueError(f"prompt of {len(prompt)} characters refused")
        return prompts

    return answer


def agent_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is answered where the model fails: the step's error text, and no later step."""
    answered = tasks.call_agents(
        _requests(spark, folder),
        _fixed(spark, folder),
        _picky,
        _registry(spark),
        has_documents=F.col("has_documents"),
        sources=_texts(spark, folder),
    )
    return answered.filter(F.col("status") == "error").select(
        "query_id", F.array_join("steps", ",").alias("steps"), "response", "error"
    )


def _opened_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns whose user's texts name tasks, by conversation."""
    kind = F.col("conv_id") % 4
    opening = (
        F.when(kind == 0, "Summarize this: ")
        .when(kind == 1, "Translate it to French: ")
        .when(kind == 2, "Summarise and translate it into German: ")
        .otherwise("")
    )
    asked = F.when(F.col("role") == "user", F.concat(opening, F.col("text")))
    return _turns(spark, folder).withColumn("text", F.coalesce(asked, "text"))


def answer_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The model gives its prompt back, which shows what each turn was given."""
    answered = answer_flow.answer_turns(
        _opened_turns(spark, folder),
        _uploaded(spark, folder),
        _fixed(spark, folder),
        _echo,
        _registry(spark),
        sources=_texts(spark, folder),
    )
    return answered.select(
        "conv_id",
        "turn",
        F.array_join("steps", ",").alias("steps"),
        F.md5("response").alias("digest"),
        "status",
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        landing_filter,
        landing_names,
        document_uuid,
        document_meta,
        ingest_documents,
        ingest_errors,
        document_assemble,
        archive_names,
        latest_document,
        latest_one,
        duplicate_keys,
        chunk_document_join,
        chunk_rejects,
        orphan_chunks,
        unchunked_documents,
        pending_chunks,
        chunk_fixed,
        chunk_recursive,
        chunk_rebuild,
        chunk_report,
        hashed_embedding,
        vector_topk,
        vector_topk_approximate,
        vector_topk_quantised,
        vector_topk_bounds,
        lexical_topk,
        rag_topk,
        rag_context,
        rag_prompt,
        rag_answer,
        retrieve_excerpts,
        visible_turns,
        conversation_cap,
        admitted_turns,
        history_pairs,
        turn_history,
        turn_history_blocks,
        closed_conversations,
        chat_segments,
        documents_context,
        seeded_turns,
        feedback_text,
        feedback_rows,
        clean_response,
        route_requests,
        task_prompts,
        agent_messages,
        extractive_summary,
        agent_answers,
        agent_errors,
        answer_turns,
    )
}

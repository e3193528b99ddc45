"""Prompts for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom.functions import prompt_texts


def render(template: Column, slots: dict[str, Column]) -> Column:
    """Put values into a template's slots.

    The template is cut at its slots before anything is put in, so braces inside
    a value are never taken for a slot.
    """
    names = "|".join(slots)
    marks = [rf"(?=\{{(?:{names})\}})"]
    marks += [rf"(?<=\{{{name}\}})" for name in slots]
    pieces = F.split(template, "|".join(marks))

    def fill(piece: Column) -> Column:
        filled = piece
        for name, value in slots.items():
            filled = F.when(piece == "{" + name + "}", value).otherwise(filled)
        return F.coalesce(filled, F.lit(""))

    return F.array_join(F.transform(pieces, fill), "")


def render_fixed(template: str, slots: dict[str, Column]) -> Column:
    """The same for a template known when the query is written: a plain concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in slots]
        found = [(at, name) for at, name in found if at >= 0]
        at, name = min(found, default=(len(rest), None))
        if at:
            parts.append(F.lit(rest[:at]))
        if name is None:
            break
        parts.append(F.coalesce(slots[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [(name, prompt_texts.DEFAULT_TEMPLATES[name]) for name in fixed.PROMPT_NAMES]
    return spark.createDataFrame(rows, "name string, template string")


def latest_templates(registry: DataFrame) -> DataFrame:
    """Template in force per known prompt name: the newest registered version
    (``name, version, template``; of equal versions the last text), else the default. At most one row per name."""
    newest = (
        registry.filter(F.col("name").isin(fixed.PROMPT_NAMES))
        .groupBy("name")
        .agg(F.max_by("template", F.struct("version", "template")).alias("_registered"))
    )
    return (
        default_templates(registry.sparkSession)
        .join(newest, "name", "left")
        .select("name", F.coalesce("_registered", "template").alias("template"))
    )


def templates_in_force(registry: DataFrame) -> dict[str, str]:
    """The same as a dictionary, for jobs whose prompts are known beforehand."""
    return {row["name"]: row["template"] for row in latest_templates(registry).collect()}


def task_prompt(template: str, text: Column, target_language: Column) -> Column:
    """Prompt of one task from its template."""
    language = F.coalesce(target_language, F.lit(prompt_texts.UNNAMED_LANGUAGE))
    return render_fixed(template, {"text": text, "target_language": language})


def task_prompts(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``prompt`` to requests (``task, text, target_language``).

    The template table has one row per prompt name, seven in all, and is sent to
    every task. Requests for an unknown prompt have a null prompt.
    """
    language = F.coalesce("target_language", F.lit(prompt_texts.UNNAMED_LANGUAGE))
    templates = latest_templates(registry).select(F.col("name").alias("task"), "template")
    prompt = render(F.col("template"), {"text": F.col("text"), "target_language": language})
    return (
        requests.join(F.broadcast(templates), "task", "left")
        .withColumn("prompt", F.when(F.col("template").isNotNull(), prompt))
        .drop("template")
    )


def rag_prompts(contexts: DataFrame, template: str = prompt_texts.RAG_PROMPT) -> DataFrame:
    """Add the question's ``prompt`` (``query, context``)."""
    slots = {"context": F.col("context"), "question": F.col("query")}
    return contexts.withColumn("prompt", render_fixed(template, slots))


def agent_messages(
    history: DataFrame,
    contexts: DataFrame,
    agent: str = "orchestrator_agent_prompt",
    template: str | None = None,
) -> DataFrame:
    """Messages of an agent call per user turn, as ``array<struct<role,text>>``.

    ``history`` is ``conv_id, turn, text, history`` (see ``paired_history``),
    ``contexts`` the documents of a conversation. Order: system prompt, the
    documents with their acknowledgement if there are any, history, the request.
    """

    def message(role: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))

    documents = F.concat(
        F.lit(fixed.DOCUMENTS_PREAMBLE), F.col("numbered"), F.lit("\n")
    )
    preamble = F.when(
        F.col("numbered").isNotNull(),
        F.concat(message("human", documents), message("ai", F.lit(fixed.DOCUMENTS_ACKNOWLEDGED))),
    ).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    earlier = F.concat("_preamble", "history")
    system = render_fixed(
        template or prompt_texts.DEFAULT_TEMPLATES[agent],
        {"chat_history": transcript(earlier), "input": F.col("text")},
    )
    return (
        history.join(contexts.select("conv_id", "numbered"), "conv_id", "left")
        .withColumn("_preamble", preamble)
        .select(
            "conv_id",
            "turn",
            "text",
            F.col("numbered").isNotNull().alias("has_documents"),
            F.concat(
                message("system", system), "_preamble", "history", message("human", F.col("text"))
            ).alias("messages"),
        )
    )


def agent_call(template: str, request: Column, prompt: Column) -> Column:
    """What a specialist's model is given, as one text: the agent's system prompt with the
    request and an empty history, then the prompt of its task."""
    system = render_fixed(template, {"chat_history": F.lit(""), "input": request})
    return F.concat(F.lit("system: "), system, F.lit("\nhuman: "), prompt)


def transcript(messages: Column) -> Column:
    """Messages as one text, a line for each, for models that take text."""
    lines = F.transform(messages, lambda one: F.concat(one["role"], F.lit(": "), one["text"]))
    return F.array_join(lines, "\n")

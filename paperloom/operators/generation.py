"""Answers from a caller-given model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed_values as fixed
from paperloom.functions.text import clean_response
from paperloom.operators.embedding import words_of

Model = Callable[[list[str]], list[str]]

# Rows that are in Python as objects, and given to a model, at a time.
ROWS_AT_ONCE = 256


def generate(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    task: str = "call_agent",
    prompt: str = "prompt",
    where: Column | None = None,
) -> DataFrame:
    """Add ``response``, ``status`` and ``error`` to rows that have a prompt.

    ``make_model`` is called once per task and gives a function from a list of
    prompts, a few hundred at most, to a list of outputs. When it fails for a batch, the prompts are tried
    one by one, so only the failing ones get ``status = 'error'`` and the task's
    error text as response. Responses are cleaned. Rows keep their identity by
    their own columns; no order of rows is relied on.
    """
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    asked = prompts.withColumn("_asked", wanted)
    schema = T.StructType(
        [
            *asked.schema.fields,
            T.StructField("_output", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def answer(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            outputs = model(texts)
            if len(outputs) != len(texts):
                raise ValueError("model gave another number of outputs than prompts")
            return [(output, None) for output in outputs]
        except Exception as failure:
            if len(texts) == 1:
                return [(None, str(failure) or type(failure).__name__)]
            return [one for text in texts for one in answer(model, [text])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                chosen = pc.and_(part.column("_asked"), pc.is_valid(part.column(prompt)))
                places = pc.indices_nonzero(chosen).to_pylist()
                results: list[tuple] = [(None, None)] * part.num_rows
                if places:
                    model = model or make_model()
                    texts = part.column(prompt).filter(chosen).to_pylist()
                    for place, result in zip(places, answer(model, texts)):
                        results[place] = result
                made = [pa.array(column, pa.string()) for column in zip(*results)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    failed = F.col("error").isNotNull()
    message = F.concat(F.lit(fixed.ERROR_PREFIXES[task]), F.col("error"))
    response = F.when(failed, message).otherwise(clean_response(F.col("_output")))
    return (
        asked.mapInArrow(run, schema)
        .withColumn("response", F.when(F.col("_asked"), response))
        .withColumn("status", F.when(F.col("_asked"), F.when(failed, "error").otherwise("ok")))
        .drop("_asked", "_output")
    )


_SENTENCE = re.compile(r"[^.!?]+[.!?]*")


def sentences_of(text: str) -> list[str]:
    stripped = (sentence.strip() for sentence in _SENTENCE.findall(text))
    return [sentence for sentence in stripped if sentence]


def best_sentence(prompt: str) -> str | None:
    """The context sentence that shares most words with the question.

    A rule-based stand-in for a model. It reads the default retrieval prompt and
    returns nothing when there is no context. The first of equal sentences wins.
    """
    head, _, question = prompt.rpartition("\n\nQuestion: ")
    context = head.partition("Context: ")[2]
    asked = set(words_of(question.rpartition("\n\nAnswer: ")[0]))
    return max(
        sentences_of(context),
        key=lambda sentence: len(asked.intersection(words_of(sentence))),
        default=None,
    )


def extractive_model() -> Model:
    return lambda prompts: [best_sentence(prompt) for prompt in prompts]

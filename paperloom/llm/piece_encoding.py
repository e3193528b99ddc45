"""SentencePiece encoding and decoding by a table over prefixes.

A merge-type (BPE) encoding has this property: a row of tokens is the encoding of
its text if and only if each two neighbours are the encoding of theirs. So every
prefix of a text has one last token: the token ending there which starts where an
earlier prefix ends, and which is compatible with that prefix's last token. An
automaton lists the tokens ending at each place, pairs are tested once and kept,
and the ids are read off the table backwards. Time grows with the text's length,
however long a run without spaces is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Memo, kept_in_worker
from paperloom.llm.words import text_slices

SPACE = "▁"
#: Words and pairs that a worker remembers. Only speed depends on these.
WORDS_KEPT = 200_000
PAIRS_KEPT = 400_000
SLICE_CHARS = 1_500_000


class PieceTable:
    """Encoder of one model file."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        self.size = size
        self.unknown = self.library.unk_id()
        self.pieces: list[str] = [self.library.id_to_piece(i) for i in range(size)]
        self.bytes_at = [-1] * 256
        self.scores: dict[str, float] = {}
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.bytes_at[int(piece[1:-1], 16)] = i
            elif self.library.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                self.scores[piece] = self.library.get_score(i)
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        self.automaton = automaton
        # Where no piece has a space mark after another character, no merge crosses
        # from a word to the next, and words are encoded by themselves.
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        parted = not any(crossing.search(piece) for piece in self.scores)
        pattern = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if parted else r"(?s:.+)"
        self.words_of = re.compile(pattern).findall
        self.words = Memo(self._word, WORDS_KEPT)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The encoding by definition: merge the best pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [
                (-self.scores[joined], k)
                for k in range(len(parts) - 1)
                if (joined := parts[k] + parts[k + 1]) in self.scores
            ]
            if not scored:
                break
            _, k = min(scored)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _string(self, token: int) -> str:
        return self.pieces[token] if token < self.size else chr(token - self.size)

    def _stands_alone(self, token: int) -> bool:
        found = self.alone.get(token)
        if found is None:
            text = self._string(token)
            found = self.alone[token] = self._merged(text) == [text]
        return found

    def _compatible(self, left: int, right: int) -> bool:
        key = left * (self.size + 0x110000) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            a, b = self._string(left), self._string(right)
            found = self.pairs[key] = self._merged(a + b) == [a, b]
        return found

    def _tokens(self, word: str) -> list[int]:
        """Tokens of a word; a character outside the vocabulary is ``size`` + its number."""
        n = len(word)
        last = [-1] * (n + 1)
        lengths = [1] * (n + 1)
        done = 0
        compatible = self._compatible
        for end, (token, length) in self.automaton.iter(word):
            i = end + 1
            while done < end:  # places before this one that no piece fits
                done += 1
                if last[done] < 0:
                    last[done] = self.size + ord(word[done - 1])
            if last[i] < 0:
                j = i - length
                if self._stands_alone(token) if j == 0 else compatible(last[j], token):
                    last[i] = token
                    lengths[i] = length
        while done < n:
            done += 1
            if last[done] < 0:
                last[done] = self.size + ord(word[done - 1])
        tokens = []
        i = n
        while i > 0:
            tokens.append(last[i])
            i -= lengths[i]
        tokens.reverse()
        return tokens

    def _word(self, word: str) -> bytes:
        ids: list[int] = []
        for token in self._tokens(word):
            if token < self.size:
                ids.append(token)
            else:
                ids += [
                    self.unknown if self.bytes_at[b] < 0 else self.bytes_at[b]
                    for b in chr(token - self.size).encode()
                ]
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        parts = self.words_of(self.library.normalize(text))
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), np.int32)


def piece_table(model_file: str) -> PieceTable:
    """One table a worker and model."""
    return kept_in_worker(("pieces", model_file), lambda: PieceTable(model_file))


def encode_documents(
    docs: DataFrame,
    model_file: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = "decoded",
) -> DataFrame:
    """The rows with two more columns: the ids of ``text`` as the model's library gives
    them, without begin and end ids, and the text that these ids decode to.

    Null and empty texts have no ids and decode to an empty text. Existing columns of
    those names are replaced; repeated rows are encoded each; an empty table stays
    empty; nothing is shuffled. The model needs byte pieces for characters outside
    its vocabulary, and its file must be on every executor. Rows are handed on in
    slices of bounded size, whatever the size of the batches that come in.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    fields = [F.lit(None).cast("array<int>").alias(ids)]
    if decoded:
        fields.append(F.lit("").alias(decoded))
    schema = docs.select("*", *fields).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for first, last in text_slices(texts, SLICE_CHARS):
                found = [table.encode(t or "") for t in texts[first:last]]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(found))
                more = {ids: lists}
                if decoded:
                    more[decoded] = pa.array(
                        [table.library.decode(x.tolist()) if len(x) else "" for x in found],
                        pa.string(),
                    )
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *more.values()], [*part.schema.names, *more]
                )

    return docs.mapInArrow(encode, schema)


def decode_pieces(ids: Column, model_file: str) -> Column:
    """The text of a list of ids; empty for null and empty lists."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = piece_table(model_file).library
        for lists in batches:
            yield pd.Series(
                ["" if x is None or len(x) == 0 else library.decode(x.tolist()) for x in lists],
                dtype=object,
            )

    return decoded(ids)

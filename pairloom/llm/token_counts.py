"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary piece that ends at a place of the
text; dynamic programming keeps the best score that reaches a place and how many
tokens that path has, never the tokens.  The rules are those of a unigram
tokenizer, so counts are exactly its own:

* of equal scores the path whose last piece starts first wins;
* a character that is no piece of its own may stand as unknown, at the lowest
  score of the vocabulary less 10, and counts one token per UTF-8 byte where the
  vocabulary has byte pieces, otherwise one per run of unknown characters;
* spaces become ``▁`` and one is put in front.

No piece holds ``▁`` behind another character (that is checked), so the best path
of a text is that of its words in a row, and words are counted once per task and
kept, up to a fixed number.  A text with a vocabulary for which that does not hold
is one path.

Pieces and scores come from a public SentencePiece file, whose path is a
parameter; nothing is trained.

Defined results: NULL and empty texts have 0 tokens.  Repeated rows are counted
one by one; other columns pass through, but for one named like the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairloom.llm.common import filled

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 800_000
CACHED_CHARS = 48


class UnigramCounter:
    """Counts tokens of texts under pieces with scores."""

    def __init__(self, scores: dict[str, float], byte_pieces: bool):
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.singles = {p for p in scores if len(p) == 1}
        self.byte_pieces = byte_pieces
        self.found = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        inside = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
        self.by_word = not any(inside.search(p) for p in scores)
        # A character in no longer piece stands alone: every best path has a joint on both its sides.
        self.line_end_alone = byte_pieces and not any("\n" in p for p in scores)
        self.parts = re.compile(f"\n+|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+" if self.line_end_alone else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if not self.by_word:
            return self.best_path(marked)
        known, total = self.known, 0
        for word in self.parts.findall(marked):
            n = known.get(word)
            if n is None:
                n = self.best_path(word)
                if len(word) <= CACHED_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def best_path(self, text: str) -> int:
        """Tokens on the best path through ``text``.

        Matches come by their end, at one end the longest first, that is the earliest
        start first: a later one has to be better, not just as good.
        """
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        if not self.singles.issuperset(text):
            return self._best_path_with_unknown(text, best, count)
        filled_to = 0  # every place ends a piece, if only a single character
        for last, (size, score) in self.found.iter(text):
            end, start = last + 1, last + 1 - size
            reach = best[start] + score
            if end != filled_to or reach > best[end]:
                filled_to, best[end], count[end] = end, reach, count[start] + 1
        return count[-1]

    def _best_path_with_unknown(self, text: str, best: list[float], count: list[int]) -> int:
        matches = self.found.iter(text)
        last, (size, score) = next(matches, (-1, (0, 0.0)))
        was_unknown = False  # the best path to the place before ends with an unknown character
        for at, char in enumerate(text):
            end, top, tokens, is_unknown = at + 1, None, 0, False
            while last == at:
                reach = best[end - size] + score
                if top is None or reach > top:
                    top, tokens = reach, count[end - size] + 1
                last, (size, score) = next(matches, (-1, (0, 0.0)))
            if char not in self.singles:
                reach = best[at] + self.unknown
                if top is None or reach > top:
                    top, is_unknown = reach, True
                    tokens = count[at] + (len(char.encode()) if self.byte_pieces else int(not was_unknown))
            best[end], count[end], was_unknown = top, tokens, is_unknown
        return count[-1]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """The counter over the pieces and scores of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter({model.id_to_piece(i): model.get_score(i) for i in normal}, any(map(model.is_byte, ids)))


def counts(docs: DataFrame, text_col: str, *keys: Column, into: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """The key columns and the number of tokens; the text goes to the counter and does not come back."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(*keys, filled(docs[text_col]).alias(into))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            found = pa.array([count(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=batch.schema.names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(into, LongType())]))


def count_tokens(docs: DataFrame, text_col: str = "text", into: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """The documents, text and all, with their number of tokens."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    return counts(docs, text_col, *kept, into=into, vocabulary=vocabulary)


# --- the query --------------------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    return counts(docs, "text", F.col("doc_id"))

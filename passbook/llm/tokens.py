"""Operator 5: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; the
best score and the number of pieces up to there are all that is carried on. Ties go the
tokenizer's way: of equal scores the piece that starts first (the longest) wins, and a
character without a piece of its own is unknown (least score less 10) and costs one token
for each of its UTF-8 bytes.

Blanks become the mark ``▁``, and one is put before the text. As no piece has the mark
after another character, and none has a line end, the best path breaks there, and the
chunks between are counted one by one; a task remembers up to ``CACHE`` of them.

The vocabulary file is a parameter; it is read on the driver and broadcast (its size is the
file's, a few MB). Its pieces and scores are used as they are, as unigrams.

Cases: null and empty texts have no tokens; a null doc_id is returned as it is; repeated
rows are counted each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
CACHE = 300_000
_CHUNK = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece model that stand for text, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), float(model.get_score(i)))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        self.breaks = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary)
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, chunk: str) -> tuple[int, float]:
        """Pieces and score of the best path through ``chunk``."""
        best: list[float] = [0.0]
        count: list[int] = [0]
        found = self.automaton.iter(chunk)
        end, match = next(found, (-1, None))
        for at, char in enumerate(chunk):
            score, pieces = None, 0
            while match is not None and end == at:  # longest first: the earliest start
                length, gain = match
                start = at + 1 - length
                if score is None or best[start] + gain > score:
                    score, pieces = best[start] + gain, count[start] + 1
                end, match = next(found, (-1, None))
            if char not in self.single and (score is None or best[at] + self.unknown > score):
                score = best[at] + self.unknown
                pieces = count[at] + len(char.encode("utf-8", "surrogatepass"))
            best.append(score)
            count.append(pieces)
        return count[-1], best[-1]

    def chunk(self, chunk: str) -> tuple[int, float]:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[chunk] = self.viterbi(chunk)
        return got

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.breaks:
            return self.viterbi(marked)
        lines = text.count("\n")
        pieces, score = lines, lines * self.unknown
        chunk = self.chunk
        for part in _CHUNK.findall(marked):
            n, s = chunk(part)
            pieces += n
            score += s
        return pieces, score


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, and the score of the best segmentation, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for batch in batches:
            got = [counter.count(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "tokens": [n for n, _ in got], "score": [s for _, s in got]}
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(count, "doc_id bigint, tokens bigint, score double")

"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary names every piece that ends at a
character; dynamic programming carries the best score and the number of its
pieces to each position, and nothing else, so no segmentation is kept.

Tie rules are those of the public ``tokenizers`` library's Unigram model: at an
end, candidates come in the order of their starts, and a later one must be
strictly better, so of equal scores the longest last piece stays. A character
without a piece of its own counts as unknown, at the lowest score less 10;
it stands for its UTF-8 bytes (byte fallback), so it counts as many tokens.

Words are runs of characters other than white space (U+0020, U+0009 to U+000D);
each is scored with the word mark in front, as the library's Metaspace does.

The vocabulary is a piece file of a public tokenizer; its path is a parameter.
The scores of that file are used as they are.

Defined cases: null or empty texts have 0 words and 0 tokens; empty tables give
empty results; repeated rows are each counted; one word may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a worker remembers before it starts afresh; longer words than LONGEST_KEY aren't remembered.
REMEMBERED = 1_000_000
LONGEST_KEY = 64
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids, control and byte pieces included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and its number of tokens."""
        n = len(text)
        score: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        at = 0  # positions up to here are final
        best, pieces, single = None, 0, False

        def close(e: int, best, pieces, single) -> None:
            """Ends at e: the unknown character comes after the longer pieces, as their starts are earlier."""
            if not single:
                s = score[e - 1] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[e - 1] + len(text[e - 1].encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, pieces

        for last, (size, weight) in self.automaton.iter(text):
            e = last + 1
            if e != at:
                if at:
                    close(at, best, pieces, single)
                for k in range(at + 1, e):
                    close(k, None, 0, False)
                at, best, pieces, single = e, None, 0, False
            single |= size == 1
            s = score[e - size] + weight
            if best is None or s > best:  # longest first, so the first of equals is the longest
                best, pieces = s, count[e - size] + 1
        if at:
            close(at, best, pieces, single)
        for k in range(at + 1, n + 1):
            close(k, None, 0, False)
        return score[n], count[n]

    def word(self, w: bytes) -> int:
        c = self.known.get(w)
        if c is None:
            c = self.viterbi(MARK + w.decode("utf-8", "surrogatepass"))[1]
            if len(w) <= LONGEST_KEY:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[w] = c
        return c

    def text(self, text: str | None) -> tuple[int, int]:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        return len(words), sum(map(self.word, words))


@cache
def default_counter(path: str | None = None) -> Counter:
    """One for each worker; tasks that follow in the worker find the words it remembers."""
    import public_tokenizers as P

    return Counter(read_pieces(path or P.path("piece_bpe_32k.model")))


def token_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``id_col``, n_words, n_tokens of every row. No shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = default_counter(path)
        for b in it:
            rows = [counter.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                             [id_col, "n_words", "n_tokens"])

    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return own.mapInArrow(batches, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")

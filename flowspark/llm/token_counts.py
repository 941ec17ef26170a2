"""Token counts (8): Viterbi over a unigram vocabulary that carries only scores and counts.

A text is split at white space and every word gets the word mark in front. An Aho-Corasick automaton
lists all vocabulary pieces in a word; dynamic programming over its characters keeps, for each end, the
best score and the number of pieces on the best path. Ties follow the usual unigram tokenizers: paths
are offered by start from left to right and a later one must be strictly better. A character without a
piece of its own costs the lowest score less ten; neighbouring ones count as one unknown token, or with
``byte_fallback`` as their bytes.

The vocabulary is read on the driver and sent to the tasks; more than ``MAX_PIECES`` pieces are refused.

Results for odd input: a null or blank text has 0 tokens; a very long word is worked through in memory
proportional to its length; repeated rows repeat; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 2_000_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CACHE = 400_000  # words whose counts a task remembers


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a piece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]


def word_counter(pieces: list[tuple[str, float]], byte_fallback: bool = False) -> Callable[[str], int]:
    """Count the tokens of one marked word."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        if piece and MARK not in piece[1:]:
            automaton.add_word(piece, (len(piece), score))
    if len(automaton):
        automaton.make_automaton()
    unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def count(word: str) -> int:
        n = len(word)
        score, tokens, strange = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = automaton.iter(word) if len(automaton) else iter(())
        end, piece = next(found, (n, None))
        for at in range(1, n + 1):
            best = None
            single = False
            # pieces with one end come longest first, that is by start
            while end == at - 1:
                length, s = piece
                total = s + score[at - length]
                if best is None or total > best:
                    best, number = total, tokens[at - length] + 1
                single = single or length == 1
                end, piece = next(found, (n, None))
            if not single:
                total = unknown + score[at - 1]
                if best is None or total > best:
                    best = total
                    strange[at] = True
                    if byte_fallback:
                        number = tokens[at - 1] + len(word[at - 1].encode())
                    else:
                        number = tokens[at - 1] + (not strange[at - 1])
            score[at], tokens[at] = best, number
        return tokens[n]

    return count


def count_tokens(
    docs: DataFrame, model: str = DEFAULT_MODEL, byte_fallback: bool = True,
    pieces: list[tuple[str, float]] | None = None,
) -> DataFrame:
    """doc_id, n_words and n_tokens of every row. ``pieces`` replaces the model file."""
    pieces = read_pieces(model) if pieces is None else pieces
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = "doc_id bigint, n_words bigint, n_tokens bigint"

    def run(batches):
        count = word_counter(shared.value, byte_fallback)
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                if len(known) > _CACHE:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = count(MARK + w.decode())
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)

"""Token counts (operator 8): trie-shared dynamic programming.

Counts the tokens of the best segmentation of every text under a unigram
model over a public vocabulary.  Each pre-token (a word between white space,
with the word mark in front) is segmented so that the sum of piece scores is
largest.  The distinct pre-tokens of a batch, in sorted order, are a trie
walked depth first: the forward scores (best score and token count up to each
character) of a prefix are computed once and shared by every pre-token that
continues it; a terminal's count is stored and multiplied by its occurrences.

The vocabulary is read by the sentencepiece library from the file's path; a
piece's unigram score is the negative logarithm of its rank (a Zipf law), an
unknown character costs ``UNKNOWN`` and counts as its UTF-8 bytes (byte
fallback).  Nothing is trained.  Ties prefer fewer tokens.

Rows are independent: no shuffle; a task holds one Arrow batch and a bounded
cache of counts.  Defined cases: null and empty texts count 0; repeated rows
each give their row; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docrevise.llm.common import col

MARK = "▁"
UNKNOWN = -20.0
#: Counts remembered by a task between batches.
CACHE = 300_000


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> unigram score."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): -math.log(i + 2) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        # ends: last character -> lengths of the pieces that end with it
        lens: dict[str, set[int]] = {}
        for p in pieces:
            lens.setdefault(p[-1], set()).add(len(p))
        self.lens = {c: sorted(x) for c, x in lens.items()}
        self.nodes = 0  # forward steps done, one per trie node

    def counts(self, words) -> dict[str, int]:
        """Tokens of the best segmentation of each distinct word."""
        out: dict[str, int] = {}
        path: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) after each character of the prefix
        prev = ""
        for word in sorted(set(words)):
            same, most = 0, min(len(prev), len(word))
            while same < most and prev[same] == word[same]:
                same += 1
            del path[same + 1:]
            for end in range(same + 1, len(word) + 1):
                path.append(self._step(word, end, path))
            out[word] = -path[-1][1]
            prev = word
        return out

    def _step(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -tokens) of ``word[:end]``: over the last piece."""
        self.nodes += 1
        c = word[end - 1]
        score, tokens = path[end - 1]
        best = (score + UNKNOWN, tokens - len(c.encode()))
        for n in self.lens.get(c, ()):
            if n > end:
                break
            s = self.pieces.get(word[end - n:end])
            if s is not None:
                score, tokens = path[end - n]
                best = max(best, (score + s, tokens - 1))
        return best


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens per row."""
    src = docs.select(col(id_col).alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = TrieCounter(vocabulary(vocabulary_path)), {}
        for b in batches:
            texts = [(t or "").split() for t in b.column(1).to_pylist()]
            seen = set().union(*texts)
            if len(known) + len(seen) > CACHE:
                known = {}
            new = trie.counts(MARK + w for w in seen if w not in known)
            known.update((w[1:], n) for w, n in new.items())
            totals = [sum(map(known.__getitem__, w)) for w in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(totals, pa.int64())],
                                             ["doc_id", "n_pretokens", "n_tokens"])
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")

"""Token counts under a unigram model, by dynamic programming on a trie of distinct pre-tokens.

Each task inserts its distinct pre-tokens in a trie. A node is a prefix and holds the forward
score of its best segmentation and the tokens in it; it is computed once, from its ancestors,
however many words share it. A word's count is the one of its terminal node. The trie is
started afresh beyond MAX_NODES nodes, which bounds memory and changes no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.llm.common import tune

MAX_NODES = 400_000
#: Marks the begin of a pre-token; log-probability of a byte of a character that no piece covers, below the least piece.
BEGIN, BYTE_PENALTY = "▁", 10.0


@dataclass(frozen=True)
class UnigramModel:
    scores: dict[str, float]

    @staticmethod
    def load(path: str) -> "UnigramModel":
        """From a sentencepiece model on the driver.

        Scores are its log-probabilities; a model of merges, whose scores are 0, -1, -2 ...
        by rank, gets those of Zipf's law, -log(rank + 2), instead.
        """
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        raw = {p.id_to_piece(i): p.get_score(i) for i in ids}
        ranked = all(s == int(s) for s in raw.values())
        return UnigramModel({k: -math.log(2 - s) if ranked else s for k, s in raw.items()})


class Trie:
    """Forward scores by prefix."""

    def __init__(self, model: UnigramModel):
        self.scores = model.scores
        # Ends of pieces with the piece's score, none where it is no piece: beyond an end that no piece has, no longer one is looked up.
        self.ends: dict[str, float | None] = dict.fromkeys(k[i:] for k in self.scores for i in range(1, len(k)))
        self.ends.update(self.scores)
        self.byte = min(self.scores.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # score, minus the number of tokens: ties take fewer tokens
        self.words: dict[str, int] = {}  # counts of finished words, without the mark

    def count(self, word: str) -> int:
        """Tokens of one pre-token (with its begin mark)."""
        if len(self.child) > MAX_NODES:
            self.clear()
        if len(word) > 10_000:
            return self._alone(word)
        child, best = self.child, self.best
        node, path = 0, [(0.0, 0)]
        for i, c in enumerate(word, 1):
            nxt = child[node].get(c)
            if nxt is None:
                nxt = len(child)
                child[node][c] = nxt
                child.append({})
                best.append(self._forward(word, i, path))
            node = nxt
            path.append(best[node])
        return -path[-1][1]

    def _forward(self, word: str, i: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        b = 1 if (c := word[i - 1]) < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        score, few = path[i - 1]
        score, few = score + b * self.byte, few - b
        ends = self.ends
        for j in range(i - 1, -1, -1):
            s = ends.get(word[j:i], False)
            if s is None:
                continue
            if s is False:
                break
            x, n = path[j]
            x += s
            if x > score or x == score and n - 1 > few:
                score, few = x, n - 1
        return score, few

    def _alone(self, word: str) -> int:
        """A very long pre-token shares no prefix worth keeping."""
        path = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            path.append(self._forward(word, i, path))
        return -path[-1][1]


def count_tokens(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs(doc_id, text, ...).

    Pre-tokens are the runs between Unicode white space, each with a begin mark; a character
    in no piece costs one token a byte. A null or empty text has 0 of both. Repeated rows
    repeat their counts, a null doc_id stays null, other columns are ignored.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie or Trie(held.value)
            n_words, n_tokens = [], []
            for t in batch.column(1):
                found = (t.as_py() or "").split()
                known = trie.words
                total = 0
                for w in found:
                    n = known.get(w)
                    if n is None:
                        n = trie.count(BEGIN + w)
                        known = trie.words
                        known[w] = n
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")

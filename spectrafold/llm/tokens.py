"""Token counts by a unigram model, computed on a trie of distinct pre-tokens.

A pre-token is a word with a leading mark for the white space before it. Its best
segmentation maximises the sum of piece scores; the forward recursion

    best(i) = max over pieces p ending at i of best(i - |p|) + score(p)

depends only on the prefix up to i. Distinct pre-tokens are therefore inserted in a trie and the
recursion runs once per trie node: pre-tokens that share a prefix share its scores, and the
number of tokens is stored where a pre-token ends. Texts then only look their words up.

The vocabulary is a sentencepiece model given by path; it is read, never trained. Its pieces
come in order of rank, from which the unigram scores follow (``zipf``). A character that no
piece covers costs its UTF-8 bytes as byte pieces.

One pass over the texts, no shuffle. The trie lives in the worker and is cleared when it
reaches ``max_nodes``, which bounds memory and changes no count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from spectrafold.llm.frames import mapped
from spectrafold.llm.words import PLAIN

MARK = "▁"
MAX_NODES = 500_000
LONG_WORD = 64  # characters; the rest of a longer word is counted outside the trie


def zipf(rank: int) -> float:
    """Log probability of a piece by its rank, up to a constant common to all pieces."""
    return -math.log(rank + 2.7) - 5.0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model and their unigram scores; special and byte pieces aside."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            out[model.id_to_piece(k)] = zipf(len(out))
    return out


class Trie:
    """Nodes of distinct pre-tokens with their forward score and token count."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.longest = max(map(len, pieces), default=1)
        self.byte = zipf(len(pieces))  # a byte piece ranks behind all others
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.ends: dict[str, int] = {}  # tokens of each pre-token inserted

    def step(self, word: str, i: int, score: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and its tokens for word[:i + 1], given those of all shorter prefixes.

        Of equally good segmentations the one with the longer last piece counts.
        """
        best, count, end = -math.inf, 0, i + 1
        get = self.pieces.get
        for begin in range(max(0, end - self.longest), end):
            if (s := get(word[begin:end])) is not None and (t := score[begin] + s) > best:
                best, count = t, tokens[begin] + 1
        if best == -math.inf:
            size = len(word[i].encode("utf-8", "surrogatepass"))
            best, count = score[i] + size * self.byte, tokens[i] + size
        return best, count

    def count(self, word: str) -> int:
        """Tokens of a pre-token."""
        held = self.ends.get(word)
        if held is None:
            held = self._insert(word)
            if len(word) <= LONG_WORD:
                if len(self.child) + len(self.ends) > self.max_nodes:
                    self.clear()
                self.ends[word] = held
        return held

    def _insert(self, word: str) -> int:
        node, score, tokens = 0, [0.0], [0]
        child, scores, counts = self.child, self.score, self.tokens
        for i, char in enumerate(word[:LONG_WORD]):
            after = child[node].get(char)
            if after is None:
                best, count = self.step(word, i, score, tokens)
                after = child[node][char] = len(child)
                child.append({})
                scores.append(best)
                counts.append(count)
            node = after
            score.append(scores[node])
            tokens.append(counts[node])
        for i in range(LONG_WORD, len(word)):
            best, count = self.step(word, i, score, tokens)
            score.append(best)
            tokens.append(count)
        return tokens[-1]


def count_tokens(
    docs: DataFrame, model: str, text: str = "text", max_nodes: int = MAX_NODES
) -> DataFrame:
    """``docs`` with n_words and n_tokens of each whole text.

    Words are divided by white space. A null or empty text has 0 of both. Columns with these
    names are replaced; rows are neither added nor lost.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def start():
        trie = Trie(pieces.value, max_nodes)

        def compute(texts):
            words = [(t or "").encode("utf-8", "surrogatepass").translate(PLAIN).split() for t in texts]
            # Sorted, so that neighbours share their prefix.
            distinct = sorted({w for own in words for w in own})
            held = {w: trie.count(MARK + w.decode("utf-8", "surrogatepass")) for w in distinct}
            return {
                "n_words": [len(own) for own in words],
                "n_tokens": [sum(map(held.__getitem__, own)) for own in words],
            }

        return compute

    return mapped(docs, "n_words long, n_tokens long", start, [text])

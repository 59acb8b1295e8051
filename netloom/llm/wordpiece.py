"""Token counts by a linear longest-match automaton.

The vocabulary has pieces that begin a word and pieces that continue one. Greedy longest match takes, from the left, the
longest piece each time. All pieces form one trie with two roots; every node has a failure link to the node of the text
that remains after the longest pieces are popped from its string, and the number of pieces popped. A word's length in
pieces is then found in one pass over its characters, without building any piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Shared, map_rows

VOCABULARY, BEGINS = "piece_bpe_32k.model", "▁"
#: Words whose counts a worker remembers, at least (twice that at most).
MEMO = 300_000


class Automaton:
    """``count(word)``: pieces of the greedy match, or 0 if some part of the word matches no piece (it is one unknown token)."""

    def __init__(self, begin: Iterable[str], follow: Iterable[str]):
        # Nodes 0 and 1 are the roots of words and of continuations.
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        depth = [0, 0]
        for root, words in ((0, begin), (1, follow)):
            for w in words:
                k = root
                for c in w:
                    if (n := self.next[k].get(c)) is None:
                        n = self.next[k][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        depth.append(depth[k] + 1)
                    k = n
                piece[k] = piece[k] or k > 1
        # Breadth first: a node's link follows from its parent's. -1: no piece can be popped.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            k = queue.popleft()
            for c, n in self.next[k].items():
                if piece[n]:
                    self.fail[n], self.popped[n] = 1, 1
                else:
                    f, pops = self.fail[k], self.popped[k]
                    while f >= 0 and c not in self.next[f]:
                        pops += self.popped[f]
                        f = self.fail[f]
                    if f >= 0:
                        self.fail[n], self.popped[n] = self.next[f][c], pops
                queue.append(n)

    def count(self, word: str) -> int:
        k, total, following, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            while (n := following[k].get(c)) is None:
                total += popped[k]
                k = fail[k]
                if k < 0:
                    return 0
            k = n
        while k != 1:
            if fail[k] < 0:
                return 0
            total += popped[k]
            k = fail[k]
        return total


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one; control, byte and unknown pieces are no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    return sorted({p[1:] for p in pieces if p.startswith(BEGINS) and len(p) > 1}), sorted({p for p in pieces if not p.startswith(BEGINS)})


def token_counts(docs: DataFrame, begin: Iterable[str], follow: Iterable[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""``doc_id, n_words, n_tokens, n_unknown`` for every row; words are ``[^\x20\x09-\x0D]+``.

    A word that can't be matched to its end is one unknown token. Null and empty texts have no words. Ids may be null or
    repeat; other columns are ignored. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    sent = Shared(docs.sparkSession, (sorted(set(begin)), sorted(set(follow))))  # bounded by the vocabulary

    def make():
        count = Automaton(*sent.value).count
        memo = Memo(lambda w: count(w.decode("utf-8", "surrogatepass")), MEMO)

        def rows(row):
            words = row["text"].encode("utf-8", "surrogatepass").split() if row["text"] else []
            counts = list(map(memo.__getitem__, words))
            unknown = counts.count(0)
            yield row["doc_id"], len(words), sum(counts) + unknown, unknown

        return rows

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")

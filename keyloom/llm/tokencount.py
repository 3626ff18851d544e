"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct pre-tokens.

A text's pre-tokens are its words (split at white space), each with the mark for a space before it. Its tokens are the pieces
of the most probable split of every pre-token: forward scores best[i] = max over pieces that end at i of best[i - len] +
log p(piece), ties to fewer tokens. The distinct pre-tokens are put in a trie; a node is a prefix, and its forward score is
computed once for all pre-tokens that share it; the node where a pre-token ends stores its count. Only new nodes cost
anything. The trie and the counts live in the worker, across batches and tasks, and are dropped at `NODES` nodes.

The vocabulary is a tokenizer file (a parameter), read on the driver and broadcast: a few ten thousand pieces. Files of rank
vocabularies hold no probabilities; by Zipf's law p is put in proportion to 1 / rank. A character that no piece covers costs
its UTF-8 bytes, one token each.

Defined cases: null and blank texts have 0 pre-tokens and 0 tokens; null or repeated ids are rows like any other; a pre-token
of any length is scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from keyloom.llm.common import picked, texts_of

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NODES = 1_500_000


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> log probability, from a SentencePiece file; control and byte pieces aren't text."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [held.id_to_piece(k) for k in range(held.get_piece_size()) if not (held.is_control(k) or held.is_unknown(k) or held.is_byte(k))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(r + 1) - norm for r, piece in enumerate(pieces)}


class Trie:
    """Forward scores by prefix."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.limit = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.floor = min(pieces.values(), default=0.0) - 1.0  # for a byte
        self._clear()

    def _clear(self) -> None:
        #: Prefix -> (score, -tokens) of its best split; the trie's nodes, by the path to them.
        self.best: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        self.ends: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token; the mark is put before it."""
        held = self.ends.get(word)
        if held is not None:
            return held
        if len(self.best) >= self.limit:
            self._clear()
        path = MARK + word
        if len(path) > 256:  # its nodes wouldn't be shared: score it by itself, with a window of states
            held = self._alone(path)
            if len(self.ends) < self.limit:
                self.ends[word] = held
            return held
        best, known = self.best, len(path)
        while path[:known] not in best:
            known -= 1
        states = [best[path[:k]] for k in range(known + 1)] if known < len(path) else None
        for end in range(known + 1, len(path) + 1):
            state = self._state(path, end, states)
            states.append(state)
            best[path[:end]] = state
        self.ends[word] = held = -best[path][1]
        return held

    def _state(self, path: str, end: int, states: list[tuple[float, int]]) -> tuple[float, int]:
        pieces = self.pieces
        out = None
        for start in range(max(0, end - self.longest), end):
            p = pieces.get(path[start:end])
            if p is not None:
                score, n = states[start]
                here = (score + p, n - 1)
                if out is None or here > out:
                    out = here
        if path[end - 1] not in pieces:
            n_bytes = len(path[end - 1].encode("utf-8", "surrogatepass"))
            score, n = states[end - 1]
            here = (score + n_bytes * self.floor, n - n_bytes)
            if out is None or here > out:
                out = here
        return out

    def _alone(self, path: str) -> int:
        states = [(0.0, 0)]
        for end in range(1, len(path) + 1):
            states.append(self._state(path, end, states))
        return -states[-1][1]


#: A worker's trie, by the digest of its vocabulary; one at a time.
_HELD: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_distinct, n_tokens."""
    pieces = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = xxhash.xxh3_128_hexdigest(repr(list(pieces.items())).encode("utf-8", "surrogatepass"))  # not the path: its file may change
    rows = picked(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keyloom.llm import tokencount

        trie = tokencount._HELD.get(key)
        if trie is None:
            tokencount._HELD.clear()
            trie = tokencount._HELD[key] = tokencount.Trie(shared.value)
        for batch in batches:
            total, distinct, tokens = [], [], []
            for text in texts_of(batch.column(1)):
                words = Counter(text.split()) if text else {}
                total.append(sum(words.values()))
                distinct.append(len(words))
                tokens.append(sum(n * trie.count(w) for w, n in words.items()))
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, distinct, tokens))], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_distinct long, n_tokens long")

"""Token counts (9): trie-shared dynamic programming over distinct pre-tokens.

A text's pre-tokens are its white-space separated words, each with a word mark in front. A pre-token's tokens are its
best segmentation into pieces of a unigram vocabulary (greatest sum of scores; on ties fewer pieces). The forward
scores of a pre-token depend on its prefixes only, so distinct pre-tokens are put in a trie whose nodes hold the
best score and piece count of their prefix: what words share is computed once, and a terminal's count is kept.
Occurrences are then lookups. A character that no piece has costs one byte piece for each of its UTF-8 bytes.

The vocabulary is the piece list of a public tokenizer, read on the driver from a path and broadcast (tens of
thousands of entries, fixed). Its scores are a fixed function of the piece's rank, as published ranks come
from merges and not from a unigram model; nothing is trained here.

Defined results: a null or empty text has no pre-tokens; repeated rows are counted alike; an empty table gives an
empty result; pre-tokens above LONG characters are scored without being put in the trie; the trie is
started over beyond NODES nodes, which changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_least_parallel

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 128
NODES = 1_500_000
#: Added to a rank before its logarithm is taken; common pieces then differ little.
RANK_SHIFT = 100


def pieces_of(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of a SentencePiece model's ordinary pieces: minus the logarithm of the shifted rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return {model.id_to_piece(i): -log(i + RANK_SHIFT) for i in range(model.get_piece_size()) if not special(i)}


class Trie:
    """Prefixes of the pre-tokens seen. Nodes are numbers; children, scores and piece counts are flat tables, so that
    the garbage collector has nothing to walk."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES) -> None:
        self.pieces = pieces
        self.byte = min(pieces.values(), default=-1.0) - 1.0
        self.limit = nodes
        self.counts: dict[str, int] = {}
        ends: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: Last two characters -> lengths of the pieces that end with them.
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.scores, self.used = [0.0], [0]
        self.counts.clear()

    def _extend(self, word: str, end: int, path: list[int]) -> None:
        """Appends the best (score, pieces) of word[:end], given those of its prefixes; path has their numbers."""
        scores, used, get = self.scores, self.used, self.pieces.get
        ch, last = word[end - 1], path[-1]
        own = get(ch)
        if own is None:
            n = len(ch.encode("utf-8", "surrogatepass"))
            score, count = scores[last] + self.byte * n, used[last] + n
        else:
            score, count = scores[last] + own, used[last] + 1
        for length in self.lengths.get(word[end - 2 : end], ()) if end > 1 else ():
            if length > end:
                break
            piece = get(word[end - length : end])
            if piece is not None:
                before = path[end - length]
                total = scores[before] + piece
                if total > score or (total == score and used[before] + 1 < count):
                    score, count = total, used[before] + 1
        scores.append(score)
        used.append(count)

    def count(self, word: str) -> int:
        """Pieces in the best segmentation of the pre-token."""
        got = self.counts.get(word)
        if got is not None:
            return got
        if len(word) <= LONG and len(self.scores) > self.limit:
            self.clear()
        path, node, kept = [0], 0, len(self.scores)
        for end, ch in enumerate(word, 1):
            key = node * 0x110000 + ord(ch)
            child = self.children.get(key) if len(word) <= LONG else None
            if child is None:
                child = len(self.scores)
                self._extend(word, end, path)
                if len(word) <= LONG:
                    self.children[key] = child
            path.append(child)
            node = child
        out = self.used[node]
        if len(word) > LONG:
            del self.scores[kept:], self.used[kept:]
        else:
            self.counts[word] = out
        return out


_TRIES: dict[str, Trie] = {}


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and n_bytes of every row."""
    shared, name = docs.sparkSession.sparkContext.broadcast(pieces_of(path)), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TRIES:  # kept between the tasks of a worker
            _TRIES.clear()
            _TRIES[name] = Trie(shared.value)
        trie = _TRIES[name]
        for batch in batches:
            words_n, tokens_n = [], []
            for text in batch.column(1):
                words = [MARK + w for w in (text.as_py() or "").split()]
                get, counts = trie.counts.get, 0
                for w in words:
                    n = get(w)
                    counts += trie.count(w) if n is None else n
                words_n.append(len(words))
                tokens_n.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_n, pa.int64()), pa.array(tokens_n, pa.int64()), batch.column(2)], names=["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return at_least_parallel(narrow).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, n_bytes long")

"""Operator 3: token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted.

Symbols are a doubly linked list over the characters of a chunk; a heap holds the mergeable adjacent
pairs by rank, then place. Each pop that still stands merges one pair, so the count is the initial
symbols less the merges. A character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rallyline.llm.common import KEPT, Recent, map_blocks, text_rows, texts_of

MARK = "▁"  # stands for a space in the vocabulary
CACHE_ENTRIES = 400_000


class _Costs(dict):
    """Tokens of a lone character: 1 in the vocabulary, else its UTF-8 bytes."""

    def __init__(self, rank: dict[str, int]):
        super().__init__((c, 1) for c in rank if len(c) == 1)

    def __missing__(self, char: str) -> int:
        return len(char.encode())


class PieceCounter:
    """Counts tokens as a BPE model file of the sentencepiece library does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): rank for rank, i in enumerate(by_score)}
        inner = {(a, b) for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}
        self._cost = _Costs(self.rank).__getitem__
        self._known = Recent(CACHE_ENTRIES)
        self._chunks = None
        if not any(b == MARK != a or "\n" in (a, b) for a, b in inner):
            # Signs that no piece has right behind a word character: a chunk can end before them.
            follow = {b for a, b in inner if a.isalnum() or a == "_"}
            signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not (c.isalnum() or c == "_" or c in follow))
            self._chunks = re.compile(rf"{MARK}*\w+(?=[\n{MARK}{signs}]|\Z)|{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def count(self, texts: list[str]) -> list[int]:
        parts = [self._split(t) for t in texts]
        self._known.turn()
        new = self._known.missing(set().union(*parts))
        known = self._known.now
        known.update(zip(new, map(self._count, new), strict=True))
        return [sum(map(known.__getitem__, part)) for part in parts]

    def _split(self, text: str) -> list[str]:
        """Pieces of a text across whose borders nothing merges."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self._chunks.findall(marked) if self._chunks else [marked]

    def _count(self, chunk: str) -> int:
        rank, n = self.rank.get, len(chunk)
        left = sum(map(self._cost, chunk))
        place, width = n.bit_length(), 2 * n.bit_length()  # a heap entry is rank, place and length in one number
        low = (1 << place) - 1
        heap = [r << width | i << place | 2 for i, r in enumerate(map(rank, map(add, chunk, chunk[1:]))) if r is not None]
        heapify(heap)
        size = [1] * n + [0]  # of the symbol that begins here; 0 once it is merged away
        before = list(range(-1, n))
        while heap:
            pair = heappop(heap)
            i, total = pair >> place & low, pair & low
            if (own := size[i]) == total or not own or own + size[i + own] != total:
                continue  # one of the two has merged with another since
            size[i], size[i + own] = total, 0
            left -= 1
            end = i + total
            if end < n:
                before[end] = i
                if (r := rank(chunk[i : end + size[end]])) is not None:
                    heappush(heap, r << width | i << place | total + size[end])
            if i and (r := rank(chunk[before[i] : end])) is not None:
                heappush(heap, r << width | before[i] << place | end - before[i])
        return left


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


KEPT["counts"] = piece_counter.cache_clear


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, in one pass and without a shuffle.

    Null and empty texts have no bytes and no tokens. Rows are counted one by one: repeated rows and null
    ids each give a row, an empty table gives none, and further columns are left out. The whole text counts,
    however long.
    """
    path = path or default_vocabulary()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        n = np.array(piece_counter(path).count(texts_of(batch)), np.int64)
        return pa.record_batch([batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_blocks(text_rows(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "counts")

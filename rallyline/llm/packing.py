"""Operator 9: hierarchical multi-length packing.

A document's tokens are cut into windows of the longest tier; a piece that is left goes to the shortest tier that holds
two of it. Each tier is packed with pieces that fill a sequence to its end without a cut: best fit, ending in one piece
or two of just the length that is missing. Half of each shorter tier's pieces may fill the gaps of longer windows. Where
nothing fits a window of the longest tier, the rest of a long document, cut already, is cut again; a document that fits
whole is cut only among the last pieces of a task. So every sequence is exactly as long as its tier, but for a task's
last tokens, which become sequences of smaller powers of two. Sequences in order of length are dealt to step groups of
equal tokens over all tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.bpe import byte_bpe, default_vocabulary
from rallyline.llm.common import map_arrow, text_rows, texts_of
from rallyline.llm.text import slices
from rallyline.session import settle

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, number long"


@dataclass(frozen=True)
class Tiers:
    """Sequence lengths, powers of two; tokens of a step group, a multiple of them; and how many loose pieces a task
    holds before it packs half of them."""

    lengths: tuple[int, ...] = (256, 512, 1024, 2048)
    step_tokens: int = 16_384
    held_pieces: int = 4096
    end_id: int = 1


@dataclass(frozen=True)
class Piece:
    """Some tokens of a document, four bytes each; whole if they are all of them."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def whole(self) -> bool:
        return len(self) == self.doc_tokens

    def split(self, at: int) -> tuple[Piece, Piece]:
        parts = (self.start, self.ids[: 4 * at]), (self.start + at, self.ids[4 * at :])
        return tuple(Piece(self.doc_id, start, ids, self.doc_tokens) for start, ids in parts)


class Pool:
    """Loose pieces by length, whole documents apart from cut ones."""

    def __init__(self, window: int):
        self.whole: list[list[Piece]] = [[] for _ in range(window + 1)]
        self.cut: list[list[Piece]] = [[] for _ in range(window + 1)]
        self.have = np.zeros(window + 1, np.int64)  # by length
        self.n = self.tokens = 0

    def put(self, piece: Piece) -> None:
        if n := len(piece):
            (self.whole if piece.whole else self.cut)[n].append(piece)
            self._count(n, 1)

    def take(self, n: int, cut: bool = False) -> Piece:
        """A piece of that length: a whole document if there is one, unless it is to be cut."""
        lots = (self.cut, self.whole) if cut else (self.whole, self.cut)
        self._count(n, -1)
        return next(lot for lot in (lots[0][n], lots[1][n]) if lot).pop()

    def _count(self, n: int, by: int) -> None:
        self.have[n] += by
        self.n += by
        self.tokens += n * by

    def longest(self, above: int = 0, only_cut: bool = False) -> int:
        """The greatest length above that of a piece, 0 if there is none."""
        found = (n for n in range(len(self.have) - 1, above, -1) if (self.cut[n] if only_cut else self.have[n]))
        return next(found, 0)


def fitting(gap: int, free: np.ndarray) -> list[int] | None:
    """Lengths of pieces that fill a gap to its end, taken from free; None, and free as it was, if none were found.

    Always the longest that fits, until one or two of just the right length end it.
    """
    out: list[int] = []
    while gap:
        some = free[1:gap] > 0
        pairs = some & some[::-1]
        if gap % 2 == 0 and free[gap // 2] < 2:
            pairs[gap // 2 - 1] = False
        if free[gap] > 0:
            chosen = [gap]
        elif pairs.any():
            first = gap - 1 - int(np.argmax(pairs[::-1]))
            chosen = [first, gap - first]
        elif some.any():
            chosen = [gap - 1 - int(np.argmax(some[::-1]))]
        else:
            np.add.at(free, out, 1)
            return None
        np.subtract.at(free, chosen, 1)
        out += chosen
        gap -= sum(chosen)
    return out


class Packer:
    """Packs the documents of one task; rows() takes what is ready."""

    def __init__(self, tiers: Tiers, task: int):
        self.tiers, self.task, self.window = tiers, task, tiers.lengths[-1]
        self.pool, self.by_tier, self.out, self.made = Pool(self.window), Counter(), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        size = len(ids) // 4
        full = size - size % self.window
        for at in range(0, full, self.window):
            self._emit([Piece(doc_id, at, ids[4 * at : 4 * (at + self.window)], size)])
        self.pool.put(Piece(doc_id, full, ids[4 * full :], size))
        if self.pool.n >= self.tiers.held_pieces:
            self._round(0.5)
            while self.pool.n > 0.75 * self.tiers.held_pieces and self.pool.tokens >= self.window:
                self._force(self.window)

    def finish(self) -> None:
        self._round(0.0)
        while self.pool.n:
            self._force(min(1 << (self.pool.tokens.bit_length() - 1), self.window))

    def _own(self, tier: int) -> tuple[int, int]:
        """Least and greatest length of the pieces that belong to a tier."""
        shorter = [t for t in self.tiers.lengths if t < tier]
        return (shorter[-1] // 2 + 1 if shorter else 1), (tier if tier == self.window else tier // 2)

    def _round(self, keep: float) -> None:
        """Pack every tier; half the pieces of a shorter one, at most, go into gaps of all longer ones."""
        own = self.pool.have // 2
        own[::2] += self.pool.have[::2] % 2
        for tier in reversed(self.tiers.lengths):
            self._pack(tier, own, keep)

    def _pack(self, tier: int, reserved: np.ndarray, keep: float) -> None:
        """Sequences of a tier without a cut of whole documents, longest pieces first, until only that share of its own
        pieces is left. Those that find no fellows stay in the pool."""
        least, most = self._own(tier)
        free = self.pool.have.copy()
        free[most + 1 :] = 0
        free[1:least] = np.maximum(free[1:least] - reserved[1:least], 0)
        left = keep * free[least:].sum()
        for n in range(most, least - 1, -1):
            while free[n] > 0 and free[least:].sum() > left:
                free[n] -= 1
                if (others := fitting(tier - n, free)) is not None:
                    self._emit([self.pool.take(k) for k in (n, *others)])
                elif tier == self.window and self.pool.longest(tier - n, only_cut=True) > tier - n:
                    opener = self.pool.take(n)
                    if not (cut := self.pool.longest(tier - n, only_cut=True)):
                        self.pool.put(opener)
                        break
                    head, rest = self.pool.take(cut, cut=True).split(tier - n)
                    self.pool.put(rest)
                    self._emit([opener, head])
                    free[cut] = max(free[cut] - 1, 0)
                else:
                    break

    def _force(self, tier: int) -> None:
        """One sequence whatever has to be cut."""
        chosen, gap = [], tier
        while gap:
            fits = np.flatnonzero(self.pool.have[: gap + 1])
            if len(fits):
                chosen.append(self.pool.take(int(fits[-1])))
            else:
                longest = self.pool.longest(gap, only_cut=True) or self.pool.longest(gap)
                head, rest = self.pool.take(longest, cut=True).split(gap)
                self.pool.put(rest)
                chosen.append(head)
            gap -= len(chosen[-1])
        self._emit(chosen)

    def _emit(self, pieces: list[Piece]) -> None:
        tier, offset = sum(map(len, pieces)), 0
        for p in pieces:
            self.out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.task << 32 | self.made, offset, tier, self.task, self.by_tier[tier]))
            offset += len(p)
        self.by_tier[tier] += 1
        self.made += 1

    def rows(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
        columns = zip(*self.out, strict=True) if self.out else [[]] * len(types)
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        self.out = []
        return batch


def pieces(docs: DataFrame, path: str, tiers: Tiers) -> DataFrame:
    """PIECES of all documents; each task packs its own rows, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, TaskContext.get().partitionId())
        end = tiers.end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole):
                ids = byte_bpe(path).encode(texts_of(batch))
                for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    packer.add(doc_id, own + end)
                yield packer.rows()
        packer.finish()
        yield packer.rows()

    return map_arrow(text_rows(docs), run, PIECES, "bpe")


def pack(docs: DataFrame, path: str | None = None, tiers: Tiers = Tiers()) -> DataFrame:
    """One row per piece of a document's tokens, the end token being the last: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, tier, step_group.

    Sequences hold pieces from offset 0 without gaps and are of a tier's length, or, a few at the end of each
    task, of a smaller power of two, so nothing is padded. Sequences from the longest on are dealt to step groups of
    just tiers.step_tokens tokens each, only the very last one has fewer; all but the groups where one length ends and
    the next begins hold one length. A null or empty text is one end token. Rows are documents, each packed once, also
    if repeated or without doc_id. No rows give none. Texts are not shuffled; of the narrow result only counts a task
    and length are brought together. A task's number is the high half of its sequences' ids.
    """
    rows = settle(pieces(docs, path or default_vocabulary(), tiers))
    counts = rows.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("n"))
    # A row a task and length: the sequences of the lengths before it and of its own in earlier tasks come first.
    longer = counts.groupBy("tier").agg(F.sum("n").alias("n"))
    longer = longer.select("tier", (F.sum(F.col("n") * F.col("tier")).over(Window.orderBy(F.desc("tier"))) - F.col("n") * F.col("tier")).alias("before"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(longer, "tier")
    first = first.select("task", "tier", (F.col("before") + F.col("earlier") * F.col("tier")).alias("first"))
    group = F.floor((F.col("first") + F.col("number") * F.col("tier")) / tiers.step_tokens).cast("long")
    return rows.join(first, ["task", "tier"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group"))

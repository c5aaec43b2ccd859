"""Operator 2: byte-level BPE encoding and decoding by segment trees over adjacent pair ranks.

A pre-token's leaves hold (rank, position) of the pair that begins at each symbol, its inner nodes the
smaller child, so the root is the leftmost lowest-rank merge. A merge changes at most three leaves and
their paths to the root. Pre-tokens of one width are merged side by side, one array row each; very wide
ones one at a time. Results are kept by pre-token in a bounded table, since words recur.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rallyline.llm.common import KEPT, Recent, map_arrow, map_blocks, text_rows, texts_of

#: The published pre-tokenisation pattern of byte-level BPE, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"

NO_PAIR = np.int64(1) << 62
SIGNS = b".,;:!?*$%&#|()"  # none of which is a letter, a number or an apostrophe
WIDEST_ROW = 64
CACHE_ENTRIES = 300_000


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in the vocabulary file."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        value = {c: b for b, c in letters.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.specials).items()}
        self.pieces = [
            bytes(value[c] for c in names[i]) if i in names and all(c in value for c in names[i]) else names.get(i, "").encode()
            for i in range(max(names) + 1)
        ]
        # No pre-token goes across the borders of these, so their ids can be kept too.
        self._chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self._pattern = regex.compile(PATTERN)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._known = Recent(CACHE_ENTRIES)
        self.first_ranks = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))  # of pairs of bytes

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(list(map(len, raw)), out=at[1:])
        odd = {int(i) for i in np.searchsorted(at, _wide_white(data), "right") - 1}
        if self._special:
            odd.update(i for i, t in enumerate(texts) if self._special.search(t))
        if odd:
            plain = [i for i in range(len(texts)) if i not in odd]
            out = [b""] * len(texts)
            for i, ids in zip(plain, self.encode([texts[i] for i in plain]) if plain else [], strict=True):
                out[i] = ids
            for i in odd:
                out[i] = self._encode_odd(texts[i])
            return out
        bounds = np.append(_chunk_starts(data, at), len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        known = self._learn(_parts(chunks.dictionary))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), "<u4")
        which = chunks.indices.to_numpy()
        n = size[which]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        first = (np.cumsum(size) - size)[which] - ends[:-1]
        ids = table[np.arange(ends[-1]) + np.repeat(first, n)].tobytes()
        cut = (4 * ends[np.searchsorted(bounds[:-1], at)]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _encode_odd(self, text: str) -> bytes:
        """Ids of a text with special tokens or with white space beyond ASCII."""
        out = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                out += self._learn([c.encode() for c in self._chunks.findall(part)])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def _split(self, chunk: bytes) -> list[bytes]:
        """The pre-tokens of a chunk; those of a plain word, with or without signs behind it, without the pattern."""
        stem = chunk.rstrip(SIGNS)
        if (stem[1:] if stem[:1] == b" " else stem).isalpha():  # of ASCII letters
            return [stem, chunk[len(stem) :]] if len(stem) < len(chunk) else [chunk]
        return [t.encode() for t in self._pattern.findall(chunk.decode())]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of every chunk; they are kept, and so are those of the pre-tokens of chunks that have several."""
        self._known.turn()
        new = list(self._known.missing(set(chunks)))
        split = list(map(self._split, new))
        known = self._known.now
        several = [(chunk, s) for chunk, s in zip(new, split, strict=True) if len(s) > 1]
        unseen = self._known.missing({t for _, s in several for t in s})
        unseen.update(s[0] for s in split if len(s) == 1)
        unseen = list(unseen)
        known.update(zip(unseen, self._merge(unseen), strict=True))
        for chunk, s in several:
            known[chunk] = b"".join([known[t] for t in s])
        return list(map(known.__getitem__, chunks))

    def _merge(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_width.setdefault(1 << max(len(word) - 1, 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            if width > WIDEST_ROW:
                for i in rows:
                    out[i] = self._merge_one(words[i], width)
            else:
                for first in range(0, len(rows), 8192):
                    some = rows[first : first + 8192]
                    for i, ids in zip(some, self._merge_rows([words[i] for i in some], width), strict=True):
                        out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_PAIR where they do not merge; negative symbols never do."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR)

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """All arrays are flat: word r has its symbols and links from r * (width + 1), its tree from r * 2 * width."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        slot, step, none = np.arange(width), width + 1, int(NO_PAIR)
        symbols = np.full((n, step), -1, np.int64)  # the last place of a word stands for no symbol
        symbols[:, :width][slot < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, step + 1, dtype=np.int16), (n, 1))
        after[np.arange(n), sizes - 1] = width
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), none, np.int64)
        raw = np.zeros((n, width), np.int64)
        raw[slot < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ranks = np.where(slot[1:] < sizes[:, None], self.first_ranks.take(raw[:, :-1] << 8 | raw[:, 1:]), none)
        tree[:, width : 2 * width - 1] = np.where(ranks < none, ranks * width + slot[:-1], none)
        at = width
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        symbols, after, before, tree = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree.take(rows * (2 * width) + 1)
            rows, root = rows[root < none], root[root < none]
            if not len(rows):
                break
            rank, place = root // width, root % width
            base, top = rows * step, rows * (2 * width)
            gone = after.take(base + place)
            beyond, left = after.take(base + gone), before.take(base + place)
            joined = self.merged.take(rank)
            symbols[base + place], symbols[base + gone] = joined, -1
            after[base + place], before[base + beyond] = beyond, place
            right_rank = self._rank(joined, symbols.take(base + beyond))
            left_rank = self._rank(np.where(left < width, symbols.take(base + left), -1), joined)
            left = np.where(left < width, left, place)  # without a left neighbour the path of place is walked twice
            tree[top + width + gone] = none
            tree[top + width + left] = np.where(left_rank < none, left_rank * width + left, none)
            tree[top + width + place] = np.where(right_rank < none, right_rank * width + place, none)
            for leaf in (gone, place, left):
                node = (leaf.astype(np.int64) + width) >> 1
                while node[0]:
                    child = top + 2 * node
                    tree[top + node] = np.minimum(tree.take(child), tree.take(child + 1))
                    node >>= 1
        symbols = symbols.reshape(n, step)[:, :width]
        keep = symbols >= 0
        ids, ends = symbols[keep].astype("<u4").tobytes(), 4 * np.cumsum(keep.sum(1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_one(self, word: bytes, width: int) -> bytes:
        """The same tree over plain lists, for a pre-token too wide to share an array with others."""
        n, none, rank_of, merged = len(word), int(NO_PAIR), self.rank_of, self.merged
        symbols = [*self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), -1]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        before[0] = n

        def leaf(i: int) -> int:
            rank = rank_of.get(symbols[i] << 20 | symbols[after[i]]) if symbols[i] >= 0 and symbols[after[i]] >= 0 else None
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        tree[width : width + n] = map(leaf, range(n))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, place = divmod(tree[1], width)
            gone = after[place]
            beyond, left = after[gone], before[place]
            symbols[place], symbols[gone] = int(merged[rank]), -1
            after[place], before[beyond] = beyond, place
            for i in (gone, place, left):
                if i < n:
                    tree[node := width + i] = leaf(i)
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()


#: White space of one byte, and Unicode's other white space by its first byte.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), 0x20]] = True
_WIDE_WHITE = {
    0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE3: (b"\x80\x80",),
    0xE2: (*(bytes((0x80, k)) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"),
}


def _wide_white(data: np.ndarray) -> np.ndarray:
    """Where white space of more than one byte begins."""
    found = []
    for lead, tails in _WIDE_WHITE.items():
        at = np.flatnonzero(data == lead)
        if len(at):
            two = len(tails[0]) == 2
            rest = data[at + 1].astype(np.int64) << 8 | data[at + 2] if two else data[at + 1]
            found.append(at[np.isin(rest, [int.from_bytes(t, "big") for t in tails])])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of texts without wide white space begin: a word with the blank before it, the white space before
    that, and any other single white character before a word."""
    white = _WHITE[data]
    start = np.zeros(len(data), bool)
    if len(data):
        start[1:] = (white[1:] & ~white[:-1]) | (~white[1:] & white[:-1] & (data[:-1] != 0x20))
        last = np.zeros(len(data), bool)  # white, before a word of the same text
        last[:-1] = white[:-1] & ~white[1:]
        last[at[1:][at[1:] > 0] - 1] = False
        start[1:] |= last[1:] & white[:-1]
        start[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(start)


def _parts(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column that begins at its buffers' beginning."""
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One vocabulary a worker process and path."""
    return ByteBPE(path)


KEPT["bpe"] = byte_bpe.cache_clear


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs; a null text has no ids.

    Rows with the same doc_id or a null one are each encoded; other columns of docs are left out. Whole
    texts are encoded, whatever their length; strings of special tokens inside texts become those tokens.
    """
    path = path or default_vocabulary()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in byte_bpe(path).encode(texts_of(batch))]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
        return pa.record_batch([batch.column("doc_id"), values], ["doc_id", "ids"])

    return map_blocks(text_rows(docs), work, "doc_id long, ids array<int>", "bpe")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none."""
    path = path or default_vocabulary()

    def run(batches):
        for batch in batches:
            texts = [byte_bpe(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string", "bpe")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every row's ids and of the text decoded from them, in one pass and without a shuffle.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts give 0 tokens and the digest
    of nothing; rows are treated one by one, so repeated ones each give a row, and no rows give none.
    """
    path = path or default_vocabulary()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(path)
        counts, ids_sha, text_sha = [], [], []
        for packed in bpe.encode(texts_of(batch)):
            ids = np.frombuffer(packed, "<u4").tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_blocks(text_rows(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")

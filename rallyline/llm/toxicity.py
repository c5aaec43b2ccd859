"""Operator 8: toxicity of deobfuscated text.

A character language model (trigrams over all documents) and a channel that swaps letters for look-alikes,
stretches them and spaces them out give each doubtful token a lattice of what it may have been; Viterbi decoding
restores the likeliest. A hashed logistic regression scores the words of the restored text. A token that has no
look-alike beside two other letters or look-alikes, no run of letters and no spaced-out letters is left as is; so is
one of digits alone, a number. Tokens are decoded whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm import linear
from rallyline.llm.common import map_arrow, text_rows
from rallyline.llm.text import Block, mix, slices

SETTINGS = linear.Settings(max_rows=10_000, alpha=1.0, l1=8.0, epochs=8)
#: Letters that signs and digits commonly stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Letters beyond ASCII that look like one of it though Unicode does not decompose them to it.
WIDE_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "uy", "ѵ": "v", "ԝ": "w", "х": "x", "ь": "b", "и": "un",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "os", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "b", "ħ": "h", "ŧ": "t",
}
SYMBOLS = 28  # 0 a border (anything but letters), 1 to 26 a to z, 27 a byte beyond ASCII
SWAP, STRETCH, JOIN, BORDER, NUMBER = -1.0, -0.7, -0.5, -3.0, -12.0  # log chances of the channel, by what it did
KNOWN_LENGTH = 64  # of tokens whose decoding is kept
HEADS = (4, 7)
KNOWN_ENTRIES = 300_000

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_LETTER = _CODE > 0
_LIKE = np.zeros(256, bool)
_LIKE[[ord(c) for c in LOOKALIKES]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LINK = np.zeros(256, bool)
_LINK[list(b".-_*~+/")] = True
_CHAIN = re.compile(r"[^\W_](?:[.\-_*~+/]+[^\W_]){2,}")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: how often each of the 28^3 trigrams occurs in all texts; a border hides what is before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for whole in batches:
            for batch in slices(whole):
                total += np.bincount(_trigrams(Block(batch.column("text"))), minlength=SYMBOLS**3)
        gram = np.flatnonzero(total)
        yield pa.record_batch([pa.array(gram), pa.array(total[gram])], ["gram", "n"])

    return map_arrow(text_rows(docs), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _trigrams(block: Block) -> np.ndarray:
    code = np.zeros(len(block.raw) + block.n + 2, np.int64)  # a border before every text, two before the first
    place = np.arange(len(block.raw)) + np.repeat(np.arange(block.n), np.diff(block.at)) + 2
    code[place] = _CODE[block.raw]
    first, second, third = code[:-2], code[1:-1], code[2:]
    first = np.where(second == 0, 0, first)
    keep = (second > 0) | (third > 0)
    return (first * SYMBOLS + second)[keep] * SYMBOLS + third[keep]


@dataclass(frozen=True)
class Letters:
    """Log chances of a symbol after two others, smoothed with those after one and after none."""

    log: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int]) -> Letters:
        n = np.zeros(SYMBOLS**3)
        for gram, times in counts.items():
            n[gram] = times
        n = n.reshape((SYMBOLS,) * 3)
        one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
        two = (n.sum(0) + 2 * one) / (n.sum((0, 2))[:, None] + 2)
        three = (n + 2 * two[None]) / (n.sum(2, keepdims=True) + 2)
        return cls(np.log(three))


@lru_cache(maxsize=1 << 16)
def meant_by(char: str) -> str | None:
    """The letters that a character beyond ASCII may stand for: none for a sign that is not seen, None if it is no
    look-alike."""
    if (found := WIDE_LOOKALIKES.get(char)) is not None:
        return found
    if unicodedata.combining(char) or unicodedata.category(char) == "Cf":
        return ""
    base = unicodedata.normalize("NFKD", char)[0].lower()
    return base if "a" <= base <= "z" else WIDE_LOOKALIKES.get(base)


#: First bytes of characters beyond ASCII other than accented letters of Latin scripts and the usual marks.
_STRANGE = np.zeros(256, bool)
_STRANGE[[*range(0xC6, 0xE0), 0xE1, *range(0xEF, 0xF5)]] = True
#: By first (0xC3 to 0xC5) and second byte of a letter, the ASCII letter that it has an accent on, or 0.
_UNACCENTED = np.zeros((3, 256), np.uint8)
for _point in range(0xC0, 0x180):
    _UNACCENTED[(_point >> 6) - 3, 0x80 | _point & 0x3F] = ord((meant_by(chr(_point).lower()[0]) or "\0")[0])


class Restorer:
    """Viterbi decoding of doubtful tokens; answers are kept in a bounded table."""

    def __init__(self, letters: Letters):
        self.log = letters.log.tolist()
        self.known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        if (found := self.known.get(token)) is None:
            if len(self.known) > KNOWN_ENTRIES:
                self.known.clear()
            found = self.decode(token)
            if len(token) <= KNOWN_LENGTH:
                self.known[token] = found
        return found

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each place what it may have been, with the channel's log chance; ' ' is a border."""
        token = unicodedata.normalize("NFKC", token).lower()  # wide and mathematical letters are the letters themselves
        linked = " " in token or bool(_CHAIN.fullmatch(token))
        places: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"(.)\1*", token, re.DOTALL):
            char, times = m[1], len(m[0])
            meant = LOOKALIKES.get(char, "") if char not in "!|+" or m.end() < len(token) else ""
            wide = None if char.isascii() else meant_by(char)
            if wide == "":
                places.append([("", 0.0)])
                continue
            letters = [(char, 0.0)] if char.isalpha() else []
            letters += [(c, SWAP) for c in wide or meant]
            options = [(c * k, cost + (0.0 if k == times else STRETCH)) for c, cost in letters for k in ({1, 2, times} if times > 1 else {times})]
            if not char.isalpha():
                meant = meant or wide
                options.append((" ", NUMBER if char.isdigit() and meant else BORDER if meant or linked else 0.0))
                if char in ".-_*~+/ ":
                    options.append(("", JOIN if linked or char == " " else BORDER))
            places.append(options)
        return places

    def decode(self, token: str) -> str:
        """The likeliest path through the lattice, in time and memory that grow with the token's length alone."""
        log = self.log
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for options in [*self.lattice(token), [(" ", 0.0)]]:
            following: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, score in best.items():
                for letters, cost in options:
                    (x, y), total = state, score + cost
                    for c in letters:
                        z = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
                        if z or y:
                            total += log[x][y][z]
                        x, y = (y, z) if z else (0, 0)
                    held = following.get(key := (x, y))
                    if held is None or total > held:
                        following[key], came[key] = total, (state, letters)
            best = following
            steps.append(came)
        state, out = max(best, key=best.get), []
        for came in reversed(steps):
            state, letters = came[state]
            out.append(letters)
        return "".join(reversed(out)).strip()


def _strange(raw: np.ndarray) -> np.ndarray:
    """Where a character begins that may be a disguise; of those that begin with 0xE2, unseen signs and letter forms."""
    out = _STRANGE[raw]
    at = np.flatnonzero(raw == 0xE2)
    second, third = raw[at + 1], raw[at + 2]
    out[at] = np.isin(second, (0x84, 0x92, 0x93)) | (second == 0x80) & (third >= 0x8B) & (third <= 0x8F) | (second == 0x81) & (third >= 0xA0)
    return out


def _doubtful(block: Block) -> list[tuple[int, str]]:
    """Texts and tokens whose lattice has more than one path; spaced-out single letters are joined first."""
    raw, n = block.raw, len(block.raw)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    letters, likes, digits, links = (total(t[raw]) for t in (_LETTER, _LIKE, _DIGIT, _LINK))
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    double = np.zeros(n, bool)
    if n > 1:
        double[:-1] = (low[:-1] == low[1:]) & _LETTER[raw[:-1]] & (raw[:-1] < 128)
    doubles = total(double)
    begin, end = block.begin, block.end
    count = lambda sums: sums[end] - sums[begin]
    size, own = end - begin, count(letters)
    inner = end - 1
    at_end = _LIKE[raw[inner]] & ~_DIGIT[raw[inner]] if len(inner) else np.zeros(0, bool)
    swapped = (own + count(likes) >= 3) & (count(likes) > at_end) & (own + count(likes) - count(digits) > at_end)
    stretched = (own >= 3) & (doubles[np.maximum(end - 1, begin)] > doubles[begin])
    linked = (own + count(digits) >= 3) & (count(links) >= own + count(digits) - 1)
    data = raw.tobytes()
    decoded = lambda i: data[begin[i] : end[i]].decode("utf-8", "replace")
    plain = swapped | stretched | linked
    tokens = [(int(block.doc[i]), decoded(i)) for i in np.flatnonzero(plain).tolist()]
    for i in np.flatnonzero(~plain & (count(total(_strange(raw))) > 0)).tolist():  # beside ASCII letters any look-alike, without them nothing else
        token = decoded(i)
        some = [meant_by(c) is not None for c in token if c > "\x7f"]
        if all(some) or any(some) and any("a" <= c <= "z" for c in token):
            tokens.append((int(block.doc[i]), token))
    single = (size <= 2) & (own + count(digits) == 1) | (size == 1) & (count(likes) == 1)
    edges = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        for doc in np.unique(block.doc[a:b]).tolist() if b - a >= 3 else ():
            mine = [decoded(i) for i in range(a, b) if block.doc[i] == doc]
            joined = " ".join("".join(c for c in w if c.isalnum() or c in LOOKALIKES) for w in mine)  # a blank may be a border or none, the first letter a word
            if len(mine) >= 3 and len(set(joined.lower()) - {" "}) > 2:
                tokens += [(doc, whole) for whole in (joined, joined.replace(" ", ""), joined.partition(" ")[2])]
    return tokens


def _without_accents(block: Block) -> tuple[Block, np.ndarray]:
    """The words that have letters with accents, without these, and their texts."""
    raw = block.raw
    following = np.append(raw[1:], np.uint8(0))
    plain = np.where((raw >= 0xC3) & (raw <= 0xC5), _UNACCENTED[np.clip(raw, 0xC3, 0xC5) - 0xC3, following], 0)
    sums = np.concatenate([[0], np.cumsum(plain > 0)])
    words = np.flatnonzero(sums[block.end] > sums[block.begin])
    size = (block.end - block.begin)[words]
    ends = np.cumsum(size)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(block.begin[words] - (ends - size), size)
    keep = plain[places - 1] == 0  # not the second byte of such a letter; a word's first byte never is one
    keep[(ends - size)] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = np.where(plain > 0, plain, raw)[places][keep].astype(np.uint8)
    offsets = kept[np.append(0, ends)].astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data))
    return Block(array, lower=True), block.doc[words]


def features(texts: pa.Array, restore: Restorer, bits: int = SETTINGS.bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words and word beginnings (of HEADS bytes) a text has, restored words and words without their accents
    included."""
    block = Block(texts, lower=True)
    restored = [(doc, restore(token)) for doc, token in _doubtful(block)]
    extra = Block(pa.array([text for _, text in restored], pa.string()), lower=True)
    owners, found = [], []
    for part, doc_of in ((block, None), (extra, np.array([doc for doc, _ in restored], np.int64)), _without_accents(block)):
        begin, end, doc = part.runs(_LETTER[part.raw])
        doc = doc if doc_of is None else doc_of[doc]
        for head in (0, *HEADS):
            some = end - begin > head
            stop = begin[some] + head if head else end
            owners.append(doc[some])
            found.append((mix(part.hashes(begin[some], stop)[:, 0] + np.uint64(head)) >> np.uint64(64 - bits)).astype(np.int64))
    key = np.unique(np.concatenate(owners) << 32 | np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF, np.ones(len(key))


_last: tuple[np.ndarray, Restorer] | None = None


def _restorer(letters: Letters) -> Restorer:
    """One restorer a worker process, made anew when the language model is another."""
    global _last
    if _last is None or not np.array_equal(_last[0], letters.log):
        _last = (letters.log, Restorer(letters))
    return _last[1]


def classify(docs: DataFrame, labels: DataFrame, settings: linear.Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The language model counts the trigrams of all texts. The classifier learns from at most settings.max_rows
    labelled documents whose crc32 of the id modulo 4 is not 2, and from their texts alone. Null and empty texts
    get the model's bias; without labels of both kinds every score is 0.5. A null doc_id counts as the empty
    string for held_out. Repeated rows score alike; an empty table gives no rows. Whole texts are scored.
    """
    # At most 28^3 rows, whatever the number of documents.
    letters = Letters.of({r["gram"]: r["n"] for r in trigram_counts(docs).collect()})
    sent = docs.sparkSession.sparkContext.broadcast(letters)
    own = lambda texts: features(texts, _restorer(sent.value), settings.bits)
    model = linear.train(linear.labelled(docs, labels, "toxic", linear.remainder(4) != 2, settings.max_rows), own, settings)
    return linear.score(docs, model, own, threshold).select("doc_id", (linear.remainder(4) == 2).alias("held_out"), "score", "predicted")

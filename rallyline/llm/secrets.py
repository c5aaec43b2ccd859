"""Operator 5: secret scans by a recursive decoding worklist.

Three kinds of secret are looked for in the text itself (the base spans). Then each layer of the worklist is
searched for encoded stretches (percent escapes, backslash-u escapes, base64, two-byte characters) and for
compressed bytes. A layer is its parent with the stretches of one kind decoded in place, so that a key and its
value meet though only one is encoded, or what a base64 or compressed stretch holds, until nothing decodes to
anything new. A hash of every layer seen breaks cycles. Every layer maps its characters to its parent's, so a secret
in it is reported over the characters of the text that it was decoded from: to the escape or the base64 digit, for
compressed bytes the whole stretch. Stretches are decoded when their turn comes, one at a time. All patterns are ASCII, so bytes are read as Latin-1, which loses none.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from rallyline.llm.common import map_arrow, map_blocks, text_rows, texts_of
from rallyline.llm.text import slices

KINDS = ("assign", "access", "hex")
#: The patterns of the contract, each with the least length of what it must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 characters or more
KEY_WORDS = ("passw", "secret", "token", "api")  # one is in each key
KEY = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

# Stretches that may be encoded, each with what one must hold to be so; runs are maximal, so matching is linear.
PERCENT_RUN = re.compile(r"[A-Za-z0-9_.~+=:/&?%-]+")
PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ESCAPE_RUN = re.compile(r"[A-Za-z0-9_.=:/+\\{}&#;-]+")
ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
WIDE = re.compile(r"(?:[\x01-\xff]\x00(?:\x00\x00)?){8,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)?={0,2}")
WRAPPED_TAIL = re.compile(r"[A-Za-z0-9+/_\r\n\x20\t-]+")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
NO_BYTE = re.compile(r"[^\x00-\xff]")
LEAST = 16  # characters of the shortest secret
_ZLIB = "".join(f"|\\x{c:02x}[{''.join(f'\\x{f:02x}' for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32)}]" for c in range(0x08, 0x88, 0x10))
PACKED = re.compile(r"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00" + _ZLIB)

Span = tuple[int, int, int]  # start, kind, end
Source = Callable[[], Iterator[bytes]]  # the bytes of a stretch from its beginning, as often as asked for


@dataclass(frozen=True)
class Limits:
    """Bytes of a stretch held at a time; a longer one is read window by window to its end, each with the last bytes
    of the one before it."""

    window: int = 4 << 20
    carried: int = 1 << 16
    piece: int = 1 << 18


def scan(text: str) -> list[Span]:
    """Secrets in a text as it stands, leftmost and without overlap for each kind."""
    return _scan(text, ASSIGN.finditer(text))


def _any_assign(text: str) -> Iterator[re.Match]:
    """Also the keys that stand where another key's value is, but for those whose own value is the rest of that one."""
    end = 0
    for key in KEY.finditer(text):
        if key.end() + 1 >= end and (m := ASSIGN.match(text, key.start())):
            end = m.end() if len(m[2]) >= 12 else end
            yield m


def _scan(text: str, assigned: Iterator[re.Match]) -> list[Span]:
    low = text.lower() if ":" in text or "=" in text else ""
    found = [(m.start(), 0, m.end()) for m in assigned if len(m[2]) >= 12] if any(word in low for word in KEY_WORDS) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Of what is decoded in place: begin and end in the run, what it becomes, and how many characters stand for how many.
InPlace = tuple[int, int, str, int, int]


def _escapes(part: str, escape: re.Pattern, char: Callable[[re.Match], str]) -> list[InPlace] | None:
    """A run with its escapes decoded; neighbouring ones of the same width are one piece."""
    out: list[list] = []
    done = 0
    for m in escape.finditer(part):
        if not (new := char(m)):
            continue
        if m.start() > done:
            out.append([done, m.start(), [part[done : m.start()]], 1])
        if out and out[-1][1] == m.start() and out[-1][3] == len(m[0]):
            out[-1][1] = m.end()
            out[-1][2].append(new)
        else:
            out.append([m.start(), m.end(), [new], len(m[0])])
        done = m.end()
    if not out:
        return None
    if done < len(part):
        out.append([done, len(part), [part[done:]], 1])
    return [(a, b, "".join(new), width, 1) for a, b, new, width in out]


def _unescaped(m: re.Match) -> str:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 else ""


def _unpercent(part: str) -> list[InPlace] | None:
    return _escapes(part, PERCENT, lambda m: chr(int(m[1], 16)))


def _unescape(part: str) -> list[InPlace] | None:
    return _escapes(part, ESCAPE, _unescaped)


def _narrow(part: str) -> list[InPlace] | None:
    new = part.replace("\0", "")
    return [(0, len(part), new, 0 if len(part) % len(new) else len(part) // len(new), 1)]


def _bytes64(body: str) -> bytes:
    """What characters of either base64 alphabet stand for; a last one that is no whole byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")  # the URL alphabet's - and _
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _plain64(part: str) -> list[InPlace] | None:
    """What base64 of a text holds; any other stretch stays as it is."""
    try:
        text = _bytes64(part.rstrip("=")).decode()
    except UnicodeDecodeError:
        return None
    if not text.translate(_PRINTED).isprintable():
        return None
    return [(0, len(part), text, *((4, 3) if text.isascii() else (0, 1)))]


_PRINTED = dict.fromkeys(map(ord, "\t\r\n"))


def _text(pieces: list[InPlace] | None, part: str) -> str:
    return "".join(p[2] for p in pieces) if pieces else part


#: Decoded in place: the runs, what one must hold and a character of that, how, and of a run cut by a window's end how much stays with what follows.
DECODERS = (
    (PERCENT_RUN, PERCENT, "%", _unpercent, re.compile(r"%[0-9A-Fa-f]?\Z")),
    (ESCAPE_RUN, ESCAPE, "\\&", _unescape, re.compile(r"(?:\\(?:u(?:[0-9A-Fa-f]{0,3}|\{[0-9A-Fa-f]{0,6})|U[0-9A-Fa-f]{0,7}|x[0-9A-Fa-f]?)?|&(?:#[xX]?[0-9A-Fa-f]{0,7})?)\Z")),
    (WIDE, re.compile("\0"), "\0", _narrow, None),
    (BASE64, BASE64, ("",), _plain64, None),
)


class _Zlib:
    """zlib's decompressor with the face of bz2's and lzma's."""

    def __init__(self, bits: int):
        self.inner, self.tail, self.needs_input = zlib.decompressobj(bits), b"", True

    def decompress(self, data: bytes, most: int) -> bytes:
        data = self.tail + data
        before = self.inner.copy()
        try:
            out = self.inner.decompress(data, most)
        except zlib.error:  # what comes before the fault
            out = b""
            for k in range(len(data)):
                try:
                    out += before.decompress(before.unconsumed_tail + data[k : k + 1], most)
                except zlib.error:
                    break
            self.tail, self.needs_input, self.broken = b"", True, True
            return out
        self.tail = self.inner.unconsumed_tail
        self.needs_input = not self.tail and len(out) < most
        return out

    broken = False
    eof = property(lambda self: self.inner.eof)
    unused_data = property(lambda self: self.inner.unused_data)


def _opener(data: bytes) -> Callable | None:
    found = PACKED.match(data[:6].decode("latin-1"))
    if not found:
        return None
    return {"\x1f": lambda: _Zlib(31), "B": bz2.BZ2Decompressor, "\xfd": lzma.LZMADecompressor}.get(found[0][0], lambda: _Zlib(15))


def unpacked(chunks: Iterable[bytes], piece: int = Limits.piece, ended: list | None = None) -> Iterator[bytes]:
    """What compressed bytes hold, one member after another to the end of the last, in pieces; ended gets an entry
    if the bytes ran out before the end."""
    chunks, data = iter(chunks), b""
    while True:
        while len(data) < 6 and (more := next(chunks, None)) is not None:
            data = (data + more).lstrip(b"\0")  # members may be padded
        make = _opener(data)
        if not make:
            return
        member = make()
        while not member.eof:
            try:
                some = piece >> 4 if member.needs_input else 0
                out = member.decompress(data[:some], piece)
            except (OSError, EOFError, ValueError, lzma.LZMAError):
                return
            data = data[some:]
            if out:
                yield out
            if getattr(member, "broken", False):
                return
            if not member.eof and member.needs_input and not data:
                data = next(chunks, b"")
                if not data:
                    if ended is not None:
                        ended.append(True)
                    return
        data = (member.unused_data + data).lstrip(b"\0")


def _from(source: Source, offset: int) -> Iterator[bytes]:
    for chunk in source():
        if offset < len(chunk):
            yield chunk[offset:]
        offset = max(offset - len(chunk), 0)


def _run_of(chunks: Iterator[bytes], run: re.Pattern, decode: Callable[[str], list[InPlace] | None], cut: re.Pattern) -> Iterator[bytes]:
    """A run of escapes that goes on beyond a window, decoded to its end."""
    held = ""
    for chunk in chunks:
        held += chunk.decode("latin-1")
        m = run.match(held)
        whole = m[0] if m else ""
        if len(whole) < len(held):
            yield _text(decode(whole), whole).encode("latin-1", "replace")
            return
        tail = cut.search(held)
        keep = tail.start() if tail else len(held)
        yield _text(decode(held[:keep]), held[:keep]).encode("latin-1", "replace")
        held = held[keep:]
    yield _text(decode(held), held).encode("latin-1", "replace")


def _run_of_64(chunks: Iterator[bytes], skip: int) -> Iterator[bytes]:
    held = ""
    for chunk in chunks:
        text = chunk.decode("latin-1")
        stop = re.search(r"[^A-Za-z0-9+/_\r\n\x20\t-]", text)
        held += re.sub(r"[\r\n\x20\t]+", "", text[: stop.start()] if stop else text)
        cut, skip = min(skip, len(held)), max(skip - len(held), 0)
        held = held[cut:]
        if stop:
            break
        keep = len(held) & ~3
        yield _bytes64(held[:keep])
        held = held[keep:]
    yield _bytes64(held)


#: Begin and end in the parent, how many of its characters stand for how many (0: only the whole for the whole), and
#: whether they were decoded, here or before.
Part = tuple[int, int, int, int, bool]


def _bytes(text: str, start: int, stop: int) -> bytes:
    """The characters from start on as bytes, up to stop or to the first that is none."""
    try:
        return text[start:stop].encode("latin-1")
    except UnicodeEncodeError as fault:
        return text[start : start + fault.start].encode("latin-1")


@dataclass
class Layer:
    """A text in parts: where each begins and what of the parent it comes from. The root has none."""

    text: str
    at: list[int]
    parts: list[Part]
    parent: Layer | None = None

    @classmethod
    def root(cls, text: str) -> Layer:
        return cls(text, [0], [(0, len(text), 1, 1, False)])

    def flat(self, text: str, start: int, end: int) -> Layer:
        """What all the characters from start to end stand for."""
        return Layer(text, [0], [(start, end, 0, 1, True)], self)

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """The document's characters from start to end of the layer, and whether any of it was decoded."""
        layer, new = self, any(p[4] for p in self.parts[bisect_right(self.at, start) - 1 : bisect_right(self.at, max(end - 1, start))])
        while layer.parent:
            last = max(end - 1, start)
            i, j = bisect_right(layer.at, start) - 1, bisect_right(layer.at, last) - 1
            (a, _, up, down, _), (c, d, up_last, down_last, _) = layer.parts[i], layer.parts[j]
            start = a + (start - layer.at[i]) * up // down
            end = min(d, c + ((last - layer.at[j] + 1) * up_last - 1) // down_last + 1) if up_last else d
            layer = layer.parent
        return start, end, new

    def decoded_until(self, i: int) -> int:
        """Where the decoded parts from part i on end that have no gap between them."""
        while i + 1 < len(self.parts) and self.parts[i + 1][4]:
            i += 1
        return self.at[i + 1] if i + 1 < len(self.at) else len(self.text)

    def replaced(self, runs: list[tuple[int, list[InPlace]]]) -> Layer:
        """This layer with runs decoded in place."""
        out, at, parts, size, done, i = [], [], [], 0, 0, 0
        for start, pieces in [*runs, (len(self.text), [])]:
            while done < start:  # parts of what stays
                while i + 1 < len(self.at) and self.at[i + 1] <= done:
                    i += 1
                stop = min(start, self.at[i + 1] if i + 1 < len(self.at) else start)
                at.append(size)
                parts.append((done, stop, 1, 1, self.parts[i][4]))
                out.append(self.text[done:stop])
                size, done = size + stop - done, stop
            for a, b, new, up, down in pieces:
                if new:
                    at.append(size)
                    parts.append((start + a, start + b, up, down, True))
                    out.append(new)
                    size += len(new)
                done = start + b
        return Layer("".join(out), at, parts, self)


class Search:
    """The worklist of one document: layers, and stretches that give layers when their turn comes."""

    def __init__(self, text: str, limits: Limits):
        self.limits, self.base = limits, scan(text)
        self.found, self.seen, self.work = set(self.base), set(), []
        self.add(Layer.root(text))
        self.drain()

    def drain(self) -> None:
        while self.work:
            item = self.work.pop()
            if isinstance(item, Layer):
                self.look(item)
            else:
                item()

    def new(self, start: int, end: int, digest) -> bool:
        digest.update(f":{start}:{end}".encode())
        key = digest.digest()
        return key not in self.seen and not self.seen.add(key)

    def add(self, layer: Layer) -> None:
        if layer.text and self.new(*layer.origin(0, len(layer.text))[:2], hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)):
            self.work.append(layer)

    def look(self, layer: Layer, source: Source | None = None, before: int = 0) -> None:
        """Scan a layer and put what decodes on the list; source continues a layer that is but a window of more, and
        what lies in its first `before` characters has been seen."""
        text, root = layer.text, not layer.parent
        for start, kind, end in () if root else _scan(text, _any_assign(text)):
            a, b, new = layer.origin(start, end)
            if new:
                self.found.add((a, kind, b))
        for run, sign, marks, decode, _ in DECODERS:
            if sign.search(text):
                runs = [(m.start(), pieces) for m in run.finditer(text) if any(c in m[0] for c in marks) and (pieces := decode(m[0]))]
                if runs:
                    self.add(layer.replaced(runs))
        for m in WRAPPED.finditer(text):
            if not source or not WRAPPED_TAIL.fullmatch(text, max(m.start(), len(text) - self.limits.carried // 2)):
                for skip in range(4):  # a run that may go on beyond the window is read on from the source
                    self.work.append(partial(self.base64, layer, m.start(), m.end(), skip))
        for m in () if root else PACKED.finditer(text, before):
            i = bisect_right(layer.at, m.start()) - 1
            if not layer.parts[i][4]:
                continue
            self.unpack(layer, m.start(), layer.decoded_until(i), source)

    def base64(self, layer: Layer, first: int, last: int, skip: int) -> None:
        """The bytes of a stretch without its first `skip` digits, line by line for where they come from."""
        body, at, parts, size = [], [], [], -skip
        for line in LINE.finditer(layer.text, first, last):
            digits = line[0].rstrip("=")
            body.append(digits)
            begin = line.start() + max(-size, 0)
            if size + len(digits) > 0:
                at.append((max(size, 0) * 3 + 3) // 4)
                parts.append((begin, line.end(), 4, 3, True))
            size += len(digits)
        text = _bytes64("".join(body)[skip:]).decode("latin-1")
        if len(text) >= LEAST:
            self.add(Layer(text, at, parts, layer))

    def unpack(self, layer: Layer, start: int, stop: int, source: Source | None) -> None:
        text, piece, ended = layer.text, self.limits.piece, []
        if not any([*unpacked([_bytes(text, start, min(stop, start + 4096))], piece, ended)]) and not ended:
            return  # a fault at the beginning: these bytes only look compressed
        if far := NO_BYTE.search(text, start, stop):
            stop = far.start()
        parts = lambda: (text[k : min(k + (1 << 16), stop)].encode("latin-1") for k in range(start, stop, 1 << 16))
        own = lambda: unpacked(parts(), piece)
        if source:  # of a window: only what begins well and goes on beyond it is read from the source
            ended = []
            for _ in unpacked(parts(), piece, ended):
                pass
            if ended:
                own = lambda: unpacked(_from(source, start), piece)
        self.work.append(partial(self.dive, own, layer, start, stop))

    def dive(self, source: Source, layer: Layer, start: int, stop: int) -> None:
        """A stretch of any length, all of which stands for the layer's characters from start to stop."""
        head = bytearray()
        for piece in source():
            head += piece
            if len(head) > self.limits.window:
                break
        else:
            if head:
                self.add(layer.flat(head.decode("latin-1"), start, stop))
            return
        del head
        digest = hashlib.blake2b(digest_size=16)
        for piece in source():
            digest.update(piece)
        if self.new(*layer.origin(start, stop)[:2], digest):
            self.windows(source, layer, start, stop)

    def windows(self, source: Source, layer: Layer, a: int, b: int) -> None:
        held, begun, first, open_runs = bytearray(), 0, True, set()
        pieces = source()
        piece = next(pieces, None)
        while piece is not None:
            held += piece
            piece = next(pieces, None)
            if len(held) < self.limits.window and piece is not None:
                continue
            text = held.decode("latin-1")
            later, self.work = self.work, []
            rest = lambda k=begun: _from(source, k)
            self.look(layer.flat(text, a, b), rest if piece is not None else None, 0 if first else self.limits.carried - 8)
            self.drain()
            for k, (run, cut) in enumerate([(d[0], d) for d in DECODERS[:2]] + [(WRAPPED, None)] if piece is not None else ()):
                tail = text[-self.limits.carried // 2 :]  # a shorter run is whole in the next window
                for m in run.finditer(text) if (run.fullmatch if cut else WRAPPED_TAIL.fullmatch)(tail) else ():
                    if m.end() < len(text) or cut and not cut[1].search(m[0]):
                        continue
                    if k not in open_runs or m.start() > 0:
                        start = begun + m.start()
                        if cut:
                            self.dive(lambda: _run_of(_from(source, start), run, cut[3], cut[4]), layer, a, b)  # noqa: B023
                        else:
                            for skip in range(4):
                                self.dive(lambda: _run_of_64(_from(source, start), skip), layer, a, b)  # noqa: B023
                        self.drain()
                    open_runs.add(k)
                    break
                else:
                    open_runs.discard(k)
            self.work = later
            cut_at = max(len(held) - self.limits.carried, 0)
            begun, first = begun + cut_at, False
            del held[:cut_at]


def all_spans(text: str, limits: Limits = Limits()) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each in order of start, kind, end."""
    search = Search(text, limits)
    return search.base, sorted(search.found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of docs, without a shuffle: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the digest are of the base spans, spans lists all. A span covers the whole match, in code
    points. Null and empty texts have none and the digest of nothing; repeated rows each give a row; whole
    texts are read, whatever their length; other columns are left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = ([], [], []), [], []
        for text in texts_of(batch):
            base, every = all_spans(text, limits)
            for kind in range(3):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.record_batch(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_blocks(text_rows(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mark: str = "[secret]", limits: Limits = Limits()) -> str:
    """The text with every stretch that a span covers replaced by mark."""
    out, done = [], 0
    for start, _, end in all_spans(text, limits)[1]:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if done else text


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of docs, with secrets masked in text and n_chars, where there is one, brought up to date.

    A null text stays null; a text without secrets is left as it is.
    """
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.rename_columns(names), names[text_at]):
                old = batch.column(text_at).to_pylist()
                new = [t and masked(t, mark) for t in old]
                columns = list(batch.columns)
                columns[text_at] = pa.array(new, pa.string())
                if chars_at is not None:
                    kept = batch.column(chars_at)
                    sizes = [n if a == b else len(b) for n, a, b in zip(kept.to_pylist(), old, new, strict=True)]
                    columns[chars_at] = pa.array(sizes, kept.type)
                yield pa.RecordBatch.from_arrays(columns, whole.schema.names)

    return map_arrow(docs, run, docs.schema)

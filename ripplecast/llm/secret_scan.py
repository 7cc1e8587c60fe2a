"""Secrets in texts, also in nested encodings: a worklist of decoded layers until nothing is new.

The text itself is the first layer. A layer is scanned, then each decoder (URL escapes, Unicode
escapes, base64, and base64 of gzip, zlib or zstandard data) replaces all it can read in the layer.
What it changed, with as much around it as a match or a run can span, makes further layers, so work
is in proportion to what was decoded and not to the text. Layers seen before, by digest, are not
taken up again, so cycles end and the worklist runs to its fixpoint. Every character of a layer
knows its span in the text: exact for escapes and base64, the whole run for compressed data. Base64
lines that follow each other are read twice, as one wrapped run and each by itself, since a list of
codes looks like a wrapped one; so a secret across a wrap may also be listed as far as its first
line goes. A run that does not decode is read from after a ``/``, ``-`` or ``_``. Bytes that are no
UTF-8 are read as U+FFFD: in escapes and compressed data always, in base64 where a stretch of
``_STRETCH`` readable characters stands beside them, which chance does not make. All members of
compressed data are read; data beyond ``most`` bytes are scanned in overlapping windows. A finding
of a later layer counts if it touches a decoded character, and is reported at its span in the text.

Findings of the first layer are always reported as they are. The patterns are fixed values.

Edge cases: a null text is the empty text, without findings; compressed data of one text that would
grow beyond ``MOST_UNPACKED`` bytes in all are read up to there and counted in ``refused``; rows
that repeat an id are scanned each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import slices

KINDS = ("assign", "access", "hex")
MOST_BYTES = 16 << 20
#: Bytes that all compressed data of a text may grow to, and that windows of large data share.
MOST_UNPACKED, _OVERLAP = 1 << 30, 1 << 12

# What counts as a secret.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the run is taken whole, 16 characters at least
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+"
)
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"[ \t]*(?:\r\n|\n|\r)[ \t]*([A-Za-z0-9+/_-]+)(={0,2})")
_JOINT = re.compile(r"[/_-]")
_HEAD = 64  # characters of a run that tell most of what does not decode


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of every secret of a layer."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


@dataclass
class Layer:
    """A decoded text; ``start`` and ``end`` are each character's span in the first text."""

    text: str
    start: np.ndarray
    end: np.ndarray
    decoded: np.ndarray
    path: tuple[str, ...] = ()


#: What a decoder reads in a run: the text, and the span of each character inside the run.
Read = tuple[str, np.ndarray, np.ndarray]


_STRAY = re.compile("[\udc80-\udcff]")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12}")


def _utf8(raw: bytes, starts: np.ndarray, ends: np.ndarray, strict: bool = False) -> Read | None:
    """Bytes as text; ``starts`` and ``ends`` are the bytes' spans. Bytes that are no UTF-8 become U+FFFD."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        if strict:
            return None
        text = raw.decode(errors="surrogateescape")
    coded = np.frombuffer(raw, dtype=np.uint8)
    first = np.flatnonzero((coded & 0xC0) != 0x80)
    if len(first) != len(text):  # stray bytes are characters of their own
        sizes = np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
    last = np.append(first[1:], len(raw)) - 1
    return _STRAY.sub("\ufffd", text), starts[first], ends[last]


def _read_url(run: str, most: int) -> Read | None:
    place = np.arange(0, len(run), 3)
    return _utf8(bytes.fromhex(run.replace("%", "")), place, place + 3)


def _read_escapes(run: str, most: int) -> Read | None:
    codes, spans = [], []
    for m in _ONE_ESCAPE.finditer(run):
        digits = m[m.lastindex]
        code = int(digits, 10 if m.lastindex == 4 else 16)
        if codes and 0xDC00 <= code < 0xE000 and 0xD800 <= codes[-1] < 0xDC00:
            codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
            spans[-1] = (spans[-1][0], m.end())
        else:
            codes.append(code)
            spans.append(m.span())
    codes = [0xFFFD if c > 0x10FFFF or 0xD800 <= c < 0xE000 else c for c in codes]
    return "".join(map(chr, codes)), *(np.array(side, dtype=np.int64) for side in zip(*spans))


@dataclass
class _Large:
    """Compressed data that grow beyond a layer's size."""

    raw: bytes


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """What all gzip or zlib members or zstandard frames hold, and whether all were read to their end."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
            while piece := reader.read(1 << 20):
                yield piece, True
        return
    while _packed(raw):
        reader, rest = zlib.decompressobj(47), raw
        while not reader.eof:
            piece = reader.decompress(rest, 1 << 20)
            yield piece, reader.eof
            rest = reader.unconsumed_tail
            if not rest and not piece:
                return
        raw = reader.unused_data


def _unpacked(raw: bytes, most: int) -> tuple[bytes, bool] | _Large | None:
    """What compressed data hold, as far as they can be read, and whether that is to their end."""
    if not _packed(raw):
        return None
    out, ended = [], False
    try:
        for piece, ended in _chunks(raw):
            out.append(piece)
            most -= len(piece)
            if most < 0:
                return _Large(raw)
    except (zlib.error, zstandard.ZstdError):
        ended = False
    return b"".join(out), ended


def _windows(raw: bytes, most: int) -> Iterator[bytes]:
    """The unpacked data in windows that overlap, so that no match falls between two."""
    held = b""
    try:
        for piece, _ in _chunks(raw):
            held += piece
            if len(held) >= most:
                yield held
                held = held[-_OVERLAP:]
    except (zlib.error, zstandard.ZstdError):
        pass
    yield held


def _bytes(body: str) -> bytes:
    """The bytes of base64 of either alphabet without padding; a lone last character holds none."""
    body = body.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _packed(raw: bytes) -> bool:
    """Whether bytes begin as gzip, zlib or zstandard data do; zlib's window may have any size."""
    if raw[:2] == b"\x1f\x8b" or raw[:4] == b"\x28\xb5\x2f\xfd":
        return True
    return len(raw) > 1 and raw[0] & 0x8F == 0x08 and int.from_bytes(raw[:2]) % 31 == 0


def _first_bad(raw: bytes) -> int | None:
    """The place of the first byte that is not UTF-8; a character cut at the end is none."""
    try:
        codecs.utf_8_decode(raw)
    except UnicodeDecodeError as error:
        return error.start
    return None


def _read_base64(run: str, most: int, strict: bool = True) -> Read | _Large | None:
    """A run, which may hold line ends."""
    text = run.rstrip("=")
    pos = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) > 32)
    body = "".join(text.split())
    if len(body) % 4 == 1:
        if strict:
            return None
        body, pos = body[:-1], pos[:-1]
    raw = _bytes(body)
    place = np.arange(len(raw))
    ends = pos[-(-(place + 1) * 4 // 3) - 1] + 1
    ends[-1] = len(run)
    plain = _utf8(raw, pos[place * 4 // 3], ends, strict)
    if not strict:
        return plain
    # a checksum tells packed data from text that only begins like it
    opened = _unpacked(raw, most)
    if isinstance(opened, _Large):
        return opened
    out, ended = opened or (b"", False)
    if not out or (plain and not ended):
        return plain
    text = out.decode(errors="replace")
    whole = np.zeros(len(text), dtype=np.int64)
    return text, whole, whole + len(run)


def _read_stretch(run: str, first: int, most: int) -> tuple[int, Read] | None:
    """What a run holds beside bytes that are no text, for the first start that shows a readable stretch."""
    tried = set()
    for at in (0, *[m.end() for m in _JOINT.finditer(run, 0, first)]):
        start = len(run) - len(run[at:].lstrip())
        body = "".join(run[start:].split()).rstrip("=")
        if len(body) < 16:
            break
        if len(body) % 4 not in tried:  # starts of one remainder read the same bytes
            tried.add(len(body) % 4)
            if _STRETCH.search(_bytes(body)):
                return start, _read_base64(run[start:], most, strict=False)
    return None


def _read_from(run: str, first: int, most: int) -> tuple[int, Read | _Large] | None:
    """What a run holds, from its start or else from after a joint among its ``first`` characters.

    Two starts at the same place in a group of four read the same bytes, so a start is passed over
    when a byte that an earlier one could not read is still ahead.
    """
    bad = [-1] * 4
    for at in (0, *[m.end() for m in _JOINT.finditer(run, 0, first)]):
        if len(run) - at < 16:
            break
        head = "".join(run[at : at + 2 * _HEAD].split()).rstrip("=")[:_HEAD]
        raw = _bytes(head[: len(head) // 4 * 4])
        if not _packed(raw) and (at < bad[at % 4] or _first_bad(raw) is not None):
            continue
        start = len(run) - len(run[at:].lstrip())
        got = _read_base64(run[start:], most)
        if got is not None:
            return start, got
        body = "".join(run[at:].split()).rstrip("=")
        wrong = _first_bad(_bytes(body))
        bad[at % 4] = len(run) if wrong is None else at + wrong * 4 // 3
    return None


def _lines_of(text: str, m: re.Match) -> list[int]:
    """The ends of a run's lines: lines after the first are as wide as the second, but the last."""
    ends, width, last = [m.end()], None, m[0].endswith("=")
    while not last and (line := _NEXT_LINE.match(text, ends[-1])):
        size = len(line[1])
        if width is not None and size > width:
            break
        ends.append(line.end())
        last = bool(line[2]) or (width is not None and size < width)
        width = size
    return ends


#: Runs of a text that a decoder reads: start, end, and what is read.
Runs = Iterator[tuple[int, int, Read | _Large]]


def _runs(text: str, pattern: re.Pattern, read, most: int) -> Runs:
    for m in pattern.finditer(text):
        if (got := read(m[0], most)) is not None:
            yield *m.span(), got


def _url_runs(text: str, most: int) -> Runs:
    return _runs(text, _URL, _read_url, most)


def _escape_runs(text: str, most: int) -> Runs:
    return _runs(text, _ESCAPE, _read_escapes, most)


def _base64_runs(text: str, most: int, wrapped: bool = False) -> Runs:
    """Runs one by one, or with line ends in them; where no lines join, both are the same.

    Whether lines are one payload or a list of payloads cannot be told, hence both are read. Lines
    that do not join from their first one are tried from one more, which leaves out a line above.
    """
    at, misses = 0, []
    while m := _BASE64.search(text, at):
        at = m.end()
        ends = [at]
        if wrapped and sum(end > m.start() for end in misses[-2:]) < 2:
            ends = _lines_of(text, m)
            if len(ends) > 1:
                misses.append(ends[-1])
        # the last line may be a word that follows
        tries = sorted({ends[-1], ends[-2:][0], ends[0]}, reverse=True)
        for read, end in [(_read_from, end) for end in tries] + [(_read_stretch, end) for end in tries]:
            found = read(text[m.start() : end], ends[0] - m.start(), most)
            if found:
                yield m.start() + found[0], end, found[1]
                at = end
                break


def _wrapped_runs(text: str, most: int) -> Runs:
    if any(_NEXT_LINE.match(text, m.end()) for m in _BASE64.finditer(text) if m[0][-1] != "="):
        yield from _base64_runs(text, most, True)


_DECODERS = (("url", _url_runs), ("unicode", _escape_runs), ("base64", _wrapped_runs), ("base64", _base64_runs))


_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_CODE_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")


def _cut(layer: Layer, fresh: np.ndarray) -> Iterator[tuple[int, int, Layer]]:
    """The parts of a layer around its fresh characters and where they lie: whole words, two more on both sides, and
    the lines of a wrapped run that go on from there. No match and no run spans more."""
    marks = np.flatnonzero(np.diff(np.concatenate([[0], fresh.view(np.int8), [0]])))
    spans = np.array([m.span() for m in _TOKEN.finditer(layer.text)], dtype=np.int64).reshape(-1, 2)
    done = 0
    for a, b in marks.reshape(-1, 2).tolist():
        if b <= done:
            continue
        low = max(0, int(np.searchsorted(spans[:, 1], a)) - 2)
        high = min(len(spans), int(np.searchsorted(spans[:, 0], b)) + 2)
        while low > 0 and _CODE_LINE.fullmatch(layer.text, *spans[low - 1].tolist()):
            low -= 1
        while high < len(spans) and _CODE_LINE.fullmatch(layer.text, *spans[high].tolist()):
            high += 1
        start = min(a, int(spans[low, 0])) if low < len(spans) else a
        stop = max(b, int(spans[high - 1, 1])) if high else b
        start, done = min(start, a), stop
        sides = (side[start:stop] for side in (layer.start, layer.end, layer.decoded))
        yield start, stop, Layer(layer.text[start:stop], *sides, layer.path)


def _replaced(layer: Layer, found: list[tuple[int, int, Read]], low: int, high: int, name: str) -> tuple[Layer, np.ndarray]:
    """The stretch of a layer with its runs replaced, and which characters are fresh."""
    texts, arrays, at = [], [], low
    for a, b, (text, starts, ends) in found:
        texts += [layer.text[at:a], text]
        new = np.ones(len(text), dtype=bool)
        arrays.append((layer.start[at:a], layer.end[at:a], layer.decoded[at:a], np.zeros(a - at, dtype=bool)))
        arrays.append((layer.start[a + starts], layer.end[a + ends - 1], new, new))
        at = b
    texts.append(layer.text[at:high])
    rest = np.zeros(high - at, dtype=bool)
    arrays.append((layer.start[at:high], layer.end[at:high], layer.decoded[at:high], rest))
    start, end, decoded, fresh = (np.concatenate(side) for side in zip(*arrays))
    return Layer("".join(texts), start, end, decoded, (*layer.path, name)), fresh


def _decode(layer: Layer, name: str, runs, most: int) -> tuple[list[Layer], list[tuple[int, int, _Large]]]:
    """The parts of the layer that change when every readable run is replaced, and runs of large data.

    Runs are replaced in stretches of the layer; where a part reaches the end of its stretch, all
    are made anew with more around them.
    """
    found, large = [], []
    for a, b, got in runs(layer.text, most):
        if isinstance(got, _Large):
            large.append((int(layer.start[a]), int(layer.end[b - 1]), got))
        else:
            found.append((a, b, got))
    reach, size = 2048, len(layer.text)
    while found:
        groups, parts, whole = [], [], True
        for one in found:
            if groups and one[0] - reach <= groups[-1][-1][1] + reach:
                groups[-1].append(one)
            else:
                groups.append([one])
        for group in groups:
            low, high = max(0, group[0][0] - reach), min(size, group[-1][1] + reach)
            made, fresh = _replaced(layer, group, low, high, name)
            for first, last, part in _cut(made, fresh):
                whole &= (first > 0 or low == 0) and (last < len(made.text) or high == size)
                parts.append(part)
        if whole:
            return parts, large
        reach *= 16
    return [], large


class _Scan:
    """The worklist of one text."""

    def __init__(self, text: str, most: int, unpacked: int):
        self.most, self.left = most, unpacked
        self.found = {(*span, "") for span in matches(text)}
        self.spans, self.refused = {span[:3] for span in self.found}, 0
        self.seen = {hashlib.sha256(text.encode()).digest()}
        if "%" in text or "\\" in text or "&#" in text or _BASE64.search(text):
            place = np.arange(len(text))
            self.follow(Layer(text, place, place + 1, np.zeros(len(text), dtype=bool)))

    def follow(self, layer: Layer) -> None:
        """All layers that come from one."""
        work = [layer]
        while work:
            layer = work.pop()
            for decoder in _DECODERS:
                made, large = _decode(layer, *decoder, self.most)
                work += [one for one in made if self.is_new(one)]
                for start, end, data in large:
                    self.open(start, end, data, (*layer.path, decoder[0]))

    def is_new(self, layer: Layer) -> bool:
        """Whether the layer is seen for the first time; if so, list what it holds."""
        digest = hashlib.sha256(layer.text.encode(errors="replace") + layer.start[:1].tobytes()).digest()
        if digest in self.seen:
            return False
        self.seen.add(digest)
        for start, kind, end in matches(layer.text):
            if layer.decoded[start:end].any():
                span = (int(layer.start[start:end].min()), kind, int(layer.end[start:end].max()))
                if span not in self.spans:
                    self.spans.add(span)
                    self.found.add((*span, ">".join(layer.path)))
        return True

    def open(self, start: int, end: int, data: _Large, path: tuple[str, ...]) -> None:
        """Large data, one window after another; each is a layer whose span is the whole run."""
        for raw in _windows(data.raw, self.most):
            if self.left <= 0:
                self.refused += 1
                return
            self.left -= len(raw)
            text = raw.decode(errors="replace")
            whole = np.zeros(len(text), dtype=np.int64)
            layer = Layer(text, whole + start, whole + end, np.ones(len(text), dtype=bool), path)
            if self.is_new(layer):
                self.follow(layer)


def scan_text(
    text: str, most: int = MOST_BYTES, unpacked: int = MOST_UNPACKED
) -> tuple[list[tuple], int, int]:
    """Findings (start, place of the kind, end, path; path empty in the text itself), layers, refused."""
    scan = _Scan(text, most, unpacked)
    return sorted(scan.found), len(scan.seen), scan.refused


_FINDINGS = "array<struct<kind:string,start:long,end:long,layer:string>>"


def scan(docs: DataFrame, most: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings, layers, refused): findings by start, kind and end; layer "" is the text."""
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = dict(texts.dtypes)["doc_id"]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            results = [scan_text(text, most) for text in batch.column(1).to_pylist()]
            listed = [
                [{"kind": KINDS[k], "start": a, "end": b, "layer": path} for a, k, b, path in found]
                for found, _, _ in results
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(listed, pa.list_(item)),
                    pa.array([layers for _, layers, _ in results], pa.int64()),
                    pa.array([refused for _, _, refused in results], pa.int64()),
                ],
                ["doc_id", "findings", "layers", "refused"],
            )

    return texts.mapInArrow(run, f"doc_id {kind}, findings {_FINDINGS}, layers long, refused long")


def digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the findings in the texts themselves, and the spans of all findings."""
    base = F.filter("findings", lambda x: x["layer"] == "")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        "layers",
        "refused",
    )

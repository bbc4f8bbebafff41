"""Secret scans with a worklist of decoded layers.

A text is scanned for the base kinds. Then every encoded run in it (percent escapes, \\u and \\x escapes, base64, and
compressed bytes inside base64) is decoded into a layer of its own, scanned and searched for encoded runs again, until no new layer
appears; a layer of the same text from the same place is not opened twice, so cycles end, while equal layers at several places
are each reported. Each layer carries, for every character, the range of the original text that it came from, and findings are reported there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import frugal, texts_of

#: The kinds in their order with the patterns and least lengths.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORD = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Encoded runs: escapes and whatever stands beside them without a space. No character can begin two of the choices, so a run is read once; one without an escape is passed over.
PERCENT, PERCENT_RUN = re.compile(r"%[0-9A-Fa-f]{2}"), re.compile(r"(?:[^\s%]+|%[0-9A-Fa-f]{2})+")
ESCAPED, ESCAPED_RUN = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})"), re.compile(r"(?:[^\s\\]+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines (a line end may stand as an escape): all lines but the last have 16 characters or more.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[ \t]*(?:\r?\n|\r|\\r\\n|\\n)[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"(?:^|(?<=[\r\n \t])|(?<=\\n))[A-Za-z0-9+/_-]+")
#: What bytes that are not text as a whole must hold for any finding: the least of them has 12 characters, however often encoded.
READABLE = re.compile(rb"[\t\n\r -~]{12}")
#: A compressed layer is scanned in pieces of so many bytes, so that a bomb cannot fill memory. A piece ends at a space or line end that is not within
#: a wrapped run; where there is none, it is cut with an overlap, and counted.
MOST_BYTES, OVERLAP = 64 << 20, 1 << 20
BREAK = re.compile(rb"[^A-Za-z0-9+/_=\\ \t\r\n:-][ \t]*\r?\n")

Span = tuple[int, int, int]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    """Base findings as (start, end, kind) in code points, by start and then kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


LONE = re.compile("[\ud800-\udfff]")


class Layer:
    """A decoded text; origin[i] is the range of the original text behind character i (None: the text itself; one range: all characters have it)."""

    __slots__ = ("origin", "text")

    def __init__(self, text: str, origin: list[tuple[int, int]] | tuple[int, int] | None) -> None:
        self.text, self.origin = text, origin

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.origin is None:
            return start, end
        if isinstance(self.origin, tuple):
            return self.origin
        part = self.origin[start:end]
        return min(x[0] for x in part), max(x[1] for x in part)


class Places:
    """The places of layers of one text; none is inside another, so starts and ends are both sorted."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def added(self, start: int, end: int) -> bool:
        """Whether the place is a new one: a layer inside or around a known place comes from the same characters by another order of decoding, or from a cycle."""
        low, high = bisect_left(self.starts, start), bisect_right(self.starts, start)
        if (high and self.ends[high - 1] >= end) or (low < len(self.ends) and self.ends[low] <= end):
            return False
        self.starts.insert(high, start), self.ends.insert(high, end)
        return True


def _text_of(raw: bytes, ranges: list[tuple[int, int]] | tuple[int, int]) -> Layer:
    """Bytes with each one's range -> a layer; a byte that is not UTF-8 becomes one replacement character."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) != len(raw) and isinstance(ranges, list):
        origin, k = [], 0
        for c in text:
            n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
            origin.append((min(x[0] for x in ranges[k : k + n]), max(x[1] for x in ranges[k : k + n])))
            k += n
        ranges = origin
    return Layer(LONE.sub("\ufffd", text), ranges)


def _unpercent(layer: Layer, m: re.Match) -> Layer:
    raw, ranges, k, t = bytearray(), [], m.start(), layer.text
    while k < m.end():
        if t[k] == "%" and re.fullmatch("[0-9A-Fa-f]{2}", t[k + 1 : k + 3]):
            raw.append(int(t[k + 1 : k + 3], 16)), ranges.append(layer.place(k, k + 3))
            k += 3
        else:
            own = t[k].encode("utf-8", "surrogatepass")
            raw += own
            ranges += [layer.place(k, k + 1)] * len(own)
            k += 1
    return _text_of(bytes(raw), ranges)


def _unescape(layer: Layer, m: re.Match) -> Layer | None:
    chars, origin, k, t = [], [], m.start(), layer.text
    while k < m.end():
        n = {"u": 6, "x": 4}.get(t[k + 1 : k + 2], 1) if t[k] == "\\" else 1
        code = t[k + 2 : k + n]
        if n > 1 and re.fullmatch("[0-9A-Fa-f]+", code) and len(code) == n - 2:
            chars.append(chr(int(code, 16)))
        else:
            n = 1
            chars.append(t[k])
        origin.append(layer.place(k, k + n))
        k += n
    text = "".join(chars)
    if any("\ud800" <= c <= "\udfff" for c in text):  # surrogate pairs become one character
        joined_, places, k = [], [], 0
        while k < len(text):
            if "\ud800" <= text[k] <= "\udbff" and k + 1 < len(text) and "\udc00" <= text[k + 1] <= "\udfff":
                joined_.append((text[k] + text[k + 1]).encode("utf-16", "surrogatepass").decode("utf-16")), places.append((origin[k][0], origin[k + 1][1]))
                k += 2
            else:
                joined_.append(text[k]), places.append(origin[k])
                k += 1
        text, origin = "".join(joined_), places
    return Layer(text, origin)


#: Fixed by the formats: how bzip2, xz and Zstandard data begin.
OPENERS = ((b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\0", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", None))


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] * 256 + raw[1]) % 31 == 0) or any(raw.startswith(m) for m, _ in OPENERS)


def _inflated(raw: bytes) -> Iterator[bytes]:
    """The content of gzip (every member), zlib, bzip2, xz or Zstandard data as far as it can be read, in parts."""
    while _compressed(raw):
        own = next((d for m, d in OPENERS if raw.startswith(m)), zlib)
        try:
            if own is None:
                with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw, read_across_frames=True) as r:
                    while part := r.read(OVERLAP):
                        yield part
                return
            if own is not zlib:
                d = own()
                while not d.eof:
                    part = d.decompress(raw, OVERLAP)
                    raw = b""
                    if not part and not d.eof:
                        return
                    if part:
                        yield part
                raw = d.unused_data
                continue
        except (OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return
        d = zlib.decompressobj(47)
        while not d.eof:
            try:
                part = d.decompress(raw, OVERLAP)
            except zlib.error:
                return
            if part:
                yield part
            raw = d.unconsumed_tail
            if not part and not raw:
                break
        if not d.eof:
            return
        raw = d.unused_data.lstrip(b"\0")


def _pieces(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The content of compressed data in pieces that hold whole runs, each with whether it was cut inside what may be one."""
    held = bytearray()
    for part in _inflated(raw):
        held += part
        if len(held) > MOST_BYTES:
            at = max((m.end() for m in BREAK.finditer(held, max(0, len(held) - 2 * OVERLAP))), default=0)
            yield bytes(held[: at or len(held)]), not at
            del held[: at or len(held) - OVERLAP]
    if held:
        yield bytes(held), False


def _unbase64(layer: Layer, run: str, at: list[int]) -> Iterator[tuple[Layer, bool]]:
    """The layers in a run of base64 characters that stand at the places `at` of a layer."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return
    if _compressed(raw) and (first := next(whole := _pieces(raw), None)):
        place = layer.place(at[0], at[len(run) - 1] + 1)
        yield _text_of(first[0], place), first[1]
        for piece, over in whole:
            yield _text_of(piece, place), over
        return
    if not READABLE.search(raw):
        try:
            raw.decode()
        except UnicodeDecodeError:
            return
        if any(b < 9 or 13 < b < 32 for b in raw):
            return
    groups = [layer.place(at[k], at[min(k + 4, len(run)) - 1] + 1) for k in range(0, len(run), 4)]
    yield _text_of(raw, [groups[k // 3] for k in range(len(raw))]), False


def _behind_escape(text: str, m: re.Match) -> list[int]:
    """Where a run may begin as well if its first character is that of an escaped line end or tab."""
    return [1] if text[max(0, m.start() - 1) : m.start() + 1] in ("\\n", "\\r", "\\t") else []


def _unwrapped(layer: Layer, m: re.Match) -> Iterator[tuple[Layer, bool]]:
    """Base64 over several lines, from the first line of each alignment by four, and from each that begins compressed data.

    Lines before the first of the data may be words, so any line may be the first; characters behind the data add nothing but noise."""
    run, at, starts = [], [], []
    for line in LINE.finditer(m.group()):
        starts.append(len(at))
        run.append(line.group())
        at += range(m.start() + line.start(), m.start() + line.end())
    joined_, done = "".join(run), set()
    for start in [*starts[:1], *_behind_escape(layer.text, m), *starts[1:]]:
        head = joined_[start : start + 4].replace("-", "+").replace("_", "/")
        if start % 4 not in done or (len(head) == 4 and _compressed(base64.b64decode(head))):
            done.add(start % 4)
            yield from _unbase64(layer, joined_[start:], at[start:])


def _opened(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers of all encoded runs of a layer, each with whether it was cut."""
    t = layer.text
    if "%" in t and PERCENT.search(t):
        yield from ((_unpercent(layer, m), False) for m in PERCENT_RUN.finditer(t) if "%" in m.group())
    if ("\\u" in t or "\\x" in t) and ESCAPED.search(t):
        yield from ((_unescape(layer, m), False) for m in ESCAPED_RUN.finditer(t) if "\\" in m.group())
    for m in BASE64.finditer(t):
        for k in (0, *_behind_escape(t, m)):
            yield from _unbase64(layer, m.group()[k:].rstrip("="), range(m.start() + k, m.end()))
    for m in WRAPPED.finditer(t):
        yield from _unwrapped(layer, m)


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, layers opened, pieces of layers cut inside a run)."""
    base = base_spans(text)
    found, seen, work, layers, cut = set(base), {}, [Layer(text, None)], 0, 0
    while work:
        layer = work.pop()
        for new, over in _opened(layer):
            cut += over
            if new.text and seen.setdefault(new.text, Places()).added(*new.place(0, len(new.text))):
                layers += 1
                found |= {(*new.place(s, e), k) for s, e, k in base_spans(new.text)}
                work.append(new)
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1])), layers, cut


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_layers", "n_cut")}
        for text in batch.column("text").to_pylist():
            base, every, layers, cut = scan(text)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                cols[name].append(sum(x[2] == k for x in base))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(every)), cols["n_spans"].append(len(every)), cols["n_layers"].append(layers), cols["n_cut"].append(cut)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k in ("spans", "base_sha256") else pa.int64()) for k, v in cols.items())], ["doc_id", *cols])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base findings by kind, their digest, all spans (base and decoded), and the layers opened.

    A null text counts as empty: no spans, the digest of the empty string. Rows without doc_id are dropped, repeated rows are each scanned, and
    extra columns are ignored. Findings that a decoded layer repeats at the same place and of the same kind count once."""
    return texts_of(docs).mapInArrow(frugal(scan_batches), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint, n_layers bigint, n_cut bigint")


def redacted(text: str) -> str:
    """The text with every finding replaced by its kind in brackets; overlapping findings become one."""
    out, at = [], 0
    for s, e, k in scan(text)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
        cols = {n: batch.column(n) for n in batch.schema.names}
        cols["text"] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def redact(docs: DataFrame) -> DataFrame:
    """Docs with every finding in text replaced by its kind in brackets and n_chars counted anew; null texts stay null."""
    return docs.mapInArrow(frugal(redact_batches), docs.schema)

"""Operator 2, secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned; then its URL
escapes and its Unicode escapes are decoded in place, and its base64 runs
are unwrapped (and decompressed where they hold a compressed stream), each
giving a further layer, until no new layer appears. A layer seen before at
the same place is not taken again, so cycles end. Every layer knows which
stretch of the text each of its characters came from, and what is found in
it is reported there."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table
from .tokens import byte_slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})"
                    r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
LONE_BYTE, LONE_HALF = re.compile("[\udc80-\udcff]"), re.compile("[\ud800-\udfff]")
# Every match, escape and base64 run lies in so many ASCII characters at least
# (token=12345678), so what has no such stretch holds nothing.
ASCII_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{14}")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
SIGN = re.compile(r"[+/_-]")
NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]*)(={0,2})")

# No match of the rules, no escape and no base64 run holds another character
# than these, so what lies between others can be decoded on its own.
REACH = re.compile(r"""[A-Za-z0-9+/_.=\-"':\x20%\\&#;{}\r\n]*""")
REACHED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"': %\\&#;{}\r\n")

# A decompressed stream is scanned in blocks of this many characters, split
# between matches; where nothing within OVERLAP ends a match, the next block
# begins that much earlier, and the stream is counted in n_cut, as is one
# that lies in more than MAX_PEELED others. The layers of one text together
# may hold LAYER_BYTES and SHARE times the text; one beyond that is left out
# and counted.
LAYER_BYTES = 64 << 20
OVERLAP, STEP, MAX_PEELED, SHARE = 1 << 20, 1 << 20, 100, 16

SPANS = ("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_cut:bigint,"
         "spans:array<struct<kind:string,start:int,end:int,base:boolean>>>")
SPANS_ARROW = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_cut", pa.int64()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                  ("end", pa.int32()), ("base", pa.bool_())])))])


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the rules' matches in one layer. The keyword
    and prefix tests only skip patterns that cannot match."""
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


@dataclass
class Layer:
    """A decoded text. ``origin`` is None for the text itself, one (start,
    end) when every character came from the same stretch, else a list with
    the stretch of each character. ``block`` marks a block of a large
    stream, ``cut`` that something may be lost where it ends."""
    text: str
    origin: None | tuple[int, int] | list[tuple[int, int]] = None
    block: bool = False
    cut: bool = False

    def at(self, start: int, end: int) -> tuple[int, int]:
        if self.origin is None:
            return start, end
        if isinstance(self.origin, tuple):
            return self.origin
        return self.origin[start][0], self.origin[end - 1][1]


def in_place(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """The stretches of ``layer`` in which ``decode`` makes something of a
    match (None leaves it), with these matches replaced."""
    text, single = layer.text, isinstance(layer.origin, tuple)
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    last, reach = 0, -1

    def keep(start: int, end: int) -> None:
        parts.append(text[start:end])
        if not single:
            spans.extend([(i, i + 1) for i in range(start, end)] if layer.origin is None
                         else layer.origin[start:end])

    def stretch() -> Layer:
        keep(last, reach)
        return Layer("".join(parts), layer.origin if single else spans)

    for m in pattern.finditer(text):
        found = decode(m)
        if found is None:
            continue
        if m.start() >= reach:
            if reach >= 0:
                yield stretch()
            parts, spans, start = [], [], m.start()
            while start > max(reach, 0) and text[start - 1] in REACHED:
                start -= 1
            last, reach = start, REACH.match(text, m.end()).end()
        keep(last, m.start())
        parts.append(found)
        if not single:
            spans.extend([layer.at(m.start(), m.end())] * len(found))
        last = m.end()
    if reach >= 0:
        yield stretch()


def url_run(m: re.Match) -> str | None:
    """The characters of a run of escapes; bytes that are none stay escapes."""
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    out = LONE_BYTE.sub(lambda c: f"%{ord(c[0]) - 0xDC00:02X}", text)
    return out if len(out) < len(m[0]) else None


def escape(m: re.Match) -> str | None:
    """As :func:`url_run`; halves of a pair without the other stay escapes."""
    if m[1]:
        text = bytes.fromhex(m[1].replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        out = LONE_HALF.sub(lambda c: f"\\u{ord(c[0]):04x}", text)
        return out if len(out) < len(m[1]) else None
    code = int(m[2] or m[3] or m[5], 16) if not m[4] else int(m[4])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Zstd:
    """A zstd frame with the interface of the other decompressors, fed
    little at a time, as little may become much."""
    def __init__(self):
        import zstandard

        self.inner, self.error = zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError
        self.held, self.at, self.eof, self.unused_data = b"", 0, False, b""

    def decompress(self, data: bytes, limit: int) -> bytes:
        self.held, self.at = (self.held[self.at:] + data, 0) if data else (self.held, self.at)
        out = []
        while self.at < len(self.held) and not self.eof and sum(map(len, out)) < limit:
            piece = self.held[self.at:self.at + 512]
            self.at += len(piece)
            try:
                out.append(self.inner.decompress(piece))
            except self.error as e:
                raise ValueError from e
            self.eof = self.inner.eof
        if self.eof:
            self.unused_data = self.inner.unused_data + self.held[self.at:]
        return b"".join(out)


def opener_of(data: bytes):
    """A decompressor for what ``data`` begins with, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return Zstd()
    return None


def inflated(data: bytes, source: Iterator[bytes], state: dict) -> Iterator[bytes]:
    """What the compressed streams that begin with ``data`` and go on in
    ``source`` hold, one after the other, as far as they can be read.
    ``state["ended"]`` tells whether the last one was whole."""
    opener = opener_of(data)
    while opener:
        try:
            out = opener.decompress(data, STEP)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, MemoryError):
            state["ended"] = state.get("ended", False) and not state.get("begun", True)
            return
        state["begun"] = True
        data = getattr(opener, "unconsumed_tail", b"")
        if out:
            yield out
        if opener.eof:
            state["ended"], data = True, opener.unused_data
            while len(data) < 6 and (more := next(source, b"")):
                data += more
            opener, state["begun"] = opener_of(data), False
        elif not out and not data and not (data := next(source, b"")):
            state["ended"] = False
            return


def texts_of(source: Iterator[bytes]) -> Iterator[tuple[str, bool, bool]]:
    """The blocks of a stream's text, whether it is large, and whether
    something may be lost where the block ends."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held, size, large = [], 0, False
    for data in chain(source, [None]):
        held.append(decoder.decode(data or b"", data is None))
        size += len(held[-1])
        large = large or size > STEP
        while size > LAYER_BYTES:
            text = "".join(held)
            end = LAYER_BYTES
            while end > LAYER_BYTES - OVERLAP and text[end - 1] in REACHED:
                end -= 1
            cut = end == LAYER_BYTES - OVERLAP
            yield text[:LAYER_BYTES if cut else end], True, cut
            held, size = [text[end:]], len(text) - end
    yield "".join(held), large, False


def unwrapped(run: str, clean: bool = True) -> tuple[Iterator[tuple[str, bool, bool]], bool] | None:
    """The blocks of the text behind a base64 run, through any compressed
    streams, and whether the run holds whole streams. Unless it must be
    ``clean``, bytes that are no UTF-8 are replaced."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        if clean:
            return None
        body = body[:-1]
    body = body.replace("-", "+").replace("_", "/")
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    source, seen, outer = iter(()), {hashlib.sha256(data).digest()}, None
    while opener_of(data) is not None:
        if len(seen) > MAX_PEELED:
            return iter([("", False, True)]), False
        state: dict = {}
        below = inflated(data, source, state)
        first = next(below, b"")
        while first and len(first) < 6 and (more := next(below, b"")):
            first += more
        if not first:
            break
        mark = hashlib.sha256(first).digest()
        if mark in seen and len(first) < STEP:  # a stream that unpacks to itself
            return None
        seen.add(mark if len(first) < STEP else len(seen))
        data, source, outer = first, below, outer or state
    if outer is None:
        if not ASCII_STRETCH.search(data):
            return None
        try:
            return iter([(data.decode("utf-8", "strict" if clean else "replace"), False, False)]), False
        except UnicodeDecodeError:
            return None
    blocks = texts_of(chain([data], source))
    first = next(blocks)
    return chain([first], blocks), outer.get("ended", False)


def shifted(run: str) -> Iterator[tuple[int, Iterator[tuple[str, bool, bool]]]]:
    """(offset, the blocks behind it) for a run that as a whole is no text:
    a part of it may be one, behind letters of the same alphabet (a path, a
    name). Text shows at one of the four alignments wherever it begins; a
    compressed stream must begin behind a sign."""
    for offset in range(4):
        if found := unwrapped(run[offset:], clean=False):
            yield offset, found[0]
    for sign in SIGN.finditer(run):
        if begins_stream(run, sign.end()) and (found := unwrapped(run[sign.end():], clean=False)):
            yield sign.end(), found[0]


def begins_stream(run: str, at: int) -> bool:
    """Whether a compressed stream begins at a place of a base64 run: by its
    mark, and by its first bytes."""
    def head(n: int) -> bytes:
        part = run[at:at + n].rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(part[:len(part) // 4 * 4])

    if opener_of(head(8)) is None:
        return False
    data = head(1 << 12)
    try:
        opener_of(data).decompress(data, STEP)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, MemoryError):
        return False
    return True


def decoded_runs(text: str) -> Iterator[tuple[int, int, Iterator[tuple[str, bool, bool]]]]:
    """(start, end, the blocks behind it) of the base64 runs. A run goes on
    over single line breaks while the lines are equally long; the last may be
    shorter, or no part of it, as when the streams end before it. Lines that give nothing together are tried
    one by one."""
    done = tried = 0
    for m in BASE64_RUN.finditer(text):
        if m.start() < done:
            continue
        if m.start() >= tried and m[0][-1] != "=":
            end, lines, line = m.end(), [m[0]], NEXT_LINE.match(text, m.end())
            while line and len(line[1]) == len(m[0]) and not line[2]:
                lines.append(line[1])
                end, line = line.end(), NEXT_LINE.match(text, line.end())
            whole = "".join(lines)
            ways = [(end, whole)] if len(lines) > 1 else []
            if line and 0 < len(line[1]) + len(line[2]) <= len(m[0]):
                ways = [(end, whole), (line.end(), whole + line[1] + line[2])]
            tried, best = end, None
            for end, run in ways:
                if found := unwrapped(run):
                    best = end, found[0]
                    if found[1]:
                        break
            if best:
                done = best[0]
                yield m.start(), *best
                continue
        if found := unwrapped(m[0]):
            yield m.start(), m.end(), found[0]
        else:
            for offset, blocks in shifted(m[0]):
                yield m.start() + offset, m.end(), blocks


def derived(layer: Layer) -> Iterator[Layer]:
    """The layers one step below ``layer``."""
    text = layer.text
    if "%" in text:
        yield from in_place(layer, URL_RUN, url_run)
    if "\\" in text or "&#" in text:
        yield from in_place(layer, ESCAPE, escape)
    for start, end, blocks in decoded_runs(text):
        for below, block, cut in blocks:
            yield Layer(below, layer.at(start, end), block, cut)


def scan(text: str) -> dict:
    """Counts of the base matches, and all spans as (kind, start, end, base)
    by start, kind and end."""
    first = list(matches(text))
    spans = {(start, kind, end): True for kind, start, end in first}
    n_cut, held, seen, most = 0, 0, set(), LAYER_BYTES + SHARE * len(text)
    # What is below each layer. The blocks of a large stream are gone through
    # one by one, so that no two are held, and do not count.
    work = deque([derived(Layer(text))])
    while work:
        layers = work.popleft()
        for below in layers:
            n_cut += below.cut
            origin = below.origin
            mark = (hashlib.sha256(below.text.encode("utf-8", "replace")).digest(),
                    origin if isinstance(origin, tuple) else (origin[0], origin[-1]))
            if mark in seen or below.text == text or not below.text:
                continue
            seen.add(mark)
            if not below.block and held + len(below.text) > most:
                n_cut += 1
                continue
            for kind, start, end in matches(below.text):
                s, e = below.at(start, end)
                spans.setdefault((s, kind, e), False)
            if below.block:
                work.appendleft(layers)
                work.appendleft(derived(below))
                break
            held += len(below.text)
            work.append(derived(below))
    counts = [sum(kind == k for kind, _, _ in first) for k in range(3)]
    return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "n_cut": n_cut,
            "spans": [{"kind": KINDS[k], "start": s, "end": e, "base": base}
                      for (s, k, e), base in sorted(spans.items())]}


def redacted(text: str, mask: str) -> str:
    """``text`` with every found stretch replaced; stretches that overlap
    become one."""
    out, last = [], 0
    for span in scan(text)["spans"]:
        if span["start"] >= last:
            out += [text[last:span["start"]], mask]
        last = max(last, span["end"])
    return "".join([*out, text[last:]]) if out else text


def secrets_of(text: Column) -> Column:
    """Struct of base counts and spans of a text column (null: empty)."""
    @F.arrow_udf(SPANS)
    def scanned(column: pa.Array) -> pa.Array:
        found = [scan(t.decode()) for part in byte_slices(column) for t in part]
        return pa.array(found, SPANS_ARROW)
    return scanned(text)


def redact(text: Column, mask: str = "[SECRET]") -> Column:
    """The text column with all secrets masked; null stays null."""
    @F.arrow_udf(StringType())
    def masked(column: pa.Array) -> pa.Array:
        out = [redacted(t.decode(), mask) for part in byte_slices(column) for t in part]
        valid = column.is_valid().to_pylist()
        return pa.array([t if v else None for t, v in zip(out, valid)], pa.string())
    return masked(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, n_assign, n_access, n_hex, n_cut, spans) per row
    of ``docs``: counts of the rules' matches in the text itself, and every
    span found in it or in a layer below it, in code points of the text.
    Null texts count as empty; repeated rows and null ids come back as they
    are; an empty table gives no rows; other columns are not read."""
    found = docs.select(F.col(id_col), secrets_of(F.col(text_col)).alias("_found"))
    return found.select(id_col, "_found.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars",
                   mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the same rows and columns, secrets masked and
    ``length_col`` (if it is there) set to the new number of characters."""
    out = docs.withColumn(text_col, redact(F.col(text_col), mask))
    if length_col in docs.columns:
        kept = F.when(F.col(text_col).isNotNull(), F.char_length(text_col).cast(docs.schema[length_col].dataType))
        out = out.withColumn(length_col, F.coalesce(kept, F.col(length_col)))
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(id_col, "n_assign", "n_access", "n_hex",
                        F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), "n_cut")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(table(spark, sf_dir, "documents")))

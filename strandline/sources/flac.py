"""FLAC streams (RFC 9639) as tables: metadata blocks, stream facts, seek points, frames, subframes, samples.

``read_*`` take files (path, content), as the binaryFile source gives them, and decode each file in
one Arrow task; files are independent, frames inside one are not. Not strict, a bad file gives a row
with its error. ``encode`` is the matching writer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.codes import LAYOUTS, RATE_CODES, SIZE_CODES, block_of
from strandline.functions.digest import crc_of
from strandline.operators.predict import FIXED, integrate_lpc_samples
from strandline.sources.bitio import Bits, BitWriter, Short
from strandline.sources.rice import KERNELS, RiceError

#: Fixed values of the format.
BLOCK_NAMES = ("streaminfo", "padding", "application", "seektable", "vorbis_comment", "cuesheet", "picture")
PLACEHOLDER = 0xFFFFFFFFFFFFFFFF


class FlacError(ValueError):
    pass


def blocks(data: bytes) -> Iterator[tuple[int, int, bool, int, int]]:
    """(index, type, last, offset of the payload, length) of each metadata block."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, index, last = 4, 0, False
    while not last:
        head = data[at : at + 4]
        if len(head) < 4:
            raise FlacError("metadata ends inside a block header")
        last, kind, length = bool(head[0] & 128), head[0] & 127, int.from_bytes(head[1:], "big")
        if kind == 127:
            raise FlacError("block type 127")
        if at + 4 + length > len(data):
            raise FlacError("metadata ends inside a block")
        yield index, kind, last, at + 4, length
        at, index = at + 4 + length, index + 1


@dataclass(frozen=True)
class StreamInfo:
    least_block: int
    most_block: int
    least_frame: int | None
    most_frame: int | None
    rate: int
    channels: int
    bits: int
    samples: int | None  # 0 in the file: unknown
    md5: str | None

    @classmethod
    def parse(cls, raw: bytes) -> StreamInfo:
        if len(raw) != 34:
            raise FlacError(f"a STREAMINFO of {len(raw)} bytes")
        b = Bits(raw)
        lo, hi, lf, hf = b.read(16), b.read(16), b.read(24), b.read(24)
        rate, channels, bits, samples = b.read(20), b.read(3) + 1, b.read(5) + 1, b.read(36)
        if lo < 16 or hi < lo or rate == 0 or bits < 4:
            raise FlacError("a STREAMINFO field is out of range")
        md5 = raw[18:].hex()
        return cls(lo, hi, lf or None, hf or None, rate, channels, bits, samples or None, None if md5 == "0" * 32 else md5)


def facts(data: bytes) -> tuple[StreamInfo, int]:
    """STREAMINFO, which must come once and first, and where the frames begin."""
    found = list(blocks(data))
    if found[0][1] != 0 or sum(b[1] == 0 for b in found) != 1:
        raise FlacError("STREAMINFO must be the first block and the only one")
    _, _, _, at, n = found[0]
    return StreamInfo.parse(data[at : at + n]), found[-1][3] + found[-1][4]


def frame_data_offset(data: bytes) -> int:
    """Where the frames begin, whatever STREAMINFO says."""
    return max(at + n for _, _, _, at, n in blocks(data))


def seek_points(data: bytes) -> list[tuple[int | None, int, int]]:
    """(first sample or None for a placeholder, offset from the first frame, samples); ascending, placeholders last."""
    tables = [b for b in blocks(data) if b[1] == 3]
    if len(tables) > 1:
        raise FlacError("two seek tables")
    if not tables:
        return []
    _, _, _, at, n = tables[0]
    if n % 18:
        raise FlacError("a seek table of broken points")
    out = []
    for p in range(at, at + n, 18):
        first = int.from_bytes(data[p : p + 8], "big")
        out.append((None if first == PLACEHOLDER else first, int.from_bytes(data[p + 8 : p + 16], "big"), int.from_bytes(data[p + 16 : p + 18], "big")))
    firsts = [x[0] for x in out]
    real = [x for x in firsts if x is not None]
    if firsts != real + [None] * (len(firsts) - len(real)) or any(a >= b for a, b in zip(real, real[1:], strict=False)):
        raise FlacError("seek points out of order")
    return out


def comments(data: bytes) -> dict[str, str]:
    """The tags of a stream's comment block, names in lower case, the first of a name; empty without one."""
    for _, kind, _, at, n in blocks(data):
        if kind == 4:
            raw, out = data[at : at + n], {}
            size = int.from_bytes(raw[:4], "little")
            p = 4 + size
            count = int.from_bytes(raw[p : p + 4], "little")
            p += 4
            for _ in range(count):
                size = int.from_bytes(raw[p : p + 4], "little")
                if p + 4 + size > n:
                    raise FlacError("a comment ends beyond its block")
                name, _, value = raw[p + 4 : p + 4 + size].decode("utf-8", "replace").partition("=")
                out.setdefault(name.lower(), value)
                p += 4 + size
            return out
    return {}


def with_comments(data: bytes, tags: dict[str, str], vendor: str = "strandline") -> bytes:
    """The stream with a comment block after STREAMINFO."""
    def sized(text: str) -> bytes:
        return len(text.encode()).to_bytes(4, "little") + text.encode()

    body = sized(vendor) + len(tags).to_bytes(4, "little") + b"".join(sized(f"{k}={v}") for k, v in tags.items())
    _, _, last, at, n = next(blocks(data))
    block = bytes([4 | (128 if last else 0)]) + len(body).to_bytes(3, "big") + body
    return data[:4] + bytes([data[4] & 127]) + data[5 : at + n] + block + data[at + n :]


@dataclass(frozen=True)
class FrameHeader:
    block: int
    rate: int
    channels: int
    layout: str
    bits: int
    number: int
    size: int  # bytes, CRC-8 included


def coded_number(b: Bits, shortest: bool = True) -> int:
    """The extended UTF-8 number, in its shortest form unless told otherwise."""
    lead = b.read(8)
    if lead < 0x80:
        return lead
    n = 8 - (lead ^ 0xFF).bit_length()
    if n < 2 or n > 7:
        raise FlacError("a coded number's lead byte")
    v = lead & ((1 << (7 - n)) - 1) if n < 7 else 0
    for _ in range(n - 1):
        x = b.read(8)
        if x >> 6 != 2:
            raise FlacError("a coded number's continuation")
        v = v << 6 | x & 63
    if shortest and v < 1 << (5 * (n - 1) + (1 if n > 2 else 2)):
        raise FlacError("a coded number in a longer form than it needs")
    return v


def frame_header(data: bytes, at: int, info: StreamInfo, shortest: bool = True) -> FrameHeader:
    """The header at a byte. shortest: a number in a longer form than it needs is refused."""
    b = Bits(data, at)
    if b.read(14) != 0x3FFE:
        raise FlacError("no frame sync")
    if b.read(1) or b.read(1):
        raise FlacError("a reserved bit, or variable block sizes")
    block_code, rate_code, layout_code, size_code, reserved = b.read(4), b.read(4), b.read(4), b.read(3), b.read(1)
    if reserved or block_code == 0 or rate_code == 15 or layout_code > 10 or size_code == 3:
        raise FlacError("a reserved code")
    number = coded_number(b, shortest)
    if number >= 1 << 31:
        raise FlacError("a frame number of over 31 bits")
    block = block_of(block_code)
    if block is None:
        block = b.read(8 * (block_code - 5)) + 1
        if block == 65536:
            raise FlacError("a block of 65,536")
    if rate_code == 0:
        rate = info.rate
    elif rate_code < 12:
        rate = RATE_CODES[rate_code]
    else:
        rate = b.read(8) * 1000 if rate_code == 12 else b.read(16) * (1 if rate_code == 13 else 10)
    end = b.at // 8
    if b.read(8) != crc_of("crc8", data[at:end]):
        raise FlacError("the header's CRC-8 differs")
    channels = 2 if layout_code > 7 else layout_code + 1
    return FrameHeader(block, rate, channels, LAYOUTS.get(layout_code, "independent"), SIZE_CODES.get(size_code, info.bits), number, end + 1 - at)


def residual(b: Bits, block: int, order: int, kernel: str = "table") -> tuple[list[int], dict]:
    """Residual after the warm-up, and its shape: partitions, largest parameter, escaped partitions. kernel reads the codes."""
    method = b.read(2)
    if method > 1:
        raise FlacError("a reserved residual method")
    width, escape = (4, 15) if method == 0 else (5, 31)
    p = b.read(4)
    part = block >> p
    if part << p != block or order >= part:
        raise FlacError("a partition order that doesn't fit the block")
    out: list[int] = []
    shape = {"partitions": 1 << p, "max_parameter": 0, "escaped": 0}
    for i in range(1 << p):
        n, k = part - order * (i == 0), b.read(width)
        if k == escape:
            raw = b.read(5)
            shape["escaped"] += 1
            out += [b.signed(raw) for _ in range(n)] if raw else [0] * n
            continue
        shape["max_parameter"] = max(shape["max_parameter"], k)
        try:
            out += KERNELS[kernel](b, n, k)
        except RiceError as error:
            raise FlacError(str(error)) from error
    return out, shape


def subframe(b: Bits, block: int, bits: int) -> tuple[list[int], dict]:
    """Samples and facts (kind, order, wasted and the residual's shape) of one subframe."""
    if b.read(1):
        raise FlacError("a subframe's padding bit")
    code = b.read(6)
    wasted = b.unary() + 1 if b.read(1) else 0
    bits -= wasted
    if bits < 1:
        raise FlacError("more wasted bits than bits")
    about = {"kind": "", "order": 0, "wasted": wasted, "partitions": 0, "max_parameter": 0, "escaped": 0, "shift": None, "coefficients": None}
    if code == 0:
        x, about["kind"] = [b.signed(bits)] * block, "constant"
    elif code == 1:
        x, about["kind"] = [b.signed(bits) for _ in range(block)], "verbatim"
    elif 8 <= code <= 12 or code >= 32:
        order = code - 8 if code < 32 else code - 31
        if order > block:
            raise FlacError("a predictor longer than its block")
        warm = [b.signed(bits) for _ in range(order)]
        if code < 32:
            weights, shift, about["kind"] = list(FIXED[order]), 0, "fixed"
        else:
            precision = b.read(4) + 1
            shift = b.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("a predictor's precision or shift")
            weights, about["kind"] = [b.signed(precision) for _ in range(order)], "lpc"
            about |= {"shift": shift, "coefficients": weights}
        e, shape = residual(b, block, order)
        about |= shape | {"order": order}
        x = integrate_lpc_samples(warm + e, weights, shift)
    else:
        raise FlacError(f"reserved subframe type {code}")
    return [v << wasted for v in x] if wasted else x, about


def frame(data: bytes, at: int, info: StreamInfo) -> tuple[FrameHeader, list[list[int]], list[dict], int]:
    """One frame: header, samples by channel, subframe facts, and where the next frame begins."""
    head = frame_header(data, at, info)
    b = Bits(data, at + head.size)
    slots, about = [], []
    for slot in range(head.channels):
        side = head.layout == "side_right" and slot == 0 or head.layout in ("left_side", "mid_side") and slot == 1
        x, a = subframe(b, head.block, head.bits + side)
        slots.append(x)
        about.append(a | {"slot": slot, "bits": head.bits + side, "exit_bit": b.at - at * 8})
    if head.layout != "independent":
        p, q = slots
        if head.layout == "left_side":
            slots = [p, [a - s for a, s in zip(p, q, strict=True)]]
        elif head.layout == "side_right":
            slots = [[s + r for s, r in zip(p, q, strict=True)], q]
        else:
            mids = [m << 1 | s & 1 for m, s in zip(p, q, strict=True)]
            slots = [[m + s >> 1 for m, s in zip(mids, q, strict=True)], [m - s >> 1 for m, s in zip(mids, q, strict=True)]]
    b.align()
    end = b.at // 8
    if b.read(16) != crc_of("crc16", data[at:end]):
        raise FlacError("the frame's CRC-16 differs")
    return head, slots, about, end + 2


def next_frame(data: bytes, at: int, info: StreamInfo) -> int | None:
    """The next byte from at on where a whole header parses and its CRC-8 agrees."""
    while (at := data.find(b"\xff\xf8", at)) >= 0:
        try:
            frame_header(data, at, info)
            return at
        except (FlacError, Short):
            at += 1
    return None


def walk(data: bytes, resync: bool = False, bounded: bool = True) -> Iterator[dict]:
    """Every frame in order; numbers must follow one another and, if bounded, the samples add up to the declaration.

    resync: damage gives a row with its error and the walk goes on at the next strict frame start.
    """
    info, at = facts(data)
    index, due, samples, damaged = 0, 0, 0, False
    while at < len(data):
        try:
            head, slots, about, end = frame(data, at, info)
            if head.number != due:
                raise FlacError(f"frame {head.number} where {due} is due")
        except (FlacError, Short) as error:
            if not resync:
                raise
            damaged = True
            yield {"index": index, "offset": at, "error": str(error)}
            nxt = next_frame(data, at + 1, info)
            if nxt is None:
                return
            at, index, due = nxt, index + 1, frame_header(data, nxt, info).number
            continue
        yield {"index": index, "offset": at, "bytes": end - at, "head": head, "slots": slots, "subframes": about, "error": None}
        at, index, due, samples = end, index + 1, due + 1, samples + head.block
    if bounded and not damaged and info.samples is not None and samples != info.samples:
        raise FlacError(f"{samples} samples, {info.samples} declared")


def walk_all(data: bytes) -> Iterator[dict]:
    """walk with resync, to the end whatever the declaration says."""
    yield from walk(data, resync=True, bounded=False)


_BLOCKS = "path string, idx int, type int, name string, last boolean, offset long, length long, error string"
_STREAMS = "path string, least_block int, most_block int, least_frame int, most_frame int, rate int, channels int, bits int, samples long, md5 string, frame_data long, error string"
_SEEKS = "path string, idx int, first_sample long, offset long, samples int, placeholder boolean, error string"
_FRAMES = (
    "path string, frame int, offset long, bytes long, header_bytes int, block int, rate int, channels int, layout string, bits int, number long, "
    "subframes array<struct<slot:int,kind:string,order:int,wasted:int,bits:int,partitions:int,max_parameter:int,escaped:int,exit_bit:long>>, left array<int>, right array<int>, error string"
)


def _table(files: DataFrame, schema: str, rows_of, strict: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ") if " " in c]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[dict] = []
                try:
                    for row in rows_of(bytes(content)):
                        rows.append({"path": path} | row)
                        if len(rows) == 64:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (FlacError, Short) as error:
                    if strict:
                        raise FlacError(f"{path}: {error}") from error
                    rows.append({"path": path, "error": str(error)})
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def read_blocks(files: DataFrame, strict: bool = True) -> DataFrame:
    return _table(files, _BLOCKS, lambda d: ({"idx": i, "type": t, "name": BLOCK_NAMES[t] if t < 7 else "reserved", "last": last, "offset": at, "length": n} for i, t, last, at, n in blocks(d)), strict)


def read_streams(files: DataFrame, strict: bool = True) -> DataFrame:
    def rows(d: bytes):
        info, at = facts(d)
        yield vars(info) | {"frame_data": at}

    return _table(files, _STREAMS, rows, strict)


def read_seek_points(files: DataFrame, strict: bool = True) -> DataFrame:
    def rows(d: bytes):
        _, at = facts(d)
        for i, (first, offset, n) in enumerate(seek_points(d)):
            if first is not None and offset >= len(d) - at:
                raise FlacError("a seek point beyond the frames")
            yield {"idx": i, "first_sample": first, "offset": offset, "samples": n, "placeholder": first is None}

    return _table(files, _SEEKS, rows, strict)


def read_tags(files: DataFrame, strict: bool = True) -> DataFrame:
    """path, title, artist: from the comments, else the file's stem and '?'."""
    def rows(d: bytes):
        tags = comments(d)
        yield {"title": tags.get("title", "").strip() or None, "artist": tags.get("artist", "").strip() or None}

    found = _table(files, "path string, title string, artist string, error string", rows, strict)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return found.select("path", F.coalesce("title", F.when(stem != "", stem), F.lit("?")).alias("title"), F.coalesce("artist", F.lit("?")).alias("artist"), "error")


def read_frames(files: DataFrame, strict: bool = True, resync: bool = False) -> DataFrame:
    """A row per frame with its samples by channel."""
    kept = ("slot", "kind", "order", "wasted", "bits", "partitions", "max_parameter", "escaped", "exit_bit")

    def rows(d: bytes):
        for f in walk(d, resync):
            if f["error"]:
                yield {"frame": f["index"], "offset": f["offset"], "error": f["error"]}
                continue
            h = f["head"]
            yield {
                "frame": f["index"], "offset": f["offset"], "bytes": f["bytes"], "header_bytes": h.size, "block": h.block, "rate": h.rate, "channels": h.channels, "layout": h.layout, "bits": h.bits, "number": h.number,
                "subframes": [{k: s[k] for k in kept} for s in f["subframes"]], "left": f["slots"][0], "right": f["slots"][1] if h.channels > 1 else None,
            }

    return _table(files, _FRAMES, rows, strict)


def pcm(frames: DataFrame) -> DataFrame:
    """path, i, left, right: the samples of read_frames, numbered through each file; mono repeats the left."""
    start = F.coalesce(F.sum("block").over(Window.partitionBy("path").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = frames.where("error is null").select("path", "left", "right", start.alias("__s")).select("path", "__s", F.posexplode(F.arrays_zip("left", F.coalesce("right", "left").alias("right"))).alias("__i", "__x"))
    return placed.select("path", (F.col("__s") + F.col("__i")).alias("i"), F.col("__x.left").alias("left"), F.col("__x.right").alias("right"))


def subframe_census(frames: DataFrame) -> DataFrame:
    """By kind and order: subframes and the worst residual shapes."""
    s = frames.where("error is null").select(F.explode("subframes").alias("s")).select("s.*")
    return s.groupBy("kind", "order").agg(F.count(F.lit(1)).alias("n"), F.max("wasted").alias("wasted"), F.max("partitions").alias("partitions"), F.max("max_parameter").alias("max_parameter"), F.max("escaped").alias("escaped"))


# writing


def number_bytes(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    n = next(n for n in range(2, 8) if v < 1 << (5 * n + 1))
    return bytes([(0xFF00 >> n) & 0xFF | v >> (6 * (n - 1))] + [0x80 | v >> (6 * i) & 63 for i in reversed(range(n - 1))])


def _rice_cost(e: list[int], k: int) -> int:
    return sum(((2 * v if v >= 0 else -2 * v - 1) >> k) + 1 + k for v in e)


def _put_subframe(w: BitWriter, x: list[int], bits: int, lpc: tuple[list[int], int] | None = None) -> None:
    merged = 0
    for v in x:
        merged |= v
    wasted = 0 if merged == 0 else (merged & -merged).bit_length() - 1
    x = [v >> wasted for v in x]
    width = bits - wasted

    def head(code: int) -> None:
        w.put(0, 1)
        w.put(code, 6)
        w.put(int(wasted > 0), 1)
        if wasted:
            w.unary(wasted - 1)

    if len(set(x)) == 1:
        head(0)
        w.put(x[0], width)
        return
    choices = []
    for order in range(min(5, len(x))):
        e = [x[i] - sum(c * x[i - k] for k, c in enumerate(FIXED[order], 1)) for i in range(order, len(x))]
        k = min(range(15), key=lambda k: (_rice_cost(e, k), k))
        choices.append((_rice_cost(e, k) + order * width, order, k, e))
    cost, order, k, e = min(choices)
    if lpc and len(x) > len(lpc[0]):
        weights, shift = lpc
        order = len(weights)
        e = [x[i] - (sum(c * x[i - k] for k, c in enumerate(weights, 1)) >> shift) for i in range(order, len(x))]
        k = min(range(15), key=lambda k: (_rice_cost(e, k), k))
        head(31 + order)
    elif cost >= len(x) * width:
        head(1)
        for v in x:
            w.put(v, width)
        return
    else:
        head(8 + order)
    for v in x[:order]:
        w.put(v, width)
    if lpc and len(x) > len(lpc[0]):
        w.put(14, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 15)
    w.put(0, 6)
    w.put(k, 4)
    for v in e:
        z = 2 * v if v >= 0 else -2 * v - 1
        w.unary(z >> k)
        w.put(z, k)


def encode(channels: list[list[int]], rate: int = 16384, bits: int = 16, block: int = 256, layout: str = "independent", lpc: tuple[list[int], int] | None = None, seek_every: int = 0) -> bytes:
    """A FLAC stream of one or two channels of equal length."""
    n = len(channels[0])
    frames, offset = [], 0
    for number, start in enumerate(range(0, n, block)):
        part = [c[start : start + block] for c in channels]
        size = len(part[0])
        code = 6 if size <= 256 else 7
        fixed = {192: 1, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(size, code)
        out = BitWriter()
        out.put(0x3FFE, 14)
        out.put(0, 2)
        out.put(fixed, 4)
        out.put(0, 4)
        out.put({"independent": len(part) - 1, "left_side": 8, "side_right": 9, "mid_side": 10}[layout], 4)
        out.put({8: 1, 12: 2, 16: 4, 20: 5, 24: 6}.get(bits, 0), 3)
        out.put(0, 1)
        for byte in number_bytes(number):
            out.put(byte, 8)
        if fixed in (6, 7):
            out.put(size - 1, 8 * (fixed - 5))
        out.put(crc_of("crc8", out.bytes()), 8)
        if layout == "independent":
            for x in part:
                _put_subframe(out, x, bits, lpc)
        else:
            left, right = part
            side = [a - b for a, b in zip(left, right, strict=True)]
            first = {"left_side": left, "side_right": side, "mid_side": [a + b >> 1 for a, b in zip(left, right, strict=True)]}[layout]
            second = right if layout == "side_right" else side
            _put_subframe(out, first, bits + (layout == "side_right"), lpc)
            _put_subframe(out, second, bits + (layout != "side_right"), lpc)
        out.align()
        raw = out.bytes()
        frames.append((offset, start, size, raw + crc_of("crc16", raw).to_bytes(2, "big")))
        offset += len(frames[-1][3])
    info = BitWriter()
    for v, width in ((max(16, min(block, n)), 16), (max(16, min(block, n)), 16), (min(len(f[3]) for f in frames), 24), (max(len(f[3]) for f in frames), 24), (rate, 20), (len(channels) - 1, 3), (bits - 1, 5), (n, 36)):
        info.put(v, width)
    head = info.bytes() + bytes(16)
    table = b"".join(s.to_bytes(8, "big") + o.to_bytes(8, "big") + size.to_bytes(2, "big") for i, (o, s, size, _) in enumerate(frames) if seek_every and i % seek_every == 0)
    out = b"fLaC" + bytes([0 if table else 128]) + len(head).to_bytes(3, "big") + head
    if table:
        out += bytes([128 | 3]) + len(table).to_bytes(3, "big") + table
    return out + b"".join(f[3] for f in frames)

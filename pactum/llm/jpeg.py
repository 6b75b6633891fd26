"""Baseline JPEG in numpy: writing DC-only grey images, reading any baseline image's DC-only luminance.

Reading is vectorised over *restart intervals*: each is a lane with its own
bit position, and all lanes of all images with the same tables advance block by
block together. Images without restart markers have one lane. Alternating
coefficients are decoded only to be skipped.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The luminance DC table of the standard (how many codes of each length, then the symbols).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: An AC table with end-of-block only, as the code 0.
AC_LENGTHS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)

INTERVAL = 24
MAX_ROWS = 8191


class JpegError(ValueError):
    pass


def huffman_codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at, code = at + n, code << 1
    return out


def huffman_lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix ``length << 8 | symbol``; 0 where no code matches."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for s, (code, bits) in huffman_codes(lengths, symbols).items():
        if code >> bits:
            raise JpegError("Huffman table is overfull")
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of every DC difference from -255 to 255 followed by end-of-block, and how many."""
    dc, eob = huffman_codes(DC_LENGTHS, DC_SYMBOLS), huffman_codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, size = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        kind = abs(d).bit_length()
        code, n = dc[kind]
        value = (code << kind | (d if d >= 0 else d + (1 << kind) - 1)) << eob[1] | eob[0]
        bits[d + 255], size[d + 255] = value, n + kind + eob[1]
    return bits, size


_CODES, _SIZES = _difference_codes()


def frame_shapes(n: int) -> list[tuple[int, int]]:
    """(width, rows) in blocks of the images that hold ``n`` values, a positive multiple of 576."""
    if n <= INTERVAL * MAX_ROWS:
        return [(INTERVAL, n // INTERVAL)]
    rows, out = n // 576, []
    while rows:
        out.append((576, min(rows, MAX_ROWS)))
        rows -= out[-1][1]
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, rows: int) -> bytes:
    """Everything before the entropy-coded data of a grey image of ``width`` by ``rows`` blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * width, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 576 bytes) as grey images, one flat block per byte: the DC coefficients are the bytes."""
    if not payloads:
        return []
    values = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int16).reshape(-1, INTERVAL)
    step = np.empty_like(values)
    step[:, 0] = values[:, 0] - 128
    step[:, 1:] = values[:, 1:] - values[:, :-1]
    step += 255
    size = _SIZES[step]
    offset = np.cumsum(size, axis=1) - size
    total = offset[:, -1] + size[:, -1]
    wide = int(total.max() + 7) // 8 + 3
    rows = np.arange(len(values))
    out = np.zeros((len(values), wide), dtype=np.uint8)
    flat, base = out.ravel(), rows * wide
    for k in range(INTERVAL):
        place = base + (offset[:, k] >> 3)
        word = _CODES[step[:, k]] << (24 - size[:, k] - (offset[:, k] & 7)).astype(np.uint32)
        flat[place] |= (word >> 16).astype(np.uint8)
        flat[place + 1] |= (word >> 8).astype(np.uint8)
        flat[place + 2] |= word.astype(np.uint8)
    used = (total + 7) >> 3
    flat[base + used - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)  # fill with ones
    shapes = [frame_shapes(len(p)) for p in payloads]
    frames = np.array([r * w // INTERVAL for s in shapes for w, r in s])
    ends = np.cumsum(frames)
    starts = ends - frames
    number = rows - np.repeat(starts, frames)
    last = np.zeros(len(values), dtype=bool)
    last[ends - 1] = True
    # two columns more for the marker that follows each interval
    data = np.concatenate([out, np.zeros((len(values), 2), np.uint8)], axis=1)
    flat, base = data.ravel(), rows * (wide + 2)
    flat[base + used] = 0xFF
    flat[base + used + 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    column = np.arange(wide + 2)
    inside = column < (used + 2)[:, None]
    coded = column < used[:, None]
    kept, stuffed = flat[inside.ravel()], (coded & (data == 0xFF)).ravel()[inside.ravel()]
    at = np.flatnonzero(stuffed) + 1
    scan = np.insert(kept, at, 0) if len(at) else kept
    length = inside.sum(axis=1) + (coded & (data == 0xFF)).sum(axis=1)
    bounds = np.concatenate([[0], np.cumsum(length)])
    whole, media, frame = scan.tobytes(), [], 0
    for s in shapes:
        parts = []
        for w, r in s:
            parts += [header(w, r), whole[bounds[starts[frame]] : bounds[ends[frame]]]]
            frame += 1
        media.append(b"".join(parts))
    return media


@dataclass
class Frame:
    """One parsed baseline image."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # DC step of each table
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id -> lengths and symbols
    interval: int = 0
    scans: list[tuple[list[tuple[int, int, int]], bytes]] = field(default_factory=list)  # (component, DC table, AC table)..., data
    end: int = 0


def parse(data: bytes, at: int = 0) -> Frame:
    """Markers of the image that starts at ``at``; ``end`` is the byte after it."""
    f = Frame()
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            break
        if at + 2 > len(data):
            raise JpegError("cut off")
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError("cut off")
        at += size
        try:
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    f.quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    f.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                depth, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not f.width or not f.height:
                    raise JpegError("only 8-bit images with both dimensions")
                f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise JpegError("not a baseline image")
            elif marker == 0xDD:
                f.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                ids = [c[0] for c in f.components]
                chosen = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                stop = at
                while True:
                    stop = data.find(b"\xff", stop)
                    if stop < 0 or stop + 1 >= len(data):
                        raise JpegError("no end of scan")
                    if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                        stop += 2
                    else:
                        break
                f.scans.append((chosen, data[at:stop]))
                at = stop
        except (IndexError, struct.error, ValueError) as e:
            raise JpegError(str(e) or "malformed segment") from e
    if not f.scans or not f.components:
        raise JpegError("no image")
    f.end = at
    return f


def _layout(f: Frame, chosen) -> tuple[list[int], int]:
    """Of each block of an MCU its place among the scan's components; number of MCUs."""
    top_h, top_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    if len(chosen) == 1:
        _, h, v, _ = f.components[chosen[0][0]]
        return [0], -(-(-(-f.width * h // top_h)) // 8) * -(-(-(-f.height * v // top_v)) // 8)
    blocks = [k for k, (c, _, _) in enumerate(chosen) for _ in range(f.components[c][1] * f.components[c][2])]
    return blocks, -(-f.width // (8 * top_h)) * -(-f.height // (8 * top_v))


def _luminance_scan(f: Frame):
    return next(s for s in f.scans if any(c[0] == 0 for c in s[0]))


def decode_luminance(frames: list[Frame]) -> list[np.ndarray | JpegError]:
    """The DC-only luminance thumbnail of each image: a byte per 8 by 8 block of component 0."""
    out: list = [None] * len(frames)
    groups: dict = {}
    for k, f in enumerate(frames):
        try:
            chosen, data = _luminance_scan(f)
            layout, mcus = _layout(f, chosen)
            if 2 * mcus * len(layout) > 8 * len(data):  # a code for the DC step and one for the end of each block
                out[k] = JpegError("scan too short for its dimensions")
                continue
            # lanes of about equal length together: arrays are as long as the longest
            key = (tuple(layout), tuple((f.tables[d], f.tables[0x10 | a]) for _, d, a in chosen), (f.interval or mcus).bit_length())
        except (KeyError, StopIteration):
            out[k] = JpegError("missing table or scan")
            continue
        groups.setdefault(key, []).append((k, f, data, mcus))
    for (layout, tables, _), members in groups.items():
        lookups = [(huffman_lookup(d[:16], d[16:]), huffman_lookup(a[:16], a[16:])) for d, a in tables]
        for (k, f, _, _), found in zip(members, _decode_lanes(members, list(layout), lookups), strict=True):
            out[k] = found if isinstance(found, JpegError) else _arrange(f, found)
    return out


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each interval starts."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.empty(0, np.int64)
    follow = raw[ff + 1] if len(ff) else np.empty(0, np.uint8)
    restart = ff[(follow & 0xF8) == 0xD0]
    drop = np.concatenate([ff[follow == 0] + 1, restart, restart + 1])
    keep = np.ones(len(raw), dtype=bool)
    keep[drop] = False
    position = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], np.concatenate([[0], position[restart]])


def _decode_lanes(members, layout: list[int], lookups) -> list:
    """Quantised DC values of component 0 in scan order, or an error, for each image."""
    pieces, lane_start, lane_end, lane_mcus, owner, at = [], [], [], [], [], 0
    for n, (_, f, data, mcus) in enumerate(members):
        raw, starts = _intervals(data)
        per = f.interval or mcus
        count = -(-mcus // per)
        starts = starts[:count]
        if len(starts) < count:
            starts = np.concatenate([starts, np.full(count - len(starts), len(raw))])
        pieces.append(raw)
        lane_start.append(starts + at)
        lane_end.append(np.append(starts[1:], len(raw)) + at)
        sizes = np.full(count, per)
        sizes[-1] = mcus - per * (count - 1)
        lane_mcus.append(sizes)
        owner.append(np.full(count, n))
        at += len(raw)
    data = np.concatenate([*pieces, np.zeros(8, np.uint8)])
    words = np.zeros(at + 1, dtype=np.uint64)
    for k in range(8):
        words |= data[k : at + 1 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    bit, limit, mcus, owner = (np.concatenate(x) for x in (lane_start, lane_end, lane_mcus, owner))
    bit, limit = bit * 8, limit * 8
    lanes, wanted = len(bit), layout.count(0)
    previous = np.zeros((len(lookups), lanes), dtype=np.int64)
    values = np.zeros((int(mcus.max()) * wanted, lanes), dtype=np.int32)
    bad = np.zeros(lanes, dtype=bool)

    def peek(position):
        return words[position >> 3] << (position & 7).astype(np.uint64)

    live = np.arange(lanes)
    for mcu in range(int(mcus.max())):
        bad[live] |= bit[live] > limit[live]
        live = live[(mcus[live] > mcu) & ~bad[live]]
        if not len(live):
            break
        slot = mcu * wanted
        for component in layout:
            dc, ac = lookups[component]
            position = bit[live]
            word = peek(np.minimum(position, 8 * at))
            code = dc[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            length, kind = code >> 8, code & 255
            word = word << length.astype(np.uint64)
            half = (np.int64(1) << kind) >> 1
            extra = ((word >> np.uint64(32)) >> (np.uint64(32) - kind.astype(np.uint64))).astype(np.int64)
            step = np.where(extra < half, extra - 2 * half + 1, extra)
            step[kind == 0] = 0
            position = position + length + kind
            bad[live] |= (length == 0) | (kind > 11)
            previous[component, live] += step
            if component == 0:
                values[slot, live] = previous[0, live]
                slot += 1
            # first the end-of-block that flat blocks have at once, then the rest
            word = word << kind.astype(np.uint64)
            code = ac[(word >> np.uint64(48)).astype(np.int64)]
            flat = (code & 255 == 0) & (code > 0)
            position = np.where(flat, position + (code >> 8), position)
            pending = np.flatnonzero(~flat & ~bad[live])
            index = np.ones(len(pending), dtype=np.int64)
            while len(pending):
                here = position[pending]
                code = ac[(peek(np.minimum(here, 8 * at)) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                length, symbol = code >> 8, code & 255
                run, kind = symbol >> 4, symbol & 15
                position[pending] = here + length + kind
                index += np.where(kind > 0, run + 1, np.where(run == 15, 16, 64))
                wrong = (length == 0) | (here > limit[live[pending]])
                bad[live[pending]] |= wrong
                more = (index < 64) & ~wrong
                pending, index = pending[more], index[more]
            bit[live] = position
    bad |= bit > limit
    failed = np.zeros(len(members), dtype=bool)
    failed[owner[bad]] = True
    out, bounds = [], np.searchsorted(owner, np.arange(len(members) + 1))
    for n, (_, f, _, total) in enumerate(members):
        if failed[n]:
            out.append(JpegError("damaged scan"))
            continue
        held = values[:, bounds[n] : bounds[n + 1]].T
        out.append(np.ascontiguousarray(held).ravel()[: total * wanted] if (f.interval or total) * wanted == held.shape[1] else np.concatenate([row[: m * wanted] for row, m in zip(held, mcus[bounds[n] : bounds[n + 1]], strict=True)]))
    return out


def _arrange(f: Frame, values: np.ndarray) -> np.ndarray:
    """Scan order to raster order, then to samples."""
    _, h, v, q = f.components[0]
    top_h, top_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    wide, high = -(-(-(-f.width * h // top_h)) // 8), -(-(-(-f.height * v // top_v)) // 8)
    if len(_luminance_scan(f)[0]) == 1:
        grid = values.reshape(high, wide)
    else:
        mw, mh = -(-f.width // (8 * top_h)), -(-f.height // (8 * top_v))
        grid = values.reshape(mh, mw, v, h).transpose(0, 2, 1, 3).reshape(mh * v, mw * h)[:high, :wide]
    step = f.quantisers.get(q)
    if step is None:
        return JpegError("missing quantiser")
    return np.clip(np.floor(grid * step / 8 + 0.5).astype(np.int64) + 128, 0, 255).astype(np.uint8)


def parse_all(data: bytes) -> list[Frame]:
    """All images of a stream of images; bytes after an image that start no other one are ignored."""
    frames, at = [], 0
    while at < len(data) and (not frames or data[at : at + 2] == b"\xff\xd8"):
        frames.append(parse(data, at))
        at = frames[-1].end
    if not frames:
        raise JpegError("no image")
    return frames


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash of the thumbnail, reduced to 8 rows of 9 means."""
    high, wide = thumb.shape
    rows, columns = np.arange(8) * high // 8, np.arange(9) * wide // 9
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), columns, axis=1)
    area = np.outer(np.maximum(np.diff(np.append(rows, high)), 1), np.maximum(np.diff(np.append(columns, wide)), 1))
    mean = sums / area
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()

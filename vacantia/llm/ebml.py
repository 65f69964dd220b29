"""EBML elements and the part of Matroska that packet tables need: tracks, clusters, blocks, lacing, cues."""

from __future__ import annotations

import struct

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Lacing: two bits of a block's flags.
NONE, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


#: The largest number of a signed 64-bit column.
MOST = (1 << 63) - 1


class Malformed(ValueError):
    """Bytes that aren't a whole element, block or lace."""


def vint(data, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place behind it; -1 for a size of all ones (unknown)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no vint at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"vint cut at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def as_vint(value: int, n: int = 0) -> bytes:
    n = n or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + as_vint(len(body)) + body


def number(id_: int, value: int) -> bytes:
    return element(id_, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def children(data, at: int, end: int):
    """(id, start of the element, start of its body, end of it) of each element; an unknown size reaches to the end."""
    while at < end:
        id_, p = vint(data, at, keep_marker=True)
        size, p = vint(data, p)
        stop = end if size < 0 else p + size
        if stop > end:
            raise Malformed(f"element {id_:X} at {at} leaves its parent")
        if size < 0 and id_ == CLUSTER:
            stop = _cluster_end(data, p, end)
        yield id_, at, p, stop
        at = stop


def _cluster_end(data, at: int, end: int) -> int:
    """A cluster of unknown size ends before the first element that only a segment holds."""
    while at < end:
        id_, p = vint(data, at, keep_marker=True)
        if id_ in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, p = vint(data, p)
        at = p + size
    return end


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block behind its flags."""
    if lacing == NONE:
        return b"".join(frames)
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames[:-1]]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif lacing == EBML_LACING and sizes:
        head += as_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            n = next(k for k in range(1, 9) if abs(b - a) < 1 << (7 * k - 1))
            head += as_vint(b - a + (1 << (7 * n - 1)) - 1, n)
    return head + b"".join(frames)


def frames_of(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block whose body behind the flags is data[at:end]."""
    if lacing == NONE:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("lace without a count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise Malformed("uneven fixed lace")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise Malformed("cut Xiph lace")
                size, at = size + data[at], at + 1
            else:
                before = at
                value, at = vint(data, at)
                value = (1 << 7 * (at - before)) - 1 if value < 0 else value
                size = value if k == 0 else sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Malformed("lace sizes don't fit the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def uint(data, at: int, end: int) -> int:
    """A whole number of up to eight bytes; those that no signed 64-bit column holds are refused."""
    out = int.from_bytes(data[at:end], "big")
    if out > MOST:
        raise Malformed("a number beyond 63 bits")
    return out


def _checked(packets: list[tuple], tracks: dict[int, dict]) -> None:
    """Times are products and sums of numbers that fit; numbers of tracks, kinds and channels are of 31 bits."""
    if any(abs(t) > MOST or (d or 0) > MOST or track >= 1 << 31 for track, t, d, *_ in packets):
        raise Malformed("a packet's time or track is out of range")
    if any(x >= 1 << 31 for t in tracks.values() for x in (t["number"], t["type"], t["channels"], t["bits"] or 0)):
        raise Malformed("a track's number is out of range")


def parse(data: bytes) -> tuple[list[tuple], list[tuple], dict[int, dict]]:
    """Packets, cues (time in ns, track, place of its cluster) and tracks by number.

    A packet is (track, timestamp in ns, duration in ns or None, offset, size, keyframe, lacing, cluster). Frames of one lace
    follow each other by the duration of the block over their number, where a group states it, else by the track's default
    duration; without either they all have the block's time.
    """
    packets, cues, clusters, tracks, scale = [], [], {}, {}, 1_000_000
    for id_, _, top, top_end in children(data, 0, len(data)):
        if id_ != SEGMENT:
            continue
        for part, start, at, end in children(data, top, top_end):
            if part == INFO:
                scale = next((uint(data, a, b) for i, _, a, b in children(data, at, end) if i == TIMESTAMP_SCALE), scale)
            elif part == TRACKS:
                for i, _, a, b in children(data, at, end):
                    if i == TRACK_ENTRY:
                        track = _track(data, a, b)
                        tracks[track["number"]] = track
            elif part == CLUSTER:
                clusters[start - top] = len(clusters)
                _cluster(data, at, end, scale, len(clusters) - 1, tracks, packets)
            elif part == CUES:
                for i, _, a, b in children(data, at, end):
                    if i == CUE_POINT:
                        _cue(data, a, b, scale, top, cues)
    if any(place not in clusters for _, _, place in cues):
        raise Malformed("a cue points at no cluster")
    _checked(packets, tracks)
    return packets, cues, tracks


def _float(data, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end - at in (4, 8) else 0.0


def _track(data, at: int, end: int) -> dict:
    """Number, type, codec and default duration of a track, and its rate, channels and bits if it is audio (else the defaults)."""
    out = {"number": 0, "type": 0, "codec": "", "duration": None, "rate": 8000.0, "channels": 1, "bits": None}
    for id_, _, a, b in children(data, at, end):
        if id_ in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            out[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration"}[id_]] = uint(data, a, b)
        elif id_ == CODEC:
            out["codec"] = bytes(data[a:b]).rstrip(b"\0").decode("ascii", "replace")
        elif id_ == AUDIO:
            for i, _, c, d in children(data, a, b):
                if i == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, c, d)
                elif i in (CHANNELS, BIT_DEPTH):
                    out["channels" if i == CHANNELS else "bits"] = uint(data, c, d)
    return out


def _cluster(data, at: int, end: int, scale: int, number_: int, tracks: dict, packets: list) -> None:
    base = 0
    for id_, _, a, b in children(data, at, end):
        if id_ == TIMESTAMP:
            base = uint(data, a, b)
        elif id_ == SIMPLE_BLOCK:
            _block(data, a, b, base, scale, number_, None, None, tracks, packets)
        elif id_ == BLOCK_GROUP:
            inner = list(children(data, a, b))
            key = not any(i == REFERENCE for i, *_ in inner)
            whole = next((uint(data, c, d) * scale for i, _, c, d in inner if i == BLOCK_DURATION), None)
            for i, _, c, d in inner:
                if i == BLOCK:
                    _block(data, c, d, base, scale, number_, key, whole, tracks, packets)


def _block(data, at: int, end: int, base: int, scale: int, cluster: int, key: bool | None, whole: int | None, tracks: dict, packets: list) -> None:
    track, at = vint(data, at)
    if at + 3 > end:
        raise Malformed("cut block")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    keyframe = bool(flags & 0x80) if key is None else key
    frames = frames_of(data, at + 3, end, lacing)
    duration = whole // len(frames) if whole is not None else tracks.get(track, {}).get("duration")
    for k, (offset, size) in enumerate(frames):
        packets.append((track, (base + relative) * scale + k * (duration or 0), duration, offset, size, keyframe, lacing, cluster))


def _cue(data, at: int, end: int, scale: int, segment: int, cues: list) -> None:
    time = 0
    for id_, _, a, b in children(data, at, end):
        if id_ == CUE_TIME:
            time = uint(data, a, b) * scale
        elif id_ == CUE_POSITIONS:
            found = {i: uint(data, c, d) for i, _, c, d in children(data, a, b)}
            cues.append((time, found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER, -1)))

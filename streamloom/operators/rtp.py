"""Frames from RTP packets: per codec, which packets make a frame and what of them is payload.

Packets are taken in the order given (as a jitter window releases them). A frame that misses a packet is dropped, as is
what follows of it up to the next packet that can start one.
"""

from __future__ import annotations

from .folds import State, fold

SCHEMA = "time long, n long, key boolean, payload binary"


class Frames(State):
    """What packets of one sender add up to. A subclass says of each payload whether it starts a frame and what it adds."""

    def __init__(self, size: int = 1 << 16):
        self.size, self.expected, self.parts, self.time, self.key, self.n = size, None, None, None, False, 0

    def parse(self, payload: bytes) -> tuple[bool, list[bytes], bool]:
        """(whether a frame may start here, bytes to add, key) of a payload; ValueError if it is none."""
        raise NotImplementedError

    def whole(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)

    def take(self, out, numbers, times, marks, payloads):
        for number, time, mark, payload in zip(numbers, times, marks, payloads):
            broken = self.expected is not None and number != self.expected
            self.expected = (number + 1) % self.size
            try:
                start, add, key = self.parse(payload or b"")
            except (ValueError, IndexError):
                self.parts = None
                continue
            if broken or self.parts is not None and time != self.time:
                self.parts = None
            if self.parts is None:
                if not start:
                    continue
                self.parts, self.time, self.key = [], time, False
            self.parts += add
            self.key |= key
            if mark:
                out.append((self.time, self.n, self.key, self.whole(self.parts)))
                self.parts, self.n = None, self.n + 1


class Opus(Frames):
    """Each packet is a frame, whatever its mark."""

    def take(self, out, numbers, times, marks, payloads):
        super().take(out, numbers, times, [True] * len(marks), payloads)

    def parse(self, payload):
        if not payload:
            raise ValueError
        return True, [payload], True


class Vp8(Frames):
    """RFC 7741: a descriptor of one to six bytes; partition 0's start begins a frame."""

    def parse(self, payload):
        first, at = payload[0], 1
        if first & 0x80:
            more, at = payload[1], 2
            if more & 0x80:
                at += 2 if payload[at] & 0x80 else 1
            at += bool(more & 0x40) + bool(more & 0x30)
        if at >= len(payload):
            raise ValueError
        start = bool(first & 0x10) and not first & 0x07
        return start, [payload[at:]], start and not payload[at] & 1


class H264(Frames):
    """RFC 6184: single units, aggregates (type 24) and fragments (type 28), as units with start codes."""

    CODE = b"\0\0\0\1"

    def parse(self, payload):
        kind = payload[0] & 0x1F
        if 1 <= kind <= 23:
            return True, [self.CODE + payload], kind == 5
        if kind == 24:
            units, at = [], 1
            while at < len(payload):
                size = int.from_bytes(payload[at : at + 2], "big")
                unit = payload[at + 2 : at + 2 + size]
                if not size or len(unit) < size:
                    raise ValueError
                units.append(self.CODE + unit)
                at += 2 + size
            return True, units, any(u[4] & 0x1F == 5 for u in units)
        if kind == 28:
            head, first = payload[1], bool(payload[1] & 0x80)
            own = self.CODE + bytes([payload[0] & 0xE0 | head & 0x1F]) if first else b""
            return first, [own + payload[2:]], head & 0x1F == 5
        raise ValueError


class Vp9(Frames):
    """RFC 9628: a descriptor with picture number, layers, references and structure; a beginning starts a frame."""

    def parse(self, payload):
        first, at = payload[0], 1
        if first & 0x80:
            at += 2 if payload[at] & 0x80 else 1
        if first & 0x20:
            at += 1 if first & 0x10 else 2
        if first & 0x50 == 0x50:
            while payload[at] & 1:
                at += 1
            at += 1
        if first & 0x02:
            shape = payload[at]
            at += 1 + (4 * ((shape >> 5) + 1) if shape & 0x10 else 0)
            if shape & 0x08:
                pictures, at = payload[at], at + 1
                for _ in range(pictures):
                    at += 1 + (payload[at] >> 2 & 3)
        if at >= len(payload):
            raise ValueError
        return bool(first & 0x08), [payload[at:]], not first & 0x40


class Av1(Frames):
    """The AV1 payload format: elements with lengths, continued from packet to packet; out come units with their sizes."""

    def parse(self, payload):
        first, at, parts = payload[0], 1, []
        count, n = first >> 4 & 3, 0
        while at < len(payload):
            n += 1
            if count and n == count:
                size = len(payload) - at
            else:
                size = shift = 0
                while True:
                    b, at = payload[at], at + 1
                    size |= (b & 0x7F) << shift
                    shift += 7
                    if not b & 0x80:
                        break
            if at + size > len(payload):
                raise ValueError
            # a marker tells an element that goes on from one that starts
            parts.append((b"+" if n == 1 and first & 0x80 else b"=") + payload[at : at + size])
            at += size
        if first & 0x40 and parts:
            parts.append(b"~")
        return not first & 0x80, parts, bool(first & 0x08)

    def whole(self, parts):
        units: list[bytearray] = []
        for p in parts:
            if p[:1] == b"=":
                units.append(bytearray(p[1:]))
            elif p[:1] == b"+" and units:
                units[-1] += p[1:]
        out = b""
        for u in units:
            if not u or u[0] >> 3 & 15 == 2:  # temporal delimiters aren't kept
                continue
            head = 2 if u[0] & 4 else 1
            body = bytes(u[head:])
            size, left = b"", len(body)
            while True:
                size += bytes([left & 0x7F | (0x80 if left > 0x7F else 0)])
                left >>= 7
                if not left:
                    break
            out += bytes([u[0] | 2]) + bytes(u[1:head]) + size + body
        return out


CODECS = {"opus": Opus, "vp8": Vp8, "vp9": Vp9, "h264": H264, "av1": Av1}


def depacketize(df, key: str, order: list[str], columns: list[str], codec: str):
    """(key, time, n, key frame, payload) of whole frames from columns: sequence number, time, marker, payload."""
    return fold(df, key, order, columns, CODECS[codec], f"{key} long, {SCHEMA}")

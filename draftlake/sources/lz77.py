"""The LZ77 variant of paged containers: runs of literals and back references, after the published format description.

A stream is a literal run, then references, each followed by literals. A reference's lowest two bits (of its own byte in
the short form, of the two-byte offset else) count its literals; zero says that a run length follows. Offsets count from
one byte back; the far form adds 0x3FFF. 0x11 ends the stream.
"""

from __future__ import annotations

END, FAR = 0x11, 0x3FFF
_SHORT_LENGTH, _SHORT_OFFSET = 14, 1 << 10
_NEAR, _REACH = 0x3FFF, 0x7FFE


class BadStream(ValueError):
    """Bytes that are no such stream."""


def _more(data: bytes, at: int) -> tuple[int, int]:
    """A count spread over zero bytes of 255 each and a last byte; and where it ends."""
    total = 0
    while data[at] == 0:
        total, at = total + 0xFF, at + 1
    return total + data[at], at + 1


def decompress(data: bytes, size: int) -> bytes:
    """The text of a stream, cut or filled with zeros to the given size."""
    out = bytearray()
    try:
        at, run = _literals(data, 0)
        out += _taken(data, at, run)
        at += run
        while at < len(data) and (op := data[at]) != END:
            at += 1
            if op >= 0x40:
                length, offset, run = (op >> 4) - 1, data[at] << 2 | (op & 0x0C) >> 2, op & 3
                at += 1
            elif op >= 0x10:
                far = op < 0x20
                length = (op & 0x0F) + 2 if far and op & 0x0F else op - 0x1E if op > 0x20 else 0
                if not length:
                    length, at = _more(data, at)
                    length += 9 if far else 0x21
                word = data[at] | data[at + 1] << 8
                offset, run, at = (word >> 2) + (FAR if far else 0), word & 3, at + 2
            else:
                raise BadStream(f"byte {op:#04x} opens no reference")
            if not run:
                at, run = _literals(data, at)
            start = len(out) - offset - 1
            if start < 0:
                raise BadStream("a reference to before the start")
            for k in range(length):
                out.append(out[start + k])
            out += _taken(data, at, run)
            at += run
    except IndexError:
        raise BadStream("the stream ends early") from None
    return bytes(out[:size].ljust(size, b"\0"))


def _taken(data: bytes, at: int, run: int) -> bytes:
    if at + run > len(data):
        raise BadStream("the stream ends early")
    return data[at : at + run]


def _literals(data: bytes, at: int) -> tuple[int, int]:
    """Where the literals start and how many; a byte of 0x10 and above is the next reference and stands for none."""
    first = data[at]
    if first >= 0x10:
        return at, 0
    if first:
        return at + 1, first + 3
    total, at = _more(data, at + 1)
    return at, total + 0x0F + 3


def _spread(n: int) -> bytes:
    zeros, last = divmod(n - 1, 0xFF)
    return b"\0" * zeros + bytes([last + 1])


def _run(n: int) -> bytes:
    """The length of a run of at least four literals."""
    return bytes([n - 3]) if n <= 0x12 else b"\0" + _spread(n - 0x12)


def compress(data: bytes) -> bytes:
    """A stream that ``decompress`` reads back: greedy, by the last place of each four bytes."""
    last: dict[bytes, int] = {}
    refs: list[tuple[int, int, int]] = []  # start, length, offset
    at = 4
    for k in range(min(4, max(len(data) - 3, 0))):
        last[data[k : k + 4]] = k
    while at + 4 <= len(data):
        key = data[at : at + 4]
        found = last.get(key, -1)
        last[key] = at
        if found >= 0 and at - found - 1 <= _REACH:
            length = 4
            while at + length < len(data) and data[found + length] == data[at + length]:
                length += 1
            refs.append((at, length, at - found - 1))
            for k in range(at + 1, min(at + length, len(data) - 3)):
                last[data[k : k + 4]] = k
            at += length
        else:
            at += 1
    out, edge = bytearray(), refs[0][0] if refs else len(data)
    if edge >= 4:
        out += _run(edge) + data[:edge]
    elif edge:
        raise BadStream("fewer than four bytes have no stream")
    for (start, length, offset), following in zip(refs, [*(r[0] for r in refs[1:]), len(data)]):
        tail = data[start + length : following]
        few = len(tail) if len(tail) < 4 else 0
        if offset > _NEAR:
            head = bytes([0x10 | length - 2]) if length <= 17 else b"\x10" + _spread(length - 9)
            out += head + ((offset - FAR) << 2 | few).to_bytes(2, "little")
        elif length <= _SHORT_LENGTH and offset < _SHORT_OFFSET:
            out += bytes([(length + 1) << 4 | (offset & 3) << 2 | few, offset >> 2])
        else:
            head = bytes([length + 0x1E]) if length <= 0x21 else b"\x20" + _spread(length - 0x21)
            out += head + (offset << 2 | few).to_bytes(2, "little")
        out += tail if few else (_run(len(tail)) + tail if tail else b"")
    return bytes(out) + bytes([END, 0, 0])

"""Bit-level scalar codecs of binary drawings, read and write. Rows leave these kernels typed.

Bits run from the highest of each byte. Two-bit prefixes choose short forms of integers and doubles; modular numbers
carry seven bits a byte. A reader past its end raises.
"""

from __future__ import annotations

import struct


class OutOfBits(ValueError):
    pass


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def bits(self, n: int) -> int:
        if self.at + n > self.end:
            raise OutOfBits(f"{n} bits at {self.at} of {self.end}")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def raw(self, n: int) -> bytes:
        return self.bits(8 * n).to_bytes(n, "big")

    def flag(self) -> bool:
        return bool(self.bits(1))

    def bits2(self) -> int:
        return self.bits(2)

    def u8(self) -> int:
        return self.bits(8)

    def u16(self) -> int:
        return int.from_bytes(self.raw(2), "little")

    def u32(self) -> int:
        return int.from_bytes(self.raw(4), "little")

    def u64(self) -> int:
        return int.from_bytes(self.raw(8), "little")

    def f64(self) -> float:
        return struct.unpack("<d", self.raw(8))[0]

    def short(self) -> int:
        return (self.u16, self.u8, lambda: 0, lambda: 256)[self.bits(2)]()

    def long(self) -> int:
        kind = self.bits(2)
        if kind == 3:
            return 0
        return (self.u32, self.u8, lambda: 0)[kind]()

    def long_long(self) -> int:
        return int.from_bytes(self.raw(self.bits(3)), "little")

    def double(self) -> float:
        kind = self.bits(2)
        return self.f64() if kind == 0 else 1.0 if kind == 1 else 0.0

    def point3(self) -> tuple[float, float, float]:
        return self.double(), self.double(), self.double()

    def double_from(self, default: float) -> float:
        """A double that may share its high bytes with a default."""
        kind = self.bits(2)
        old = bytearray(struct.pack("<d", default))
        if kind == 0:
            return default
        if kind == 1:
            old[0:4] = self.raw(4)
        elif kind == 2:
            old[4:6] = self.raw(2)
            old[0:4] = self.raw(4)
        else:
            return self.f64()
        return struct.unpack("<d", bytes(old))[0]

    def thickness(self) -> float:
        return 0.0 if self.flag() else self.double()

    def extrusion(self) -> tuple[float, float, float]:
        return (0.0, 0.0, 1.0) if self.flag() else self.point3()

    def handle(self) -> tuple[int, int]:
        """(code, value); values of more than eight bytes are refused."""
        code, n = self.bits(4), self.bits(4)
        if n > 8:
            raise ValueError(f"handle of {n} bytes")
        return code, int.from_bytes(self.raw(n), "big")

    def modular_short(self) -> int:
        value = shift = 0
        while True:
            word = self.u16()
            value |= (word & 0x7FFF) << shift
            shift += 15
            if not word & 0x8000:
                return value

    def modular(self, signed: bool = False) -> int:
        value = shift = 0
        while True:
            b = self.u8()
            if b & 0x80:
                value |= (b & 0x7F) << shift
                shift += 7
            elif signed:
                value |= (b & 0x3F) << shift
                return -value if b & 0x40 else value
            else:
                return value | b << shift

    def text(self, codepage: str = "latin-1") -> str:
        return self.raw(self.short()).rstrip(b"\0").decode(codepage, "replace")

    def unicode(self) -> str:
        return self.raw(2 * self.short()).decode("utf-16-le", "replace").rstrip("\0")


class BitWriter:
    def __init__(self):
        self.value, self.at = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value = self.value << n | value & ((1 << n) - 1)
        self.at += n

    def done(self) -> bytes:
        """The bytes, the last one filled up with zero bits."""
        pad = -self.at % 8
        return (self.value << pad).to_bytes((self.at + pad) // 8, "big")

    def raw(self, data: bytes) -> None:
        self.bits(int.from_bytes(data, "big"), 8 * len(data))

    def flag(self, v: bool) -> None:
        self.bits(int(v), 1)

    def bits2(self, v: int) -> None:
        self.bits(v, 2)

    def u8(self, v: int) -> None:
        self.bits(v, 8)

    def u16(self, v: int) -> None:
        self.raw(v.to_bytes(2, "little"))

    def u32(self, v: int) -> None:
        self.raw(v.to_bytes(4, "little"))

    def u64(self, v: int) -> None:
        self.raw(v.to_bytes(8, "little"))

    def f64(self, v: float) -> None:
        self.raw(struct.pack("<d", v))

    def short(self, v: int) -> None:
        kind = 2 if v == 0 else 3 if v == 256 else 1 if v < 256 else 0
        self.bits(kind, 2)
        if kind == 0:
            self.u16(v)
        elif kind == 1:
            self.u8(v)

    def long(self, v: int) -> None:
        kind = 2 if v == 0 else 1 if v < 256 else 0
        self.bits(kind, 2)
        if kind == 0:
            self.u32(v)
        elif kind == 1:
            self.u8(v)

    def long_long(self, v: int) -> None:
        n = (v.bit_length() + 7) // 8
        self.bits(n, 3)
        self.raw(v.to_bytes(n, "little"))

    def double(self, v: float) -> None:
        kind = 1 if v == 1.0 else 2 if struct.pack("<d", v) == bytes(8) else 0
        self.bits(kind, 2)
        if kind == 0:
            self.f64(v)

    def point3(self, p: tuple[float, float, float]) -> None:
        for v in p:
            self.double(v)

    def double_from(self, v: float, default: float) -> None:
        new, old = struct.pack("<d", v), struct.pack("<d", default)
        if new == old:
            self.bits(0, 2)
        elif new[4:] == old[4:]:
            self.bits(1, 2)
            self.raw(new[:4])
        elif new[6:] == old[6:]:
            self.bits(2, 2)
            self.raw(new[4:6])
            self.raw(new[:4])
        else:
            self.bits(3, 2)
            self.f64(v)

    def thickness(self, v: float) -> None:
        self.flag(v == 0)
        if v != 0:
            self.double(v)

    def extrusion(self, p: tuple[float, float, float]) -> None:
        self.flag(p == (0.0, 0.0, 1.0))
        if p != (0.0, 0.0, 1.0):
            self.point3(p)

    def handle(self, code: int, value: int) -> None:
        n = (value.bit_length() + 7) // 8
        self.bits(code, 4)
        self.bits(n, 4)
        self.raw(value.to_bytes(n, "big"))

    def modular_short(self, v: int) -> None:
        while v >> 15:
            self.u16(v & 0x7FFF | 0x8000)
            v >>= 15
        self.u16(v)

    def modular(self, v: int, signed: bool = False) -> None:
        rest, last = abs(v), 6 if signed else 7
        while rest >> last:
            self.u8(rest & 0x7F | 0x80)
            rest >>= 7
        self.u8(rest | (0x40 if signed and v < 0 else 0))

    def text(self, v: str, codepage: str = "latin-1") -> None:
        data = v.encode(codepage, "replace") + b"\0"
        self.short(len(data))
        self.raw(data)

    def unicode(self, v: str) -> None:
        data = (v + "\0").encode("utf-16-le")
        self.short(len(data) // 2)
        self.raw(data)


def crc16(data: bytes, seed: int = 0xC0C1) -> int:
    """Reflected CRC-16 of polynomial 0xA001."""
    for b in data:
        seed ^= b
        for _ in range(8):
            seed = seed >> 1 ^ (0xA001 if seed & 1 else 0)
    return seed


def page_checksum(data: bytes, seed: int = 0) -> int:
    """Two running sums modulo 65521, in blocks that can't overflow."""
    a, b = seed & 0xFFFF, seed >> 16
    for i in range(0, len(data), 0x15B0):
        for x in data[i : i + 0x15B0]:
            a += x
            b += a
        a %= 0xFFF1
        b %= 0xFFF1
    return b << 16 | a


def key_stream(n: int, seed: int = 1) -> bytes:
    """Bytes of the linear congruential generator that masks file headers. Its factor and step."""
    out = bytearray()
    for _ in range(n):
        seed = (seed * 0x343FD + 0x269EC3) & 0xFFFFFFFF
        out.append(seed >> 16 & 0xFF)
    return bytes(out)


def unmask(data: bytes) -> bytes:
    return bytes(a ^ b for a, b in zip(data, key_stream(len(data))))


#: Codes of relative references: the value is added to or taken from the base, or is one next to it.
def resolve_handle(code: int, value: int, base: int) -> int:
    return {6: base + 1, 8: base - 1, 10: base + value, 12: base - value}.get(code, value)


def object_map(chunk: bytes) -> list[tuple[int, int]]:
    """(handle, offset) pairs of a chunk: running sums of modular deltas; a pair whose sums leave the range is left
    out and its deltas undone."""
    r, handle, offset, out = BitReader(chunk), 0, 0, []
    while r.at < r.end:
        try:
            dh, do = r.modular(), r.modular(signed=True)
        except OutOfBits:
            break
        if handle + dh <= 0 or offset + do < 0:
            continue
        handle, offset = handle + dh, offset + do
        out.append((handle, offset))
    return out

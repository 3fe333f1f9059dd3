"""The paged container of R2004 files and of R2010 and later: a masked header, a map of pages, a map of named sections.

Header and page heads are masked; maps and pages are compressed by the codec of ``lz77``. Damage raises ValueError.
"""

from __future__ import annotations

import struct

from .bits import unmask
from .lz77 import compress, decompress

#: Releases with this container, marks and places of its parts, the size of a page.
PAGED = ("AC1018", "AC1024", "AC1027", "AC1032")
HEADER_AT, HEADER_SIZE, PAGES_FROM = 0x80, 0x6C, 0x100
PAGE_MAP, SECTION_MAP, DATA_PAGE, PAGE_MASK = 0x41630E3B, 0x4163003B, 0x4163043B, 0x4164536B
PAGE_SIZE = 0x7400
FILE_MARK = b"AcFssFcAJMB\0"
#: No sound page is larger; a size beyond it is damage, not a request for memory.
LARGEST_PAGE = 1 << 24


def _ints(data: bytes, at: int, n: int) -> tuple[int, ...]:
    if at < 0 or at + 4 * n > len(data):
        raise ValueError(f"{n} numbers at {at} of {len(data)}")
    return struct.unpack_from(f"<{n}I", data, at)


def _map(data: bytes, at: int, mark: int) -> bytes:
    """The content of a page map or section map."""
    found, size, packed, form, _ = _ints(data, at, 5)
    if found != mark or form not in (1, 2) or size > LARGEST_PAGE or at + 20 + packed > len(data):
        raise ValueError(f"no map at {at}")
    content = data[at + 20 : at + 20 + packed]
    return decompress(content, size) if form == 2 else content[:size]


def _pages(data: bytes, at: int) -> dict[int, int]:
    """Page number to address; gaps take room but have no number."""
    content, place, address, out = _map(data, at, PAGE_MAP), 0, PAGES_FROM, {}
    while place + 8 <= len(content):
        number, size = struct.unpack_from("<iI", content, place)
        if number > 0:
            out[number] = address
        address += size
        place += 8 if number >= 0 else 24
    return out


def _masked(head: bytes, address: int) -> bytes:
    mask = (PAGE_MASK ^ address) & 0xFFFFFFFF
    return struct.pack("<8I", *(v ^ mask for v in struct.unpack("<8I", head)))


def sections(data: bytes) -> dict[str, bytes]:
    """Content of each section by name; encrypted ones are left out."""
    header = unmask(data[HEADER_AT : HEADER_AT + HEADER_SIZE])
    if len(header) < HEADER_SIZE or not header.startswith(FILE_MARK):
        raise ValueError("no header of a paged file")
    (pages_at,), (map_page,) = struct.unpack_from("<Q", header, 0x54), struct.unpack_from("<I", header, 0x5C)
    pages = _pages(data, pages_at + PAGES_FROM)
    if map_page not in pages:
        raise ValueError(f"no page {map_page}")
    content = _map(data, pages[map_page], SECTION_MAP)
    at, out = 20, {}
    for _ in range(_ints(content, 0, 1)[0]):
        if at + 96 > len(content):
            raise ValueError("section map cut off")
        size, count, most, _, form, _, secret = struct.unpack_from("<Q6I", content, at)
        name = content[at + 32 : at + 96].split(b"\0")[0].decode("latin-1")
        at += 96
        if most > LARGEST_PAGE or count > len(pages) or at + 16 * count > len(content):
            raise ValueError(f"section {name} of {count} pages of {most}")
        parts = [struct.unpack_from("<IIQ", content, at + 16 * i) for i in range(count)]
        at += 16 * count
        if name and secret != 1:
            out[name] = _assembled(data, pages, parts, min(size, most * count), most, form == 2)
    return out


def _assembled(data: bytes, pages: dict[int, int], parts: list[tuple[int, int, int]], size: int, most: int, packed: bool) -> bytes:
    """Pages put at their starts; room that no page fills stays zero."""
    out = bytearray(size)
    for number, _, start in parts:
        address = pages.get(number)
        if address is None:
            raise ValueError(f"no page {number}")
        if address + 32 > len(data):
            raise ValueError(f"page {number} at {address} of {len(data)}")
        mark, _, length = struct.unpack_from("<3I", _masked(data[address : address + 32], address))
        if mark != DATA_PAGE or address + 32 + length > len(data):
            raise ValueError(f"page {number} is none")
        content = data[address + 32 : address + 32 + length]
        content = (decompress(content, most) if packed else content)[: max(0, size - start)]
        if start < size:
            out[start : start + len(content)] = content
    return bytes(out)


def write(parts: dict[str, bytes], version: str, codepage: int) -> bytes:
    """A paged file of these sections."""
    head = bytearray(version.encode().ljust(HEADER_AT, b"\0"))
    head[0x13:0x15] = codepage.to_bytes(2, "little")
    body, listed, entries = bytearray(), [], bytearray()

    def add(content: bytes) -> int:
        content += bytes(-len(content) % 32)
        body.extend(content)
        listed.append(len(content))
        return len(listed)

    for number, (name, content) in enumerate(parts.items(), 1):
        starts = range(0, len(content), PAGE_SIZE)
        entries += struct.pack("<Q6I", len(content), len(starts), PAGE_SIZE, 1, 2, number, 0) + name.encode().ljust(64, b"\0")
        for start in starts:
            packed = compress(content[start : start + PAGE_SIZE])
            page = struct.pack("<8I", DATA_PAGE, number, len(packed), PAGE_SIZE, start, 0, 0, 0)
            entries += struct.pack("<IIQ", add(_masked(page, PAGES_FROM + len(body)) + packed), len(packed), start)

    def system(mark: int, content: bytes) -> bytes:
        packed = compress(content)
        return struct.pack("<5I", mark, len(content), len(packed), 2, 0) + packed

    map_page = add(system(SECTION_MAP, struct.pack("<5I", len(parts), 2, PAGE_SIZE, 0, len(parts)) + bytes(entries)))
    pages_at = len(body)
    body += system(PAGE_MAP, b"".join(struct.pack("<iI", i, size) for i, size in enumerate(listed, 1)))
    header = bytearray(HEADER_SIZE)
    header[: len(FILE_MARK)] = FILE_MARK
    struct.pack_into("<QI", header, 0x54, pages_at, map_page)
    return bytes(head) + unmask(bytes(header)).ljust(PAGES_FROM - HEADER_AT, b"\0") + bytes(body)

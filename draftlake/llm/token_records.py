"""Token ids in length-delimited binary records, in document order, with a separate offset index.

A record is: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the
payload (u32), all little-endian. The payload is a flag byte (1: the document id is null), the document id (i64) and
the ids as u16, or as u32 if the vocabulary needs it. The index file holds the offset of each record as u64, so that a
reader can fetch records in any order. The checksum is CRC-32, rotated and offset so that a checksum of data that
holds checksums stays sound.

Documents are range-partitioned by id and sorted inside partitions, so the files, taken in partition order, are in
ascending order. A task writes files of its own attempt's name; the rows of the attempt that succeeded name them, so a
lost executor's files are never read. Only one row a file reaches the driver, to add up where each file starts.

Defined results: a null or empty text is the end id alone; null doc_ids come first; repeated doc_ids are ordered by
text and each row is a record; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, table

END_ID = 2
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 700_000
_LENGTH, _CRC, _HEAD, _HEAD_SIZE = "<Q", "<I", "<Bq", 9


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack(_LENGTH, len(payload))
    return b"".join((n, struct.pack(_CRC, masked_crc(n)), payload, struct.pack(_CRC, masked_crc(payload))))


class CorruptRecord(ValueError):
    pass


def read_frame(f) -> bytes | None:
    """The next payload of a file, or None at its end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack(_CRC, head[8:])[0] != masked_crc(head[:8]):
        raise CorruptRecord("length")
    n = struct.unpack(_LENGTH, head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack(_CRC, body[n:])[0] != masked_crc(body[:n]):
        raise CorruptRecord("payload")
    return body[:n]


def filesystem(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Where a word ends in one full stop or comma: a token ends there, whatever the word.
_STOP = re.compile(rb"(?<=[a-z0-9])(?=[.,](?:\s|$))")
#: The pattern by which the tokenizer splits words, and the same for lower-cased words of visible ASCII.
_SPLIT, _PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_VISIBLE = re.compile(rb"[!-@\[-~]+")


class WordCachingEncoder:
    """Ids of whole texts. No token crosses white space, letters lose their case and a stop after a letter is a token of
    its own, so texts are encoded word by word and each word once; pieces of ASCII words go to the model itself if the
    tokenizer has the pattern above, as no token crosses them and they need no other step; a text that may hold a special token, and every text
    with ``by_words=False``, goes to the library whole."""

    def __init__(self, path: str, by_words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.by_words = tokenizer(path), by_words
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.known: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("pretokenizers") or []
        self.by_pieces = len(steps) == 2 and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """For each text its ids, packed."""
        encode, known = self.tokenizer.encode_batch_fast, self.known
        for t in texts:
            if not self.by_words or b"<|" in t:
                yield self.pack(encode([t.decode()], add_special_tokens=False)[0].ids)
                continue
            words = _STOP.sub(b" ", t.lower()).split()
            if new := [w for w in set(words) if w not in known]:
                if len(known) > CACHE_WORDS:
                    known.clear()
                    new = list(set(words))
                split = {w: _PIECES.findall(w) for w in new if _VISIBLE.fullmatch(w)} if self.by_pieces else {}
                for p in {p for pieces in split.values() for p in pieces if p not in known}:
                    known[p] = self.pack([x.id for x in self.model.tokenize(p.decode())])
                for w, pieces in split.items():
                    if len(pieces) > 1:
                        known[w] = b"".join([known[p] for p in pieces])
                whole = [w for w in new if w not in split]
                for w, e in zip(whole, encode([w.decode() for w in whole], add_special_tokens=False)):
                    known[w] = self.pack(e.ids)
            yield b"".join(map(known.__getitem__, words))


@cache
def encoder(path: str) -> WordCachingEncoder:
    """One per worker process, so that its words outlive a task."""
    return WordCachingEncoder(path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None) -> list[dict]:
    """Writes the files; returns for each its path, index, documents, ids and the ids in files before it."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")

    def run(batches):
        encode = encoder(tokenizer_path)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        at = TaskContext.get()
        name = f"{path}/part-{at.partitionId():06d}-{at.taskAttemptId()}"
        end = encode.pack([end_id])
        docs_n = ids_n = 0
        with fs.open_output_stream(name + ".rec", buffer_size=1 << 20) as out, fs.open_output_stream(name + ".idx", buffer_size=1 << 16) as index:
            place = 0
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                    record = frame(struct.pack(_HEAD, doc_id is None, doc_id or 0) + ids + end)
                    index.write(struct.pack(_LENGTH, place))
                    out.write(record)
                    place += len(record)
                    docs_n += 1
                    ids_n += len(ids) // encode.width + 1
        yield pa.RecordBatch.from_pydict({"part": [at.partitionId()], "path": [name], "docs": [docs_n], "ids": [ids_n], "width": [encode.width]}, schema=_FILE)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows = rows.select("doc_id", F.col("text").cast("binary"))
    files = rows.mapInArrow(run, "part long, path string, docs long, ids long, width long").collect()
    out, start = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        out.append({"path": _uri(folder, f["path"]), "docs": f["docs"], "ids": f["ids"], "width": f["width"], "start": start})
        start += f["ids"]
    return [f for f in out if f["docs"]]


_FILE = pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int64())])


def _uri(folder: str, path: str) -> str:
    return f"{folder.rstrip('/')}/{path.rpartition('/')[2]}"


def parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    null, doc_id = struct.unpack_from(_HEAD, payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD_SIZE)


def read_at(uri: str, width: int, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a file by number, through its index."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path + ".idx") as index, fs.open_input_file(path + ".rec") as f:
        out = []
        for k in numbers:
            index.seek(8 * k)
            f.seek(struct.unpack(_LENGTH, index.read(8))[0])
            out.append(parse(read_frame(f), width))
        return out


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def summarize(spark: SparkSession, files: list[dict]) -> DataFrame:
    """From the files: for each record its document, where its ids start, how many and their checksum."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                fs, path = filesystem(x["path"])
                place, rows = x["start"], []
                with fs.open_input_stream(path + ".rec", buffer_size=1 << 20) as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = parse(payload, x["width"])
                        rows.append((doc_id, place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        place += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ)
                if place != x["start"] + x["ids"]:
                    raise CorruptRecord(f"{path}: {place - x['start']} ids, {x['ids']} written")

    listed = spark.createDataFrame([(f["path"], f["ids"], f["width"], f["start"]) for f in files], "path string, ids long, width long, start long")
    return listed.repartition(len(files)).mapInArrow(run, schema)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return summarize(spark, write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

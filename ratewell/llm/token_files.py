"""Token-ID output: independent zstandard frames, one per document, with a trailing seek table.

A file is a row of frames in ascending doc_id order, then two frames that plain zstandard readers skip: the doc_ids, and
the seek table of the public seekable format, with the sizes and a checksum of each frame. Each frame also has
zstandard's own checksum. A reader takes the two tables from the end of the file and decompresses only what is asked for.

Texts are encoded where they are read, and only compressed frames are shuffled. Files are written under a name of the
attempt and then renamed, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.llm.common import fresh_path, settle, text_of

#: Fixed values of the seekable format: skippable frames, the table's end, its flag for checksums.
SKIPPED_IDS, SKIPPED_TABLE, TABLE_END, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Words with one of these at an end can't be encoded one by one: white space and what may count as such.
_NEAR = frozenset("\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff") | {chr(c) for c in [*range(33), *range(127, 161), *range(0x2000, 0x2010), *range(0x2060, 0x2065)]}
#: Fixed values of byte-level tokenizers: the pattern of their tokens' bounds, and the bytes that stand for themselves.
_BOUNDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: b for b in _OWN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _OWN)}
#: Characters from here on are left to the library's own bounds: which of them are letters depends on its version.
_PLAIN = "\u0250"
#: Control characters that are white space to some libraries only.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85]")
#: Marks that are a token of their own after a word's letters.
_MARKS = frozenset(".,;:!?#*$%&|<>()")
#: Words kept, and as many from before.
_KEPT = 400_000


class Encoder:
    """Encodes texts with a file of the tokenizers library; ids as bytes, little-endian.

    A byte-level tokenizer whose pattern ends a token before each single space encodes the words of a text, with the
    space before them, independently; so does its model the tokens of a word. The ids of both are kept.
    Texts with added tokens of the tokenizer, with spaces that do not stand alone, and all texts of other tokenizers are
    encoded whole. The library's defaults hold for added tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        before = self.tokenizer.pre_tokenizer
        self.by_word = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Words(self._word)
        self.parts: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.raw = [k.to_bytes(array(self.kind).itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a token before merging, by the tokenizer's model; kept as well."""
        if len(self.parts) > _KEPT * 3 // 2:
            self.parts.clear()
        plain = part.isascii() and part.isprintable()
        signs = part.replace(" ", "\u0120") if plain else part.encode().decode("latin-1").translate(_SIGNS)
        raw = self.raw
        found = self.parts[part] = b"".join([raw[x.id] for x in self.model.tokenize(signs)])
        return found

    def _word(self, word: str) -> bytes | None:
        known = self.parts.get
        text = word[1:] if word[:1] == " " else " " + word
        if word.isalpha() and (word.isascii() or max(word) < _PLAIN):
            return known(text) or self._part(text)
        if not text.strip(" ") or word[-1] in _NEAR or text[text[0] == " "] in _NEAR:
            return None
        if not (text.isascii() or max(text) < _PLAIN) or _DOUBTFUL.search(text):
            return self._whole(text)
        left, line, right = word.partition("\n")
        if left.strip(" ") and right and "\n" not in right and left[-1] not in _NEAR and right[0] not in _NEAR:
            # a line's end is a token of its own, and no space stands before what follows
            before, after = self.words[left], self.words[" " + right]
            return None if before is None or after is None else before + (known(line) or self._part(line)) + after
        if word[:-1].isalpha() and word[-1] in _MARKS:
            return (known(text[:-1]) or self._part(text[:-1])) + (known(word[-1]) or self._part(word[-1]))
        return b"".join([known(x) or self._part(x) for x in _BOUNDS.findall(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        out = []
        for text in texts:
            if not self.by_word or not text or any(x in text for x in self.added):
                out.append(self._whole(text))
                continue
            words = text.split(" ")
            words[0] = " " + words[0]
            try:
                out.append(b"".join(map(get, words)))
            except TypeError:  # a word that can't be encoded alone
                out.append(self._whole(text))
        return out


class Words(dict):
    """A word's ids with the space before it, None for one that can't be encoded alone; a text's first word, which has no
    space, is kept with one before it. When it is full, words that are met again stay and the others go."""

    def __init__(self, encode) -> None:
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> bytes | None:
        found = self.before.get(word, self)
        if found is self:
            found = self.encode(word)
        if len(self) > _KEPT:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found


_encoders: dict[str, Encoder] = {}

_FRAMES = "doc_id long, n_tokens long, raw_size long, checksum long, frame binary"


def _frames(tokenizer: str, end: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        width = array(encoder.kind).itemsize
        last = end.to_bytes(width, "little")
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [x + last for x in encoder.encode(part["text"].to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "n_tokens": [len(x) // width for x in ids], "raw_size": [len(x) for x in ids],
                    "checksum": [xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in ids], "frame": pa.array([packer.compress(x) for x in ids], pa.binary()),
                })

    return run


def _skipped(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


_FILES = "file int, path string, first_id long, last_id long, n_docs long, n_tokens long, width int"


def _writer(folder: str, width: int):
    """Sorted frames in, one file per task out, and a row about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, ids, entries, tokens, sink = task.partitionId(), [], [], 0, None
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        path = f"{base}/ids-{number:06d}.zst"
        attempt = f"{path}.{task.taskAttemptId()}"
        for batch in batches:
            if batch.num_rows and sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(attempt)
            for doc_id, n, raw, check, frame in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "raw_size", "checksum", "frame")), strict=True):
                sink.write(frame)
                ids.append(doc_id)
                entries.append(struct.pack("<III", len(frame), raw, check))
                tokens += n
        if sink is None:
            return
        known = np.array([x or 0 for x in ids], "<i8").tobytes() + bytes(x is None for x in ids)
        sink.write(_skipped(SKIPPED_IDS, struct.pack("<II", len(ids), width) + known))
        sink.write(_skipped(SKIPPED_TABLE, b"".join(entries) + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, TABLE_END)))
        sink.close()
        store.move(attempt, path)
        told = {"file": [number], "path": [path if store.type_name == "local" else folder.split("://")[0] + "://" + path], "first_id": [next((x for x in ids if x is not None), None)], "last_id": [ids[-1]], "n_docs": [len(ids)], "n_tokens": [tokens], "width": [width]}
        yield pa.RecordBatch.from_pydict(told, pa.schema([("file", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return run


def write(docs: DataFrame, folder: str | None = None, tokenizer: str = "byte_bpe_50k.json", end: int = 0, docs_per_file: int = 8192, level: int = 3) -> DataFrame:
    """Writes the ids of every text, each ended by `end`, and returns one row per file.

    file, path, first_id and last_id (of those that are not null), n_docs, n_tokens, width (bytes of an id) and start (ids in all files before it).
    A null text is empty: its ids are the end alone. Rows with equal doc_id are all written, in any order; null comes
    first. An empty table writes no files. Other columns of docs are not read. folder must be one that all executors
    share; unset, it is a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    frames = settle(rows.mapInArrow(_frames(tokenizer, end, level), _FRAMES), "frames")
    files = max(1, -(-frames.count() // docs_per_file))
    width = array(Encoder(tokenizer).kind).itemsize
    # rows of one doc_id, or of none, may fill many files: their places in the table part them
    order = ["doc_id", "row"]
    dealt = frames.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = settle(dealt.mapInArrow(_writer(folder, width), _FILES), "files")
    before = F.sum("n_tokens").over(W.orderBy("file")) - F.col("n_tokens")
    return written.withColumn("start", before)


class Reader:
    """One file: its tables at once, frames on demand."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        count, flags, mark = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if mark != TABLE_END or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * count
        self.entries = np.frombuffer(self.file.read_at(12 * count, at), "<u4").reshape(-1, 3)
        ids_at = at - 8 - 9 * count - 8 - 8
        magic, _, found, self.width = struct.unpack("<IIII", self.file.read_at(16, ids_at))
        if magic != SKIPPED_IDS or found != count:
            raise ValueError(f"{path} has no table of ids")
        ids = np.frombuffer(self.file.read_at(8 * count, ids_at + 16), "<i8")
        null = self.file.read_at(count, ids_at + 16 + 8 * count)
        self.doc_ids = [None if no else int(x) for x, no in zip(ids, null, strict=True)]
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])

    def lengths(self) -> np.ndarray:
        return (self.entries[:, 1] // self.width).astype(np.int64)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its checksum compared."""
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.entries[k, 0]), int(self.offsets[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            reader = Reader(path)
            starts = start + np.cumsum(reader.lengths()) - reader.lengths()
            for k in range(0, len(reader.doc_ids), 4096):
                upto = min(k + 4096, len(reader.doc_ids))
                ids = [reader.ids(j) for j in range(k, upto)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids[k:upto], pa.int64()), "start": starts[k:upto], "n_tokens": np.array([len(x) for x in ids], np.int64),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                })


def read_digests(files: DataFrame) -> DataFrame:
    """Every document of written files, read back: doc_id, start, n_tokens and the crc32 of its ids in 32 bits.

    Repeated and null doc_ids have a row each; no files give no rows; a damaged file raises.
    """
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file", "path", "start").repartition(parts, "file").select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, wanted in zip(batch["path"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            reader, wanted = Reader(path), set(wanted)
            at = [k for k, x in enumerate(reader.doc_ids) if x in wanted]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([reader.doc_ids[k] for k in at], pa.int64()), "ids": pa.array([reader.ids(k).tolist() for k in at], pa.list_(pa.int64()))})


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose doc_id is in wanted: only their frames are decompressed.

    Repeated ids give all their documents once, however often they are asked for; null and unknown ids give none.
    """
    ask = wanted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    both = files.join(ask, (F.col("doc_id") >= F.col("first_id")) & (F.col("doc_id") <= F.col("last_id")))
    return both.groupBy("path").agg(F.collect_set("doc_id").alias("wanted")).mapInArrow(_lookup, "doc_id long, ids array<bigint>")

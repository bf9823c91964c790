"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens. Each task counts its own pieces in a
summary of bounded size (Misra-Gries: what is counted out of it loses one summary's share of all pieces at most),
summaries are merged a few at a time, and the table is broadcast: its entries and their bytes have a bound. Tier two is
a cache in each worker, which encodes what the table has not. The table covers all texts; it decides the speed alone, as
both tiers hold what the tokenizer itself gives.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import gathered, settle, text_of

#: Entries of a summary and of the table, and the bytes of a pre-token that may be in one.
SUMMARY, FREQUENT, SHORT = 1 << 16, 1 << 15, 32
#: Pieces in each half of a worker's cache, and the bytes of one that is kept.
KEPT, KEPT_BYTES = 200_000, 64

#: Fixed values of the word-level tokenizer: its pattern of pre-tokens and its normalizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Fixed values of byte-level tokenizers: the bytes that stand for themselves.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: b for b in _OWN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _OWN)}

_BOUNDS = regex.compile(PATTERN)
#: UTF-8 of characters from U+0250 on, where letters depend on the library's version and marks may join, and control
#: characters that are white space to some libraries only: pieces with one are encoded whole.
_OTHER = re.compile(rb"[\xca-\xff]|\xc9[\x90-\xbf]")
_ODD = re.compile(rb"[\xca-\xff]|\xc9[\x90-\xbf]|[\x1c-\x1f]|\xc2\x85")


def _open(name: str):
    """The tokenizer of a file, its special strings, and whether pre-tokens can be encoded one by one."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=name), [], False
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(name)
    found.no_truncation()
    found.no_padding()
    with open(name, encoding="utf-8") as file:
        told = json.load(file)
    steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    apart = steps == NORMALIZERS and cuts[0].get("pattern") == {"Regex": PATTERN} and cuts[0].get("invert") is True
    return found, [x["content"].encode() for x in told["added_tokens"]], apart


class Lengths(dict):
    """Tokens of a piece, text between white space with A-Z as a-z, by the table, the cache, or the tokenizer.

    A piece that is one pre-token is looked up in the table at once; another is cut into its pre-tokens and kept whole.
    """

    def __init__(self, tokenizer: str, table: tuple[bytes, bytes] = (b"", b"")) -> None:
        words, lengths = table
        super().__init__(zip(words.split(), lengths, strict=True))
        self.tokenizer, self.special, self.apart = _open(tokenizer)
        self.recent: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def _whole(self, text: str) -> int:
        if hasattr(self.tokenizer, "encode_as_ids"):
            return len(self.tokenizer.encode(text))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut(self, piece: bytes) -> list[str] | None:
        """Its pre-tokens, or None where only the library can tell."""
        return None if _ODD.search(piece) else _BOUNDS.findall(piece.decode().lower())

    def _encoded(self, piece: bytes) -> int:
        parts = self.cut(piece)
        if parts is None:
            return self._whole(piece.decode())
        tokenize, known = self.tokenizer.model.tokenize, self.get
        return sum(known(raw) or len(tokenize(raw.decode("latin-1").translate(_SIGNS))) for raw in map(str.encode, parts))

    def __missing__(self, piece: bytes) -> int:
        found = self.recent.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self._encoded(piece)
            if len(piece) <= KEPT_BYTES:
                if len(self.recent) >= KEPT:
                    self.older, self.recent = self.recent, {}
                self.recent[piece] = found
        return found

    def pieces(self, raw: bytes) -> list[bytes] | None:
        """The pieces of a text, None where it must be encoded whole. A letter and its marks are kept as written."""
        if not self.apart or any(x in raw for x in self.special):
            return None
        return raw.split() if _OTHER.search(raw) else raw.lower().split()

    def count(self, raw: bytes) -> int:
        pieces = self.pieces(raw)
        return self._whole(raw.decode()) if pieces is None else sum(map(self.__getitem__, pieces))


def _pruned(counts: dict[str, int]) -> dict[str, int]:
    """The SUMMARY largest counts, each less the largest of the others."""
    if len(counts) <= SUMMARY:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    most = int(np.partition(values, len(values) - SUMMARY - 1)[len(values) - SUMMARY - 1])
    return {w: n - most for w, n in counts.items() if n > most}


_SUMMARY = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_SUMMARY_DDL = "part int, words binary, counts binary"


def _packed(part: int, counts: dict[str, int]) -> pa.Table:
    counts = _pruned(counts)
    return pa.table([[part], [" ".join(counts).encode()], [np.fromiter(counts.values(), np.int64, len(counts)).tobytes()]], schema=_SUMMARY)


def _counted(tokenizer: str):
    """Texts in, one summary of the task's pre-tokens out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, counts = Lengths(tokenizer), Counter()

        def take(found: Counter) -> None:
            for piece, n in found.items():
                for word in lengths.cut(piece) or ():
                    if len(word) <= SHORT:
                        counts[word] += n

        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(lengths.pieces(text.as_py().encode()) or ())
                if len(found) > 2 * SUMMARY:
                    take(found)
                    found.clear()
                    if len(counts) > 2 * SUMMARY:
                        counts = Counter(_pruned(counts))
        take(found)
        yield from _packed(TaskContext.get().partitionId(), counts).to_batches()

    return run


def _merged(table: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for words, n in zip(table["words"].to_pylist(), table["counts"].to_pylist(), strict=True):
        for word, x in zip(words.decode().split(" ") if words else [], np.frombuffer(n, np.int64).tolist(), strict=True):
            counts[word] += x
    return _packed(table["part"][0].as_py(), counts)


def frequent(docs: DataFrame, tokenizer: str) -> tuple[bytes, bytes]:
    """The most frequent short pre-tokens of all texts, joined by spaces, and the tokens of each, a byte for each.

    At most FREQUENT entries of SHORT characters. Ties are broken by the word, so reruns agree.
    """
    summaries = settle(docs.select(text_of().alias("text")).mapInArrow(_counted(tokenizer), _SUMMARY_DDL), "summaries")
    last = gathered(summaries, _merged, _SUMMARY_DDL).first()
    if last is None or not last["words"]:
        return b"", b""
    counts = np.frombuffer(last["counts"], np.int64).tolist()
    words = [w for _, w in sorted(zip((-n for n in counts), bytes(last["words"]).decode().split(" "), strict=True))[:FREQUENT]]
    lengths = Lengths(tokenizer)
    return " ".join(words).encode(), bytes(map(lengths._encoded, map(str.encode, words)))


_loaded: dict[str, Lengths] = {}


def _lengths_of(name: str, tokenizer: str, shared) -> Lengths:
    """A worker's tiers, made once for each table."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Lengths(tokenizer, shared.value)
    return _loaded[name]


def _answers(tokenizer: str, shared):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths_of(name, tokenizer, shared)
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch["text"]):
                raw = text.as_py().encode()
                n_bytes[k], n_tokens[k] = len(raw), lengths.count(raw)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens})

    return run


def count(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens).

    Special strings in a text are the tokens that the tokenizer takes them for; none are added, cut off or padded. A null
    or empty text has no bytes and no tokens. Rows with equal or null doc_id stay rows of their own. An empty table gives
    no rows. Other columns of docs are not read. Files whose pre-tokens can't be encoded one by one encode whole texts.
    """
    _, _, apart = _open(tokenizer)
    table = frequent(docs, tokenizer) if apart else (b"", b"")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = rows.mapInArrow(_answers(tokenizer, shared), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

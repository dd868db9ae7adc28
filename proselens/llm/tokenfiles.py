"""Token-id files: ids of whole texts, range coded in blocks (operator 12).

Documents are range-partitioned and sorted by id; each task encodes its texts
with the ``tokenizers`` library and writes one file.  A file is

    MAGIC, blocks, directory, footer

A block is a header (ids, alphabet bytes, words, CRC-32 of the stored bytes,
CRC-32 of its ids), the gaps of its sorted alphabet, and its words (levels and
code), and decodes alone (``rangecoder``).  The directory holds every document's
id and number of ids.  All numbers are little-endian.

Encoding a text means splitting it at ASCII white space, which the
vocabulary's own pattern never joins across, and looking the pieces up; pieces
not met before go through the library, the usual ones word by word.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.llm import rangecoder
from proselens.llm.common import Scratch, pick, ship

MAGIC = b"TOKIDCM2"
_HEAD = struct.Struct("<IIIII")
_FOOT = struct.Struct("<QIIQQ8s")  # directory place, bytes, CRC-32, documents, ids, MAGIC
# Ids of a block, blocks coded in step, bytes of text per file.
BLOCK_IDS = 8192
LANES = 2048
FILE_BYTES = 40 << 20
# Pieces and ids that a worker remembers.
MEMO_PIECES, MEMO_IDS = 400_000, 4_000_000

INDEX = "part int, file string, documents long, ids long, bytes long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


# Characters of usual pieces: letters and numbers of \p{L} and \p{N}, and what is
# neither; lower-casing them needs no neighbours and stays among them, and NFC
# leaves them alone.
# "<" is missing, as it may begin an added token.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u04ff" \
           "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_OTHERS = r"!-/:;=-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7"
_USUAL = re.compile(f"[{_LETTERS}{_NUMBERS}{_OTHERS}]*")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
# The steps that the two patterns above stand for.
_STEPS = {"normalizer": {"type": "Sequence", "normalizers": [
              {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
              {"type": "Lowercase"}]},
          "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
              {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
               "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


class Memo:
    """Keys and the ids of each, in one array."""

    def __init__(self) -> None:
        self.known: dict = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.end = 0

    def full(self) -> bool:
        return len(self.known) > MEMO_PIECES or self.end > MEMO_IDS

    def add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        at = len(self.known)
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.end:self.end + len(ids)] = ids
        self.starts[at:at + len(keys)] = self.end + np.cumsum(lengths) - lengths
        self.lengths[at:at + len(keys)] = lengths
        self.end += len(ids)
        self.known.update(zip(keys, range(at, at + len(keys))))

    def places(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each place end."""
        lengths = self.lengths[places]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(self.starts[places] - (stops - lengths), lengths) + np.arange(total)
        return self.ids[at], stops


class Encoder:
    """Ids of whole texts; equal to the library's, piece by piece.

    The library merges the symbols of every word.  Where the vocabulary's
    normalizer and split are those of _STEPS, usual pieces are lower-cased and
    split into words here, and each word goes to the library's model once; all
    other pieces take all its steps.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        mark = self.library.encode("\x01", add_special_tokens=False).ids
        # a mark that is one id of its own tells pieces apart in one text
        self.mark = mark[0] if len(mark) == 1 else None
        steps = json.loads(self.library.to_str())
        self.model = None
        if (self.mark is not None and steps["model"]["type"] == "BPE"
                and all(steps[k] == v for k, v in _STEPS.items())
                and all(x["content"][0] == "<" for x in steps["added_tokens"])):
            # every word comes once, so a cache would only cost
            model = steps["model"] | {"cache_capacity": 0}
            model["merges"] = [tuple(x) for x in model["merges"]]
            model.pop("type")
            self.model = Tokenizer(models.BPE(**{k: v for k, v in model.items() if v is not None}))
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces, self.words = Memo(), Memo()

    def _learn(self, pieces: list[bytes]) -> None:
        odd = [p for p in pieces if self.mark is None or b"\x01" in p]
        plain = list(set(pieces).difference(odd)) if odd else pieces
        for a in range(0, len(plain), 2000):
            part = plain[a:a + 2000]
            texts = b" \x01 ".join(part).decode("utf-8", "replace").split(" \x01 ")
            usual = list(map(_USUAL.fullmatch, texts)) if self.model else [None] * len(part)
            self._learn_usual(list(compress(part, usual)), list(compress(texts, usual)))
            rest = [u is None for u in usual]
            part = list(compress(part, rest))
            if part:
                text = " \x01 ".join(compress(texts, rest))
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                first, last = np.append(0, marks + 1), np.append(marks, len(ids))
                self.pieces.add(part, np.delete(ids, marks), last - first)
        for p in odd:
            ids = self.library.encode_batch_fast([p.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            self.pieces.add([p], np.array(ids, np.uint32), np.array([len(ids)]))

    def _learn_usual(self, pieces: list[bytes], texts: list[str]) -> None:
        if not pieces:
            return
        if self.words.full():
            self.words = Memo()
        words = _WORDS.findall(" \x01 ".join(texts).lower())
        new = list(set(words).difference(self.words.known, ["\x01"]))
        if new:
            marked = list(chain.from_iterable(zip(new, repeat("\x01"))))
            coded = self.model.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(coded.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            self.words.add(new, np.delete(ids, marks), np.diff(marks, prepend=-1) - 1)
        # a mark has no ids; a piece's ids end with its last word
        if "\x01" not in self.words.known:
            self.words.add(["\x01"], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        places = self.words.places(words)
        ids, stops = self.words.take(places)
        marks = np.flatnonzero(places == self.words.known["\x01"])
        self.pieces.add(pieces, ids, np.diff(np.append(stops[marks], len(ids)), prepend=0))

    def encode(self, texts: list[bytes] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end_id`` after each text, and how many each has."""
        if self.pieces.full():
            self.pieces = Memo()
        raw = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        # white space at either end of a text gives a piece without bytes
        split = pc.ascii_split_whitespace(raw.cast(pa.large_binary()).view(pa.large_string()))
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        new = list(set(different).difference(self.pieces.known))
        if new:
            self._learn(new)
        if end_id not in self.pieces.known:  # a piece of its own
            self.pieces.add([end_id], np.array([end_id], np.uint32), np.ones(1, np.int64))
        ends = np.cumsum(counts + 1) - 1
        places = np.full(int(counts.sum()) + len(counts), self.pieces.known[end_id], np.int64)
        inner = np.ones(len(places), bool)
        inner[ends] = False
        places[inner] = self.pieces.places(different)[coded.indices.to_numpy()]
        ids, stops = self.pieces.take(places)
        return ids, np.diff(stops[ends], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_block(ids: np.ndarray, letters: np.ndarray, words: np.ndarray) -> bytes:
    gaps = zlib.compress(np.diff(letters.astype(np.int64), prepend=0).astype("<u4").tobytes())
    body = gaps + words.astype("<u4").tobytes()
    return _HEAD.pack(len(ids), len(gaps), len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


class FileWriter:
    """Streams ids and documents into one file."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> None:
        self.out, self.block_ids, self.lanes = out, block_ids, lanes
        self.pending: list[np.ndarray] = []
        self.tail = np.zeros(0, np.uint32)
        self.documents: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = self.bytes = 0
        self._write(MAGIC)

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.documents.append((doc_ids, null, counts))
        self.ids += len(ids)
        ids = np.concatenate([self.tail, ids])
        whole = len(ids) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            self.pending.append(ids[a:a + self.block_ids])
            if len(self.pending) >= self.lanes:
                self._flush()
        self.tail = ids[whole:].copy()

    def _flush(self) -> None:
        for ids, (letters, words) in zip(self.pending, rangecoder.encode(self.pending)):
            self._write(pack_block(ids, letters, words))
        self.pending = []

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the finished file."""
        if len(self.tail):
            self.pending.append(self.tail)
        self._flush()
        columns = [np.concatenate([d[i] for d in self.documents]) if self.documents else np.zeros(0, np.int64)
                   for i in range(3)]
        raw = zlib.compress(columns[0].astype("<i8").tobytes() + columns[1].astype("u1").tobytes()
                            + columns[2].astype("<u8").tobytes())
        place = self.bytes
        self._write(raw)
        n = len(columns[0])
        self._write(_FOOT.pack(place, len(raw), zlib.crc32(raw), n, self.ids, MAGIC))
        return n, self.ids, self.bytes


def read_directory(f) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the directory, and ids, null marks and id counts of the documents."""
    f.seek(f.size() - _FOOT.size)
    place, size, crc, n, ids, magic = _FOOT.unpack(f.read(_FOOT.size))
    f.seek(place)
    raw = f.read(size)
    if magic != MAGIC or zlib.crc32(raw) != crc:
        raise ValueError("no directory, or a damaged one")
    raw = zlib.decompress(raw)
    counts = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
    if counts.sum() != ids:
        raise ValueError("the directory does not add up")
    return place, np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool), counts


def read_blocks(f, end: int, lanes: int = LANES) -> Iterator[np.ndarray]:
    """Ids of the blocks before ``end``, up to ``lanes`` blocks at a time."""
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    while at < end:
        blocks, sums = [], []
        while at < end and len(blocks) < lanes:
            n, size, words, crc, ids_crc = _HEAD.unpack(f.read(_HEAD.size))
            body = f.read(size + 4 * words)
            at += _HEAD.size + len(body)
            if zlib.crc32(body) != crc:
                raise ValueError(f"damaged block before byte {at}")
            letters = np.cumsum(np.frombuffer(zlib.decompress(body[:size]), "<u4").astype(np.int64)).astype(np.uint32)
            blocks.append((letters, n, np.frombuffer(body, "<u4", words, size)))
            sums.append(ids_crc)
        found = rangecoder.decode(blocks)
        for ids, crc in zip(found, sums):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block decodes to other ids")
        yield np.concatenate(found)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, file_bytes: int = FILE_BYTES,
                      block_ids: int = BLOCK_IDS, lanes: int = LANES) -> DataFrame:
    """Write the ids of all texts, in ascending doc_id order, as files of about
    ``file_bytes`` of text; returns their INDEX, ``part`` in file order.

    A null text is empty (its end id alone); null doc_ids come first; rows that
    share a doc_id follow each other in any order, and may share files with
    others or fill many; an empty table gives no file.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a number of the row's own splits a doc_id that very many rows share
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("_row"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_raw"))
    order = ["doc_id", "_row"]
    placed = rows.repartitionByRange(int(size // file_bytes) + 1, *order).sortWithinPartitions(*order)
    folder = scratch.path("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        writer = stream = None
        enc = encoder(vocabulary)
        # a name of its own for each attempt: the index names finished files only
        name = f"{uuid.uuid4().hex}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = FileWriter(stream, block_ids, lanes)
            doc = batch.column(0)
            ids, counts = enc.encode(batch.column(2), end_id)
            writer.add(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), counts, ids)
        if writer is not None:
            done = writer.close()
            stream.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), *[pa.array([x], pa.int64()) for x in done]],
                names=["part", "file", "documents", "ids", "bytes"])

    return scratch.write(placed.mapInArrow(run, INDEX), "index")


def read_token_files(index: DataFrame, with_ids: bool = False, lanes: int = LANES) -> DataFrame:
    """ROW of every document of the files, read back and checked, ``start``
    counting the ids of all files before; ``with_ids`` adds the ids."""
    spark = index.sparkSession
    ship(spark)
    # one row per file
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = index.select("file", F.coalesce(before, F.lit(0)).alias("base"),
                         (F.row_number().over(Window.orderBy("part")) - 1).cast("int").alias("task"))
    tasks = files.repartitionById(max(1, index.count()), F.col("task"))
    schema = ROW + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    end, doc_ids, null, counts = read_directory(f)
                    yield from _documents(f, end, doc_ids, null, counts, base)

    def _documents(f, end, doc_ids, null, counts, base) -> Iterator[pa.RecordBatch]:
        stops = np.cumsum(counts)
        done = at = crc = 0  # documents finished, ids read, sum of the open one
        held: list[np.ndarray] = []
        for ids in read_blocks(f, end, lanes):
            raw = memoryview(ids.astype("<u4").tobytes())
            last = int(np.searchsorted(stops, at + len(ids), side="right"))
            sums, lists = [], []
            a = 0
            for d in range(done, last):
                b = int(stops[d]) - at
                sums.append(zlib.crc32(raw[4 * a:4 * b], crc))
                if with_ids:
                    lists.append(np.concatenate([*held, ids[a:b]]).astype(np.int64))
                    held = []
                crc, a = 0, b
            crc = zlib.crc32(raw[4 * a:], crc)
            if with_ids:
                held.append(ids[a:])
            n = counts[done:last]
            columns = [pa.array(doc_ids[done:last], pa.int64(), mask=null[done:last]),
                       pa.array(base + stops[done:last] - n, pa.int64()), pa.array(n, pa.int64()),
                       pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int64()))] if with_ids else []),
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
            done, at = last, at + len(ids)

    return tasks.mapInArrow(run, schema)


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int, **settings) -> DataFrame:
    """Write all texts and read all files back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, end_id, scratch, **settings))

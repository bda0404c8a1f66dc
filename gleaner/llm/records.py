"""Token ids in length-delimited binary shards with a separate offset index.

A shard ``NAME.rec`` is a row of frames

    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

(little-endian; ``masked(c) = rotr32(c, 15) + 0xa282ead8``), and a payload is

    u8 flags (1: no document id) | i64 document id | u8 width | ids of ``width`` (2 or 4) bytes each.

Its index ``NAME.idx`` holds, per record, i64 offset, i64 frame length, i64 ids before it in the
shard; so a reader in shuffled order needs the index and one range read a record. Shards hold rising
ranges of document ids and rows within rise too. A shard is one task's output: its name has a random
part, and only shards named in the manifest (a Parquet table that Spark commits) count, so what a
lost or repeated task leaves behind is never read.

Null texts count as empty, null ids come first, rows that share an id lie side by side in order of
their text, an empty table gives an empty manifest; extra columns are not read. A record is held in
memory whole, however long its text (it is encoded a piece at a time); a shard is not: frames are
written as they are made.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, partitions, scratch, texts

#: Fixed value: what is added to the rotated checksum.
MASK = 0xA282EAD8
HEAD = struct.Struct("<BqB")
#: Distinct chunks of a generation that a worker keeps encoded; bytes of text encoded at once.
MAX_CHUNKS, PIECE = 600_000, 1 << 16

#: The form of a tokenizer file whose pre-tokens never span white space nor case nor the border of letters and marks.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Lower-case Latin-1 letters (stable under normalization), then ASCII marks other than the apostrophe, which starts pre-tokens of its own.
_HALVES = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises if a checksum or the length is wrong."""
    size, crc = struct.unpack_from("<QI", data)
    if masked(data[:8]) != crc or len(data) != size + 16:
        raise ValueError("corrupt record length")
    payload = data[12:-4]
    if masked(payload) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("corrupt record")
    return payload


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return frame(HEAD.pack(doc_id is None, doc_id or 0, width) + ids)


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    payload = unframe(data)
    null, doc_id, width = HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


class Known(dict):
    """Chunks to their ids. One that is not there is noted, and None."""

    def __init__(self):
        super().__init__()
        self.lacking: list[bytes] = []

    def __missing__(self, chunk):
        self.lacking.append(chunk)


class ChunkEncoder:
    """Texts to ids by a tokenizer. If its file proves that it drops white space, lower-cases, and cuts
    words from marks (``CUTS``), texts are encoded a chunk between spaces at a time and each distinct chunk
    once while a worker remembers it; any other tokenizer gets whole texts."""

    def __init__(self, path: str, end_id: int, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id) <= 0xFFFF else 4
        self.end = np.array([end_id], f"<u{self.width}").tobytes()
        self.code, self.max_chunks = "H" if self.width == 2 else "I", max_chunks
        self.by_chunk = cuts_at_space(spec)
        #: Chunks known, and those of the generation before: once the first is full it becomes the second.
        self.known, self.before = Known(), Known()
        if self.by_chunk:
            # Words of lower-case letters need no normalizer and no pattern.
            bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, CUTS["pre_tokenizer"]["pretokenizers"][1]]}
            self.letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bare, "truncation": None, "padding": None}))
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters: encoded as one text, and parted after each id that ends a word."""
        ids = array.array(self.code, self.letters.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids).tobytes()
        stops = (np.flatnonzero(self.ends[np.frombuffer(ids, f"<u{self.width}")]) + 1) * self.width
        if len(stops) != len(words) or len(words) and stops[-1] != len(ids):
            return self.plain([w.decode() for w in words])
        cuts = [0, *stops.tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, new: set[bytes]) -> None:
        """A chunk of lower-case Latin-1 letters and then ASCII marks is its two halves, for pre-tokens end between them."""
        known, before, halves = self.known, self.before, {}
        for c in new:
            ids = before.get(c)
            if ids is not None:
                known[c] = ids
            else:
                m = _HALVES.fullmatch(c)
                halves[c] = m.groups() if m else (None, c)
        words = sorted({h for h, _ in halves.values() if h is not None and h not in known})
        rest = sorted({t for _, t in halves.values() if t and t not in known})
        known.update(zip(words, self.words(words) if words else ()))
        known.update(zip(rest, self.plain([c.decode() for c in rest]) if rest else ()))
        known.update({c: known[h] + known[t] for c, (h, t) in halves.items() if h is not None and t})
        known.lacking, before.lacking = [], []

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, the end id after them."""
        if not self.by_chunk:
            return [ids + self.end for ids in self.plain([t.decode() for t in texts])]
        # Lower case first, where that changes nothing: a special token is looked for in the text as it is, and some
        # letters compose with a mark (U+0300 to U+033F, lead byte 0xCC) in lower case only.
        chunks = [(t if b"<|" in t or b"\xcc" in t else t.lower()).split() for t in texts]
        get = self.known.__getitem__
        found = [list(map(get, c)) for c in chunks]
        if self.known.lacking:
            new = set(self.known.lacking)
            if len(self.known) + 2 * len(new) > self.max_chunks:
                self.known, self.before = Known(), self.known
            self.learn(new)
            for c, ids in zip(chunks, found):
                at = 0
                for _ in range(ids.count(None)):
                    at = ids.index(None, at)
                    ids[at] = self.known[c[at]]
        return [b"".join(ids) + self.end for ids in found]

    def __call__(self, text: bytes) -> bytes:
        """The same of one text, however long: a piece at a time, cut at spaces."""
        if len(text) <= PIECE or not self.by_chunk:
            return self.many([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = len(text)
            if at + PIECE < cut:
                cut = text.rfind(b" ", at + 1, at + PIECE)
                cut = text.find(b" ", at + PIECE) if cut < 0 else cut
                cut = len(text) if cut < 0 else cut
            out.append(self.many([text[at:cut]])[0][: -self.width])
            at = cut
        return b"".join(out) + self.end


def cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizer file is of the form ``CUTS`` and its special tokens hold no space and start with ``<|``."""
    form = {"normalizer": spec.get("normalizer"), "pre_tokenizer": spec.get("pre_tokenizer")}
    special = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return form == CUTS and special and spec["model"]["type"] == "BPE" and bool(spec["model"].get("end_of_word_suffix"))


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str, end_id: int) -> ChunkEncoder:
    return ChunkEncoder(path, end_id)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def groups(rows: Iterator[tuple[int | None, bytes | None]]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, together about ``PIECE`` bytes of text at a time; a longer text by itself."""
    ids, own, size = [], [], 0
    for doc_id, text in rows:
        text = text or b""
        if own and size + len(text) > PIECE:
            yield ids, own
            ids, own, size = [], [], 0
        ids.append(doc_id)
        own.append(text)
        size += len(text)
    if own:
        yield ids, own


MANIFEST = "shard long, name string, records long, tokens long, bytes long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of ``docs`` in ascending id order; returns the manifest, itself written there."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = chunk_encoder(tokenizer, end_id), TaskContext.get().partitionId()
        files, base = filesystem(folder)
        name, index, at, tokens, out = f"{shard:06d}-{uuid.uuid4().hex}", [], 0, 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}.rec", compression=None, buffer_size=1 << 20)
            for ids_of, own in groups(zip(column(batch, "id").to_pylist(), texts(batch))):
                for doc_id, ids in zip(ids_of, encode.many(own) if len(own) > 1 else map(encode, own)):
                    data = pack(doc_id, ids, encode.width)
                    out.write(data)
                    index.append((at, len(data), tokens))
                    at, tokens = at + len(data), tokens + len(ids) // encode.width
        if out is not None:
            out.close()
            with files.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "records": [len(index)], "tokens": [tokens], "bytes": [at]})

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    shards = rows.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(run, MANIFEST)
    shards.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, per_read: int = 4 << 20) -> DataFrame:
    """Per record of the shards: doc_id, start (ids of all records before it), n_tokens and ids_crc32
    (of its ids as little-endian 32-bit numbers). The manifest has one row a shard; each shard's start
    is a running sum over it. A task reads a shard through its index, ``per_read`` bytes at a time."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{base}/{row['name']}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with files.open_input_file(f"{base}/{row['name']}.rec") as f:
                    k = 0
                    while k < len(index):
                        j = k + 1
                        while j < len(index) and index[j, 0] + index[j, 1] - index[k, 0] <= per_read:
                            j += 1
                        data = f.read_at(int(index[j - 1, 0] + index[j - 1, 1] - index[k, 0]), int(index[k, 0]))
                        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for offset, length, tokens in index[k:j].tolist():
                            doc_id, ids = unpack(data[offset - int(index[k, 0]) :][:length])
                            out["doc_id"].append(doc_id)
                            out["start"].append(row["start"] + tokens)
                            out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))
                        k = j

    spread = starts.repartition(partitions(spark), F.col("shard"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """The records' (doc_id, ids) in a seeded random order of shards and of records within a shard, each by a range read."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{base}/{row['name']}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with files.open_input_file(f"{base}/{row['name']}.rec") as f:
                    for k in np.random.default_rng([seed, row["shard"]]).permutation(len(index)):
                        doc_id, ids = unpack(f.read_at(int(index[k, 1]), int(index[k, 0])))
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [ids.tolist()]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return manifest.orderBy(F.xxhash64(F.lit(seed), "shard")).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    folder = scratch(docs.sparkSession, "records")
    write(docs, folder, tokenizer, end_id)
    return read(docs.sparkSession, folder)

"""Vector functions: similarity, normalisation, the little-endian codec, and embedders."""

from __future__ import annotations

import abc
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_AT, MARGIN, FULL_AT = 0.55, 0.06, 0.75
HASH_DIMENSIONS = 64


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def dot(a: Column, b: Column) -> Column:
    """Inner product; of unequal lengths the longer's rest is ignored."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def normalized(v: Column) -> Column:
    """Of unit length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def is_match(similarity: Column, best: Column) -> Column:
    """Thresholds are compared in single precision, as the similarities are stored."""
    sim = similarity.cast("float")
    return (sim >= F.lit(MATCH_AT).cast("float")) & (sim >= best.cast("float") - F.lit(MARGIN).cast("float"))


def semantic_score(similarity: Column) -> Column:
    at = (similarity.cast("float").cast("double") - MATCH_AT) / (FULL_AT - MATCH_AT)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))


def from_bytes(data: Column) -> Column:
    """Little-endian 32-bit floats; bytes beyond a multiple of four are ignored."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return decode(data)


def to_bytes(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def hash_bucket(word: str) -> int:
    """FNV-1a (64 bits) of a word's UTF-8 bytes, mod 64. The low six bits of a product and of an exclusive or
    need only the low six bits before: 37 and 51 are those of the offset and of the prime."""
    found = 37
    for byte in word.encode():
        found = ((found ^ byte) * 51) % HASH_DIMENSIONS
    return found


#: Words whose buckets a worker keeps; beyond it the table starts anew.
MOST_KNOWN = 1 << 17


class Buckets(dict):
    """Of a word the bucket of its lower case without one final s; ``HASH_DIMENSIONS`` if it has two bytes or fewer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        telling = len(word) > 2 or len(word.encode()) > 2
        found = self[word] = hash_bucket(word.lower().removesuffix("s")) if telling else HASH_DIMENSIONS
        return found


_KNOWN = Buckets()


def hash_vectors(texts: pa.Array) -> pa.Array:
    """The texts' vectors. One text at a time becomes Python objects."""
    rows = np.zeros((len(texts), HASH_DIMENSIONS))
    for row, text in zip(rows, texts):
        if text.is_valid:
            found = np.fromiter(map(_KNOWN.__getitem__, _WORDS.findall(text.as_py())), np.int64)
            row[:] = np.bincount(found, minlength=HASH_DIMENSIONS + 1)[:HASH_DIMENSIONS]
            norm = np.sqrt(row @ row)
            if norm:
                row /= norm
    ends = np.arange(len(texts) + 1, dtype=np.int32) * np.int32(HASH_DIMENSIONS)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), mask=texts.is_null())


def hash_embedding(text: Column) -> Column:
    """The hash embedder: counts of word buckets, normalised."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return hash_vectors(texts)

    return run(text)


class Embedder(abc.ABC):
    """What turns texts into unit vectors. ``embed`` maps a column; models load once a worker."""

    model: str
    dimensions: int

    def available(self) -> tuple[bool, str | None]:
        return True, None

    @abc.abstractmethod
    def embed(self, text: Column) -> Column: ...

    def embed_query(self, text: Column) -> Column:
        return self.embed(text)


class HashEmbedder(Embedder):
    model, dimensions = "hash-64", HASH_DIMENSIONS

    def embed(self, text: Column) -> Column:
        return hash_embedding(text)


#: Names the folder of models, before those beside the package and below the working directory.
MODELS_VARIABLE = "GLEANER_MODELS"


def model_folders() -> list[str]:
    """Where models are looked for, first to last."""
    named = os.environ.get(MODELS_VARIABLE)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return [*([named] if named else []), os.path.join(package, "models"), os.path.join(os.getcwd(), "models")]


def find_model(name: str, files: tuple[str, ...], folders: list[str] | None = None) -> tuple[str | None, str | None]:
    """(folder, None) of the first place that holds all of a model's files, or (None, why not)."""
    folders = model_folders() if folders is None else folders
    for folder in folders:
        at = os.path.join(folder, name)
        if all(os.path.isfile(os.path.join(at, f)) for f in files):
            return at, None
    held = next((f for f in folders if os.path.isdir(os.path.join(f, name))), None)
    if held is None:
        return None, f"no model {name} in {', '.join(folders)}"
    return None, f"missing {', '.join(f for f in files if not os.path.isfile(os.path.join(held, name, f)))} in {os.path.join(held, name)}"


class OnnxEmbedder(Embedder):
    """A 384-dimensional sentence model run by onnxruntime, from a folder with ``model.onnx`` and ``tokenizer.json``:
    the first token's vector of at most 512 tokens, normalised; queries carry the model's prefix."""

    model, dimensions = "bge-small-en-v1.5", 384
    QUERY = "Represent this sentence for searching relevant passages: "

    FILES = ("model.onnx", "tokenizer.json")

    def __init__(self, folder: str | None = None):
        """``folder`` holds the model's files; by default it is looked for."""
        self.folder, self.reason = (folder, None) if folder is not None else find_model(self.model, self.FILES)

    def available(self) -> tuple[bool, str | None]:
        if self.folder is None:
            return False, self.reason
        missing = [f for f in self.FILES if not os.path.exists(os.path.join(self.folder, f))]
        return not missing, f"missing {', '.join(missing)} in {self.folder}" if missing else None

    def embed(self, text: Column) -> Column:
        folder = self.folder

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime
            from tokenizers import Tokenizer

            session, tokenizer = onnxruntime.InferenceSession(f"{folder}/model.onnx"), Tokenizer.from_file(f"{folder}/tokenizer.json")
            tokenizer.enable_truncation(512)
            tokenizer.enable_padding()
            names = {x.name for x in session.get_inputs()}
            for batch in batches:
                out = []
                for at in range(0, len(batch), 16):
                    found = tokenizer.encode_batch(batch[at : at + 16].fillna("").tolist())
                    ids, mask = np.array([e.ids for e in found]), np.array([e.attention_mask for e in found])
                    feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                    first = session.run(None, {k: v for k, v in feed.items() if k in names})[0][:, 0].astype(float)
                    norm = np.linalg.norm(first, axis=1, keepdims=True)
                    out += list(first / np.where(norm == 0, 1, norm))
                yield pd.Series(out)

        return run(text)

    def embed_query(self, text: Column) -> Column:
        return self.embed(F.concat(F.lit(self.QUERY), text))

"""Embedding backends and the assembly of weighted vectors."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialize
from ..functions import vectors
from ..functions.hashing import indexed_slots

#: The host that answers nothing without a key, and the address that is asked where none is given: fixed values.
KEY_HOST, DEFAULT_URL = "api.openai.com", "https://api.openai.com/v1/embeddings"
#: Files of a local model that the engine reads: fixed values.
FILES = ("model.onnx", "tokenizer.json")
#: Requests that one task has under way at a time.
AT_ONCE = 8
#: Weights of the code, style, structure and holistic parts.
WEIGHTS = {"code": 0.55, "style": 0.2, "structure": 0.15, "holistic": 0.1}
SIZE = 64
Backend = Callable[[list[str]], list[list[float]]]


def _places(tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the slot of each token."""
    size = np.array([len(t) for t in tokens], np.int64)
    row = np.repeat(np.arange(len(tokens)), size)
    index = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, indexed_slots([t for own in tokens for t in own], index, SIZE)


def mock(texts: list[str]) -> list[list[float]]:
    """Deterministic test vectors: each token adds 1 to the slot of its hash with its index; unit length."""
    tokens = [[t for t in re.split(r"\W+", x.lower(), flags=re.ASCII) if t] for x in texts]
    row, where = _places(tokens)
    out = np.zeros((len(texts), SIZE))
    np.add.at(out, (row, where), 1.0)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size == 0, 1, size)).tolist()


@dataclass(frozen=True)
class Remote:
    """A service that answers POST requests with a vector in one of three shapes."""

    url: str
    model: str
    key: str | None = None
    timeout: float = 30.0

    def endpoint(self) -> str:
        """The address as it is; a bare host, or one with /v1, gets the usual path."""
        parts = urllib.parse.urlsplit(self.url)
        path = parts.path.rstrip("/")
        return urllib.parse.urlunsplit(parts._replace(path="/v1/embeddings" if path in ("", "/v1") else path))

    def vector(self, answer: dict) -> list[float]:
        if "data" in answer:
            return answer["data"][0]["embedding"]
        if "embedding" in answer:
            return answer["embedding"]
        return answer["embeddings"][0]

    def needs_key(self) -> bool:
        return urllib.parse.urlsplit(self.endpoint()).hostname == KEY_HOST

    def one(self, text: str) -> list[float]:
        field = "prompt" if urllib.parse.urlsplit(self.endpoint()).path == "/api/embeddings" else "input"
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        ask = urllib.request.Request(self.endpoint(), json.dumps({"model": self.model, field: text}).encode(), head)
        with urllib.request.urlopen(ask, timeout=self.timeout) as found:
            v = np.array(self.vector(json.load(found)), float)
        return (v / (np.linalg.norm(v) or 1)).tolist()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.needs_key() and not self.key:
            raise ValueError(f"{KEY_HOST} needs a key")
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(self.one, texts))


@dataclass(frozen=True)
class Local:
    """An ONNX sentence encoder read from a folder that every executor has; mean pooling and unit length."""

    path: str

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import onnxruntime
        from tokenizers import Tokenizer

        if not hasattr(self, "_loaded"):
            object.__setattr__(self, "_loaded", (onnxruntime.InferenceSession(f"{self.path}/model.onnx"), Tokenizer.from_file(f"{self.path}/tokenizer.json")))
        session, tokenizer = self._loaded
        tokenizer.enable_padding()
        coded = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(c, a) for c in coded], np.int64) for a in ("ids", "attention_mask"))
        names = {i.name for i in session.get_inputs()}
        feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", np.zeros_like(ids))) if k in names}
        hidden = session.run(None, feed)[0]
        pooled = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)).tolist()


def fetch(path: str, repo: str, copy: Callable[[str, str], None] | None = None) -> None:
    """Puts what a local model lacks at path, file by file from repo, with copy(address, place); a file takes its place when it is whole.
    Without copy it raises: the engine itself reaches no network."""
    for name in FILES:
        place = os.path.join(path, name)
        if not os.path.exists(place):
            if copy is None:
                raise FileNotFoundError(f"{place} is missing, and there is no way to fetch it")
            os.makedirs(os.path.dirname(place), exist_ok=True)
            copy(f"{repo.rstrip('/')}/{name}", f"{place}.part")
            os.replace(f"{place}.part", place)


def backend(kind: str, **options) -> Backend:
    """By name: remote, mock, or local for anything else."""
    if kind == "remote":
        if not options.get("model"):
            raise ValueError("a remote backend needs a model")
        made = Remote(**{"url": DEFAULT_URL, **options})
        if made.needs_key() and not made.key:
            raise ValueError(f"{KEY_HOST} needs a key")
        return made
    return mock if kind == "mock" else Local(**options)


def embed(rows: DataFrame, text: str, into: str, model: Backend = mock) -> DataFrame:
    """Adds `into`, the vector of column `text`; each distinct text is embedded once, an empty or null one has no vector."""
    return embed_parts(rows, {text: into}, model)


def embed_parts(rows: DataFrame, parts: dict[str, str], model: Backend = mock) -> DataFrame:
    """Adds a vector column for each text column of parts (text column to vector column). A text is embedded once, however many rows and
    columns have it; an empty or null one has no vector. Texts meet their vectors by a digest of 128 bits."""
    texts = F.explode(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))).alias("rep")
    distinct = rows.select(texts).select(F.md5("rep").alias("k"), "rep").dropDuplicates(["k"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"k": batch.k, "vec": model(batch.rep.tolist())})

    made = materialize(distinct.mapInPandas(run, "k string, vec array<double>"), "vectors")  # a backend is asked once, whatever is read again
    out = rows
    for text, into in parts.items():
        keyed = made.select(F.col("k").alias(f"_{into}"), F.col("vec").alias(into))
        out = out.join(keyed, F.when(F.col(text) != "", F.md5(text)) == F.col(f"_{into}"), "left").drop(f"_{into}")
    return out


def entry_vector(has_styles: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The combined vector of columns code_vec, style_vec, structure_vec and holistic_vec; style counts only with styles."""
    style = F.when(has_styles, F.lit(weights["style"])).otherwise(F.lit(0.0))
    parts = {k: (style if k == "style" else F.lit(w)) for k, w in weights.items()}
    return vectors.combined([(F.col(f"{k}_vec"), w) for k, w in parts.items()])


def token_slots(docs: DataFrame) -> DataFrame:
    """doc_id, slot and n: how many tokens of each document fall into each of SIZE slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [[t for t in re.split(r"\W+", (x or "").lower(), flags=re.ASCII) if t] for x in batch.text]
            row, where = _places(tokens)
            count = np.bincount(row * SIZE + where, minlength=len(tokens) * SIZE)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy()[some // SIZE], "slot": some % SIZE, "n": count[some]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, slot long, n long")

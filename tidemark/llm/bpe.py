"""Byte-level BPE through a global shuffle of distinct words.

A text is cut into words at single spaces between other characters, which are
always borders of pre-tokens, so a word's ids never depend on its neighbours.
Blocks of documents send each of their distinct words once to the partition
that the word hashes to; there each distinct word of the corpus is encoded
once; the ids go back to the blocks, where documents are put together by the
positions of their words.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, repeatable

#: White space as Unicode has it; Python's own notion has four more characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a text can be cut: before a space between two other characters.
CUT = re.compile(f"(?<=[^{WHITE}])(?= [^{WHITE}])")
#: Bytes of text in a block of documents.
BLOCK_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def words_of(text: str) -> list[str]:
    """Words that make up the text, each with the space before it."""
    return CUT.split(text) if text else []


@lru_cache(2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary as an encoder without special tokens, once per worker."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def _pack(values: np.ndarray) -> bytes:
    """Small whole numbers, by bytes of equal weight so that they compress."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    return zlib.compress(np.array([len(data), *map(len, data)], "<u4").tobytes() + b"".join(data), 1)


def _unpack_words(data: bytes) -> list[str]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4))).tolist()
    return [data[a:b].decode() for a, b in zip([4 + 4 * n, *ends], ends)]


#: White space other than spaces and line ends, and the marks of keys.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")


class Words:
    """Numbers of words as they come.

    A key is a word without its first space; after a NUL one that has no space
    before it; after a space any word.
    """

    def __init__(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)

    def places(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, in order."""
        if not text:
            return np.empty(0, np.uint32)
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
            keys = [w if w[0] == " " else "\0" + w for w in words_of(text)]
        else:
            keys = text.split(" ")
            keys[0] = "\0" + keys[0]
        return np.fromiter(map(self.numbers.__getitem__, keys), np.uint32, len(keys))

    def listed(self) -> list[str]:
        """The distinct words by number."""
        return [k[1:] if k[0] == "\0" else k if k[0] == " " else " " + k for k in self.numbers]


#: Texts that a task turns into Python objects at once.
SLICE = 256


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str], list[np.ndarray]]]:
    """(number, ids, distinct words, positions) of blocks of a partition."""
    number, ids, seen, places, size = 0, [], Words(), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(key)
                places.append(seen.places(text or ""))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield number, ids, seen.listed(), places
                    number, ids, seen, places, size = number + 1, [], Words(), [], 0
    if ids:
        yield number, ids, seen.listed(), places


def _checksum(words: list[str]) -> int:
    return zlib.crc32("\n".join(words).encode())


def _target(words: list[str], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % n for w in words), np.int64, len(words))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row per input row; null and empty texts have none.

    Repeated rows and null ids stay. Words travel and are encoded once for
    each block and once for the corpus; a word in a third of all places costs
    no more than a rare one. Two passes over the texts must see the same blocks,
    as they do of files; input that may change its order, such as the result of
    a shuffle, is written to the shared folder first, and that table stays as
    long as the result may be read. A checksum of each block makes sure.
    """
    from pyspark import TaskContext

    n = partitions(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if not repeatable(source):
        source = materialize(source, "texts")
    arrow_id = pa.Schema.from_pandas(source.select("id").limit(0).toPandas()).field(0).type if kind not in ("bigint", "int", "string") else {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, _, words, _ in _blocks(batches):
            to = _target(words, n)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            groups = np.split(order, cuts[1:]) if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[order][cuts].astype(np.int32)), pa.array([(task << 32) + number] * len(groups), pa.int64()), pa.array([_checksum(words)] * len(groups), pa.int64()), pa.array([_pack_words([words[i] for i in g.tolist()]) for g in groups], pa.binary())],
                ["target", "block", "check", "words"],
            )

    def answer(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_word, known = encoding(ranks_path, pattern).encode_ordinary, {}
        for part in rows:
            packed = []
            for data in part["words"]:
                ids: list[int] = []
                sizes = []
                for w in _unpack_words(data):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = encode_word(w)
                    sizes.append(len(found))
                    ids += found
                packed.append(_pack(np.array([len(sizes), *sizes, *ids], np.int64)))
            yield pd.DataFrame({"block": part["block"], "target": part["target"], "check": part["check"], "ids": packed})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, ids, words, places in _blocks(batches):
            # the answer comes by target, so words are numbered in that order
            to = _target(words, n)
            number_of = np.empty(len(to), np.int64)
            number_of[np.argsort(to, kind="stable")] = np.arange(len(to))
            packed = [_pack(number_of[p]) for p in places]
            block = pa.array([(task << 32) + number] * len(ids), pa.int64())
            check = pa.array([_checksum(words)] * len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([block, check, pa.array(ids, arrow_id), pa.array(packed, pa.binary())], ["block", "check", "id", "places"])

    def join(key: tuple, docs_of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for data in answers.sort_values("target")["ids"]:
            values = _unpack(data).astype(np.int64)
            sizes.append(values[1 : 1 + values[0]])
            ids.append(values[1 + values[0] :])
        if set(answers["check"]) - set(docs_of["check"]):
            raise ValueError("the two passes over the texts met different rows: their files changed meanwhile")
        size, flat = np.concatenate(sizes), np.concatenate(ids).astype(np.int32)
        end = np.cumsum(size)
        out = []
        for data in docs_of["places"]:
            at = _unpack(data)
            many = size[at]
            # where each word's ids start, less how many ids stand before it here
            shift = end[at] - np.cumsum(many)
            out.append(flat[np.repeat(shift, many) + np.arange(many.sum())])
        return pd.DataFrame({"id": docs_of["id"], "ids": out})

    sent = source.mapInArrow(send, "target int, block long, check long, words binary")
    answers = sent.groupBy("target").applyInPandas(answer, "block long, target int, check long, ids binary")
    placed = source.mapInArrow(place, f"block long, check long, id {kind}, places binary")
    joined = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(join, f"id {kind}, ids array<int>")
    return joined.withColumnRenamed("id", id_col)


def token_bytes(ranks_path: str) -> list[bytes]:
    """The token-byte table: bytes of each id."""
    ranks = read_ranks(ranks_path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def join_bytes(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The same rows with the bytes that the ids stand for; null ids give none."""

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(ranks_path)
        for ids in batches:
            yield ids.map(lambda x: join_bytes(x.tolist(), table) if x is not None else None)

    return encoded.withColumn(out_col, bytes_of(F.col(ids_col)))


def summary(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: sizes and digests of ids and decoded bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        names = [str(i) for i in range(len(table))]
        for batch in batches:
            sizes, listed, decoded = [], [], []
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values.to_numpy().tolist()
                sizes.append(len(ids))
                listed.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(join_bytes(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = encode(docs, ranks_path, pattern, id_col, text_col).select(F.col(id_col).alias("id"), "ids")
    return encoded.mapInArrow(digests, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

"""SentencePiece ids and the text they stand for, by a table of distinct chunks.

A marked word is a run of spaces, written as marks, and what follows it up to the next space. Where no piece of the
vocabulary has a mark after another character, no merge crosses the end of a marked word, so each distinct one can be
segmented by itself. A task keeps a table of those it has met; texts become places in the table, and the ids are joined
back by position with one gather. Nothing is shuffled and each distinct marked word is segmented once a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts, tune_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks that a table holds before it is emptied; a bound on memory alone.
TABLE_CHUNKS = 300_000
#: Chunks longer than this are segmented but not kept in the table.
KEPT_CHARS = 64
MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    crossing = [p for i in range(sp.vocab_size()) if re.search(f"[^{MARK}]{MARK}", p := sp.id_to_piece(i))]
    if crossing:
        raise ValueError(f"{len(crossing)} pieces cross the start of a word, such as {crossing[0]!r}: chunks can't be segmented by themselves")
    # The table segments chunks that are already marked: that must be what the model does to a text.
    if sp.decode(sp.encode(" a  b ")) != " a  b ":
        raise ValueError("this model alters white space, which chunks can't follow")
    return sp


def marked(text: str) -> list[str]:
    """The chunks of a text: each space is a mark, and one more comes first."""
    if "  " not in text and MARK not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")  # one word each, its single mark understood
    return _CHUNK.findall(MARK + text.replace(" ", MARK))


class ChunkTable(dict):
    """Distinct chunk to its place; places to their ids, in one flat array."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.sp = processor(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.flat: list[int] = []
        self.arrays = None

    def segment(self, chunk: str) -> list[int]:
        if chunk == MARK:  # a text's last space; without its mark it would be an empty text, which has no ids
            return [self.sp.piece_to_id(MARK)]
        # Encoding adds a mark in front, so the chunk's own first one is left out.
        return self.sp.encode(chunk[1:].replace(MARK, " ") if chunk[:1] == MARK else chunk, num_threads=1)

    def __missing__(self, chunk: str) -> int:
        ids = self.segment(chunk)
        place = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        if len(chunk) <= KEPT_CHARS:
            self[chunk] = place
        return place

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.starts) > TABLE_CHUNKS or len(self.flat) > 8 * TABLE_CHUNKS:
            self.reset()
        places, counts = [], np.zeros(len(found), np.int64)
        for i, text in enumerate(found):
            if text:
                chunks = marked(text)
                places.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
                counts[i] = len(chunks)
        if not places:
            return np.zeros(0, np.int32), counts
        if self.arrays is None or len(self.arrays[0]) != len(self.starts):
            self.arrays = np.array(self.starts), np.array(self.sizes), np.array(self.flat, np.int32)
        starts, sizes, flat = self.arrays
        at = np.concatenate(places)
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])]
        done = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], ends])[done]
        return ids, np.diff(total)


class PieceBytes:
    """Ids to text: the bytes of each piece, joined."""

    def __init__(self, path: str) -> None:
        sp = processor(path)
        self.bytes = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.bytes[sp.unk_id()] = " ⁇ ".encode()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) for each row: its ids are those that the model gives for the whole text, and
    exact tells whether decoding them gives the text again.

    A mark character in a text decodes to a space, so such a text isn't exact. A null text has null ids, no tokens and a
    null exact; an empty one has no ids and is exact. Null doc_ids and repeated rows stay as they are; an empty table
    gives an empty result; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pieces = ChunkTable(model), PieceBytes(model)
        for batch in batches:
            found = batch.column(1).to_pylist()
            ids, sizes = table.encode(found)
            ends = np.cumsum(sizes)
            spans = [ids[e - n : e] for e, n in zip(ends, sizes)]
            exact = [None if t is None else pieces.decode(x.tolist()) == t for t, x in zip(found, spans)]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([t is None for t in found] + [False]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(sizes), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    tune_arrow(docs.sparkSession)
    return texts(docs).mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) for rows of doc_id and ids. Null ids give a null text; ids that the model doesn't have are left out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceBytes(model)
        most = len(pieces.bytes)
        for batch in batches:
            found = [None if x is None else pieces.decode([i for i in x if i is not None and 0 <= i < most]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    tune_arrow(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))

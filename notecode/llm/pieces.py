"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of whitespace markers and what follows it up to the next marker. If no piece of the
model holds a marker after another character, merges never cross chunks, so a text's ids are its
chunks' ids in order. Each block of documents makes a table of its distinct chunks, each of them is
segmented once, and the ids are put back by position. A worker keeps its table from block to block.

Defined results: a NULL text is an empty one, whose ids are just begin and end; equal rows give equal
rows; texts of any length are encoded whole; empty input gives no rows. The table is emptied after each
task, so that later stages find the memory free.
"""

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notecode.llm.batches import short_batches, trimmed

MARK = "▁"
RUN = re.compile(" +[^ ]*")
BLOCK_CHARS = 2_000_000
KEPT_CHUNKS = 200_000


class ChunkTable:
    """The ids of the chunks that this worker has met, emptied when it holds `KEPT_CHUNKS`."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("this model has pieces that cross whitespace markers")
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def lone_marker(self) -> list[int]:
        """The ids of a marker at the end of a text; as a text of its own it would be empty."""
        return self.model.encode("a ")[len(self.model.encode("a")) :]

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that are not in the table yet."""
        if len(self.places) > KEPT_CHUNKS:
            self.forget()
        new = list(chunks.difference(self.places))
        if new:
            ids = self.model.encode(new, num_threads=1)
            if "" in new:
                ids[new.index("")] = self.lone_marker()
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for one in ids for i in one), np.uint32, int(sizes.sum()))
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.ids = np.concatenate([self.ids, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


@lru_cache(maxsize=1)
def _table(model_path: str) -> ChunkTable:
    return ChunkTable(model_path)


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, which the library puts back.

    The library puts a marker before the text and takes blanks for markers.
    """
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in RUN.findall(" " + text)]
    return text.split(" ")


def encode_block(table: ChunkTable, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, with begin and end."""
    split = [chunks(text) for text in texts]
    table.learn(set().union(*split))
    counts = np.fromiter(map(len, split), np.int64, len(split))
    places = np.fromiter(
        (table.places[c] for one in split for c in one), np.int64, int(counts.sum())
    )
    first = table.starts[places]
    sizes = table.starts[places + 1] - first
    ends = np.cumsum(sizes)
    ids = table.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    begin, end = ([i] for i in (table.model.bos_id(), table.model.eos_id()))
    return [
        np.concatenate([begin, ids[a:b], end]).astype("<u4") for a, b in zip(bounds, bounds[1:])
    ]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of the texts of about `BLOCK_CHARS` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(
    documents: DataFrame, model_path: str, with_ids: bool = True, with_decoded: bool = True
) -> DataFrame:
    """(`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` and, if asked for, `ids`, `decoded`)."""
    short_batches(documents.sparkSession)
    kept = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}"
    schema = f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"
    if with_decoded:
        schema += ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _blocks(texts):
                ids = encode_block(table, texts[a:b])
                decoded = [table.model.decode(one.tolist()) for one in ids]
                out = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_tokens": pa.array(map(len, ids), pa.int64(), size=b - a),
                    "ids_sha256": pa.array([sha256(one.tobytes()).hexdigest() for one in ids]),
                    "decoded_sha256": pa.array([sha256(t.encode()).hexdigest() for t in decoded]),
                }
                if with_ids:
                    out["ids"] = pa.array([one.view(np.int32) for one in ids], pa.list_(pa.int32()))
                if with_decoded:
                    out["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return documents.select("doc_id", "text").mapInArrow(trimmed(run, lambda: _table(model_path).forget()), schema)

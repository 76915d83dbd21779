"""Token-id output: documents in id order as segments of Simple-8b words.

File format: Parquet rows (segments). part and seq give the order; doc_ids are
the documents of the segment and lengths (int32, little-endian) their numbers
of ids; before is the number of ids of earlier segments of the part; n_ids, words (uint64, little-endian) and offsets (int32 word offset of
each block of 1,024 ids) hold the ids, documents end to end.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .storage import _hadoop, estimated_bytes, shared_dir

#: Ids a segment is closed at; a document is never cut.
SEGMENT_IDS = 1 << 20
#: Bytes of the input's estimated size for each partition, and the most partitions.
PART_BYTES, MOST_PARTS = 128 << 20, 1 << 20
_encoders: dict = {}


class Encoder:
    """Token ids of whole texts, a batch of texts at a time.

    A byte-level pre-tokenizer never joins a character with a space after it,
    so a text may be cut before every space that follows a non-space, and the
    ids of the pieces put together are those of the text. Arrow cuts the texts
    and numbers the different pieces of a batch; each of these is encoded once,
    end to end with others, and told apart by the bytes of its tokens. A text
    with a space after other white space is encoded as a whole.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.cuttable = self._cuttable()
        if self.cuttable:
            #: These are tokens of their own after a letter or digit.
            self.stops = {c: self.whole(c) for c in ".,"}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():  # a byte is one character of a token, but in special tokens
                self.width[i] = len(token.encode()) if token in special else len(token)

    def _cuttable(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
        special = [t for t in made.get("added_tokens", ()) if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not norm and not special

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _spaced(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of ' ' + piece; no piece is empty or ends in white space."""
        flat, counts = [np.array([], np.uint32)], [np.array([], np.int64)]
        words, sizes = pieces.to_pylist(), pc.binary_length(pieces).to_numpy().astype(np.int64) + 1
        for i in range(0, len(words), 256 * 64):
            starts = range(i, min(i + 256 * 64, len(words)), 256)
            found = self.tokenizer.encode_batch_fast([" " + " ".join(words[j : j + 256]) for j in starts], add_special_tokens=False)
            for j, e in zip(starts, found, strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[j : j + 256])) + 1
                flat.append(ids)
                counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number) of ' ' + piece for each piece; number -1: empty or ending in white space."""
        last = pc.utf8_slice_codeunits(pieces, -1)
        blank = pc.or_(pc.utf8_is_space(last), pc.equal(pc.binary_length(pieces), 0))
        # A stop after a letter or digit is a token of its own: such pieces share the ids of their stem.
        stopped = pc.and_(pc.match_substring_regex(pieces, r"[\pL\pN][.,]$"), pc.invert(blank))
        stem = pc.if_else(blank, pa.scalar(None, pa.string()), pc.if_else(stopped, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)).dictionary_encode()
        ids, counts = self._spaced(stem.dictionary)
        known = np.logical_not(blank.to_numpy(zero_copy_only=False))
        at = pc.fill_null(stem.indices, 0).to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        starts = np.zeros(len(known), np.int64)
        number = np.full(len(known), -1)
        if len(counts):
            starts[known], number[known] = (ends - counts)[at[known]], counts[at[known]]
        # Stems followed by their stop go behind the stems.
        own = np.flatnonzero(stopped.to_numpy(zero_copy_only=False))
        n = number[own]
        take = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        stops = np.where(pc.equal(last, ".").to_numpy(zero_copy_only=False)[own], self.stops["."][0], self.stops[","][0]).astype(np.uint32)
        behind = np.insert(ids[take], np.cumsum(n), stops) if len(own) else ids[:0]
        starts[own], number[own] = len(ids) + np.cumsum(n + 1) - n - 1, n + 1
        return np.concatenate((ids, behind)), starts, number

    def __call__(self, texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text + 1, ids, ids of each text), closed at `limit` ids; the end id is included."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return
        if not self.cuttable:
            rows = [np.append(self.whole(t), self.end) for t in texts.to_pylist()]
            yield 0, len(rows), np.concatenate(rows), np.array([len(r) for r in rows])
            return
        cut = pc.split_pattern(texts, " ")
        starts, ends = cut.offsets.to_numpy()[:-1].astype(np.int64), cut.offsets.to_numpy()[1:].astype(np.int64)
        spaced, first = cut.values.dictionary_encode(), cut.values.take(pa.array(starts)).dictionary_encode()
        ids, at, number = self._pieces(spaced.dictionary)
        heads = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(first.dictionary.to_pylist(), add_special_tokens=False)]
        lengths = np.array([len(h) for h in heads])
        # Pieces are numbered: between spaces, then first ones, then the end.
        ids = np.concatenate((ids, *heads, self.end))
        at = np.concatenate((at, len(ids) - len(self.end) - lengths.sum() + np.cumsum(lengths) - lengths, [len(ids) - len(self.end)]))
        odd_head = np.array([not h or h[-1].isspace() for h in first.dictionary.to_pylist()])
        piece = spaced.indices.to_numpy().astype(np.int64)
        odd = np.add.reduceat((number < 0)[piece], starts) > 0
        odd |= odd_head[first.indices.to_numpy()] & (ends - starts > 1)
        number = np.concatenate((np.maximum(number, 0), lengths, [len(self.end)]))
        piece[starts] = first.indices.to_numpy() + len(spaced.dictionary)
        piece = np.insert(piece, ends, len(number) - 1)
        starts, ends = starts + np.arange(len(starts)), ends + np.arange(1, len(starts) + 1)
        sizes = np.add.reduceat(number[piece], starts)
        whole = {int(i): np.append(self.whole(texts[int(i)].as_py()), self.end) for i in np.flatnonzero(odd)}
        for i, x in whole.items():
            sizes[i] = len(x)
        edge = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            z = len(sizes) if limit is None else min(len(sizes), int(np.searchsorted(edge, (edge[a - 1] if a else 0) + limit)) + 1)
            yield a, z, self._join(piece, starts, ends, a, z, ids, at, number, whole), sizes[a:z]
            a = z

    @staticmethod
    def _join(piece, starts, ends, a: int, z: int, ids, at, number, whole: dict) -> np.ndarray:
        """Ids of the texts a to z."""
        parts, done = [], a
        for i in [*(i for i in whole if a <= i < z), z]:
            if i > done:
                own = piece[starts[done] : ends[i - 1]]
                n = number[own]
                shift = np.repeat(at[own] - (np.cumsum(n) - n), n)
                shift += np.arange(len(shift))
                parts.append(ids[shift])
            if i < z:
                parts.append(whole[i])
            done = i + 1
        return np.concatenate(parts)


def encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, to_ids = TaskContext.get().partitionId(), 0, 0, encoder(path, end_id)
        for batch in batches:
            keys = batch.column(0)
            for a, z, ids, sizes in to_ids(batch.column(1), SEGMENT_IDS):
                words, offsets = simple8b.encode(ids)
                own = keys.slice(a, z - a)
                columns = {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    "lengths": pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    "offsets": pa.array([offsets.astype("<i4").tobytes()], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
                seq, before = seq + 1, before + len(ids)

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write the ids of every whole text (null: empty), each followed by end_id, to the folder `out`.

    Documents are in ascending order of id, null first, repeated ids by the
    hash of their text; repeated rows are written each time, an empty table
    gives no segments, and columns beside id and text are not read. Whole texts
    are encoded, however long. The tokenizer's file must be at one path on all nodes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, min(MOST_PARTS, estimated_bytes(docs) // PART_BYTES))
    ordered = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    segments = ordered.mapInArrow(_writer(tokenizer_path, end_id), f"part int, seq int, before long, doc_ids array<{kind}>, lengths binary, n_ids long, words binary, offsets binary")
    segments.write.mode("overwrite").option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of each document in the files."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids)


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # A row a part: as many as the writer had partitions, not more with more segments.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("of_part"))
    name = column.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = simple8b.decode(np.frombuffer(r.words, "<u8"), np.frombuffer(r.offsets, "<i4"), r.n_ids).astype("<u4")
                sizes = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"doc_id": list(r.doc_ids), "start": r.start + ends - sizes, "n_tokens": sizes, name: [value(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]})

    placed = files.join(F.broadcast(parts), "part").withColumn("start", F.col("of_part") + F.col("before"))
    return placed.select("doc_ids", "lengths", "n_ids", "words", "offsets", "start").mapInPandas(run, f"doc_id {kind}, start long, n_tokens long, {column}")


def token_digest(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """The result of the registered query, from files written and read back."""
    spark = docs.sparkSession
    if out is None:
        out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
        where, fs = _hadoop(spark, out)
        fs.deleteOnExit(where)
    write_tokens(docs, tokenizer_path, out)
    return _read(spark, out, "ids_crc32 long", _checksum)

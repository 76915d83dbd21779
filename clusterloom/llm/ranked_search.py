"""Ranked lexical search: document-sharded postings with integer impacts.

A shard holds some MB of documents as compressed sparse rows: its terms, and
for each term the positions and impacts of the documents that hold it. What an
impact needs of the corpus (documents, mean length) is counted first, so that
impacts are whole numbers fixed when the index is written; what hangs on the
query's terms alone (their weights) is a factor of its own. A query walks its
terms one by one and adds into a dense array over the shard's documents; the
best of each shard meet in two steps.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .words import alnum_words, trim

#: Text bytes of a shard, and its documents at most. A text beyond that is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Text bytes of the queries that are asked at once: they and their terms' weights are broadcast.
QUERY_BYTES = 8 << 20
#: First-step groups in which a query's best rows meet.
MERGE_PARTS = 64
#: Fixed values of the score.
SCALE, SLOPE, LENGTH_SCALE, LENGTH_BASE, LENGTH_SHARE = 1_000_000_000, 20, 1000, 50, 50
NO_ID = np.iinfo(np.int64).max
SHARD_DDL = "ids binary, lengths binary, terms binary, starts binary, places binary, impacts binary"


def impacts_of(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impact of each posting from its count and its document's length."""
    norm = 100 - LENGTH_BASE + (LENGTH_SHARE * length * n_docs) // n_terms
    return (SCALE * tf) // (LENGTH_SCALE * tf + SLOPE * norm)


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents: the rows of each term are starts[t] to starts[t + 1]."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list[bytes], starts: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        self.ids, self.lengths, self.terms, self.starts, self.places, self.impacts = ids, lengths, terms, starts, places, impacts

    @classmethod
    def build(cls, ids: list[int], texts: list[bytes], n_docs: int, n_terms: int) -> Shard:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        numbers, lengths = [], []
        for text in texts:
            words = alnum_words(text)
            numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            lengths.append(len(words))
        length = np.array(lengths, np.int64)
        keys = np.concatenate(numbers) * len(texts) + np.repeat(np.arange(len(texts)), length)
        keys, tf = np.unique(keys, return_counts=True)
        of, places = np.divmod(keys, len(texts))
        starts = np.searchsorted(of, np.arange(len(number) + 1))
        return cls(np.array(ids, np.int64), length, list(number), starts, places, impacts_of(tf, length[places], n_docs, n_terms))

    def packed(self) -> dict[str, bytes]:
        return {
            "ids": self.ids.astype("<i8").tobytes(),
            "lengths": self.lengths.astype("<i8").tobytes(),
            "terms": b" ".join(self.terms),
            "starts": self.starts.astype("<i8").tobytes(),
            "places": self.places.astype("<i4").tobytes(),
            "impacts": self.impacts.astype("<i4").tobytes(),  # below 10^6
        }

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Shard:
        read = lambda c, t: np.frombuffer(row[c], t)
        return cls(read("ids", "<i8"), read("lengths", "<i8"), row["terms"].split(b" ") if row["terms"] else [], read("starts", "<i8"), read("places", "<i4"), read("impacts", "<i4"))

    def rows_of(self, wanted: dict) -> dict[bytes, slice]:
        """Postings of the wanted terms that occur here."""
        return {t: slice(self.starts[i], self.starts[i + 1]) for i, t in enumerate(self.terms) if t in wanted}

    def scores(self, terms: list[bytes], weights: dict[bytes, int], rows: dict[bytes, slice], out: np.ndarray) -> np.ndarray:
        """Score of each document, term at a time into the dense array `out`."""
        out[:] = 0
        for t in terms:
            if t in rows:
                out[self.places[rows[t]]] += weights[t] * self.impacts[rows[t]].astype(np.int64)
        return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest positive scores, equal ones by id and then position; all of them if fewer."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        kth = -np.partition(-scores[found], k - 1)[k - 1]
        above = found[scores[found] > kth]
        ties = found[scores[found] == kth]
        if len(ties) > k - len(above):
            need = k - len(above)
            last = np.partition(ids[ties], need - 1)[need - 1]
            ties = ties[ids[ties] <= last]
        found = np.concatenate([above, ties])
    return found[np.lexsort((found, ids[found], -scores[found]))][:k]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(alnum_words(text.as_py()))
            docs, total = docs + (n > 0), total + n
    trim()
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([total], pa.int64())})


def _indexer(n_docs: int, n_terms: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def settle() -> pa.RecordBatch:
            packed = Shard.build(ids, texts, n_docs, n_terms).packed()
            ids.clear(), texts.clear()
            trim()
            return pa.RecordBatch.from_pydict({c: pa.array([v], pa.binary()) for c, v in packed.items()})

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = text.as_py() or b""
                if texts and (held + len(own) > shard_bytes or len(texts) >= SHARD_DOCS):
                    yield settle()
                    held = 0
                ids.append(key.as_py() if key.is_valid else NO_ID)
                texts.append(own)
                held += len(own)
        if texts:
            yield settle()

    return run


class Index:
    """Shards (a written table, SHARD_DDL) and the counts of the corpus."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index of all whole texts. Two scans: the first counts documents and terms, the second writes the shards."""
    text = F.col(text_col).cast("binary").alias("text")
    counts = docs.select(text).filter("text is not null").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    n_docs, n_terms = counts.n or 0, counts.l or 0
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text).filter("text is not null")
    shards = rows.mapInArrow(_indexer(n_docs, max(1, n_terms), shard_bytes), SHARD_DDL)
    return Index(materialize(shards, "postings"), n_docs, n_terms)


def _document_counts(wanted: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for r in b.itertuples():
                starts = np.frombuffer(r.starts, "<i8")
                for i, t in enumerate(r.terms.split(b" ") if r.terms else []):
                    if t in wanted:
                        found[t] += int(starts[i + 1] - starts[i])
        yield pd.DataFrame({"term": list(found), "df": list(found.values())}).astype({"df": "int64"})

    return run


def _searcher(asked, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of each query over all shards of the partition."""
        queries, weights = asked.value
        best = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q, _ in queries}
        for b in batches:
            for r in b.to_dict("records"):
                shard = Shard.unpacked(r)
                rows, held = shard.rows_of(weights), np.zeros(len(shard.ids), np.int64)
                for q, terms in queries:
                    scores = shard.scores(terms, weights, rows, held)
                    top = best_of(scores, shard.ids, k)
                    if len(top):
                        both = np.concatenate([best[q][0], scores[top]]), np.concatenate([best[q][1], shard.ids[top]])
                        keep = best_of(*both, k)
                        best[q] = both[0][keep], both[1][keep]
            trim()
        for q, (scores, ids) in best.items():
            if len(ids):
                yield pd.DataFrame({"q": q, "doc_id": pd.arrays.IntegerArray(ids, ids == NO_ID), "score": scores})

    return run


def _parsed(rows) -> list[tuple[int, list[bytes]]]:
    """(query, its different terms) of rows (q, text)."""
    return [(r.q, list(dict.fromkeys(alnum_words(bytes(r.text))))) for r in rows]


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k highest-scoring documents of each row of items.

    Only scores above 0 count; equal ones go by ascending doc_id, a document
    without id (or with the largest long) after the others, as null. A term counts once a query. Null and empty
    texts, in items or documents, have no terms; an empty table on either side
    gives no rows. Repeated rows of items are asked each time, repeated
    documents found each. Queries are asked in blocks of query_bytes of text,
    one scan of the index a block; other columns may have any names.
    """
    spark = index.shards.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).filter("text is not null")
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = max(1, -(-size // query_bytes)), []
    for block in range(blocks):
        own = asked.select("q", "text").filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        queries = _parsed(own.collect())  # about query_bytes
        wanted = {t: 0 for _, terms in queries for t in terms}
        counts = index.shards.select("terms", "starts").mapInPandas(_document_counts(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {bytes(r.term): term_weight(r.df, index.n_docs) for r in counts.collect()}  # terms of the block at most
        queries = [(q, [t for t in terms if t in weights]) for q, terms in queries]
        sent = spark.sparkContext.broadcast((queries, weights))
        found.append(materialize(index.shards.mapInPandas(_searcher(sent, k), "q long, doc_id long, score long"), "found"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return search(build_index(docs), benchmark)

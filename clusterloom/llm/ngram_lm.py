"""Language-model scores by deleted interpolation of trigrams, bigrams, unigrams and a uniform floor.

Counts cover every training document. Texts are tokenized once into blocks of
word numbers, which are written to the shared folder. Each block asks for the
counts of its distinct words and bigrams with sorted 64-bit hashes, cut into
ranges of the hash; a range meets in one task, is summed over the blocks and
answered block by block. A frequent word is thus one entry a block, and no
count table is broadcast or collected. The answer says which bigrams occur in
other blocks; only trigrams that go on from one of these are asked for in turn,
as a block knows all others by itself.

The mixture weights of each context-frequency bucket are learned by
expectation-maximisation on a held-out part of the training documents whose
counts are deleted from the estimates. The likelihood of a bucket depends on
the ratios of the two estimates only, so a histogram of ratios (64 steps an
octave) is all that reaches the driver, whatever the size of the corpus. Weights
of trigrams are learned after those of bigrams, given these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import estimated_bytes, materialize
from .words import split_words, trim

#: Tokens a block is closed at (a document is never cut), and hashes that a range is meant to get from all blocks: the
#: least and the most. Between them they grow with the root of the corpus, so that a block has PIECE_KEYS or more
#: hashes for each range.
LEAST_BLOCK, MOST_BLOCK, PIECE_KEYS = 1 << 20, 1 << 25, 64
#: Bytes of a plan's estimated size for each token.
TOKEN_BYTES = 4
#: One in so many training documents is held out for the mixture weights.
HELD_OUT_ONE_IN = 8
#: Context-frequency buckets: 0, then one an octave.
BUCKETS, STEPS, NEVER = 48, 64, -(1 << 20)
END = np.uint64(0x9E3779B97F4A7C15)
BLOCK_DDL = "block long, lengths binary, roles binary, tokens binary, vocab binary, n_tokens long"
ASK_DDL = "n int, range int, block long, keys binary, train binary, held binary"
ANSWER_DDL = "n int, range int, block long, train binary, held binary, shared binary, known long, total long, bins array<struct<bin: int, weight: double>>"
REPLY = ["block", "n", "range", "train", "held", "shared"]


#: Arrays shorter than this are stored plainly: at many ranges pieces are short.
PLAIN = 64
_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array: a mark, then plain or with its byte planes apart and compressed."""
    raw = np.ascontiguousarray(values)
    if len(raw) < PLAIN:
        return b"\0" + raw.tobytes()
    return b"\1" + _squeeze.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, kind, offset=1)
    raw = np.frombuffer(_expand.decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in order."""
    x = first * np.uint64(0xFF51AFD7ED558CCD) + second
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


class _Numbering(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Block:
    """Documents of a block while it is filled."""

    def __init__(self):
        self.numbers, self.docs, self.roles, self.ids, self.size = _Numbering({None: 0}), [], [], [], 0

    def add(self, doc, role: int, text: bytes | None) -> None:
        words = split_words(text)
        words.append(None)  # the end
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc)
        self.roles.append(role)
        self.size += len(words)

    def record(self, name: int, kind_of_id: pa.DataType) -> pa.RecordBatch:
        row = self.row(name)
        docs = pa.array([row.pop("docs")], pa.list_(kind_of_id))
        return pa.RecordBatch.from_pydict({"docs": docs} | {k: pa.array([v]) for k, v in row.items()})

    def row(self, name: int) -> dict:
        tokens = np.concatenate(self.ids)
        counts = np.bincount(tokens, minlength=len(self.numbers))
        counts[0] = self.size + 1  # the end stays number 0
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        hashes = np.array([END, *(xxhash.xxh3_64_intdigest(w) for w in list(self.numbers)[1:])], np.uint64)
        return {
            "docs": self.docs,
            "block": name,
            "lengths": pack(np.array([len(x) for x in self.ids], np.int32)),
            "roles": pack(np.array(self.roles, np.uint8)),
            "tokens": pack(rank[tokens]),
            "vocab": pack(hashes[order]),
            "n_tokens": self.size,
        }


def _tokenize(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        blocks = [_Block(), _Block()]  # odd blocks: held-out training documents
        kind_of_id = None
        for batch in batches:
            kind_of_id, texts = batch.schema.field(0).type, batch.column(2)
            for i, (doc, role) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                kind = int(role == 2)
                blocks[kind].add(doc, role, texts[i].as_py())
                if blocks[kind].size >= limit:
                    yield blocks[kind].record((part << 24 | seq) << 1 | kind, kind_of_id)
                    blocks[kind], seq = _Block(), seq + 1
        for kind in (0, 1):
            if blocks[kind].docs:
                yield blocks[kind].record((part << 24 | seq) << 1 | kind, kind_of_id)
                seq += 1
        del blocks
        trim()

    return run


class _Tokens:
    """A block, unpacked: tokens, contexts, keys of words and bigrams."""

    def __init__(self, row):
        self.lengths, self.roles = unpack(row.lengths, np.int32), unpack(row.roles, np.uint8)
        self.tokens, self.vocab = unpack(row.tokens, np.uint32).astype(np.int64), unpack(row.vocab, np.uint64)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.context = np.roll(self.tokens, 1)
        self.context[self.starts] = 0  # a text begins after an end
        self.word_order = np.argsort(self.vocab, kind="stable")
        self.bigrams, self.bigram_of = np.unique(pair_keys(self.vocab[self.context], self.vocab[self.tokens]), return_inverse=True)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each token 1 or 0: whether it trains the model, and whether it is held out for the weights."""
        role = np.repeat(self.roles, self.lengths)
        return (role > 0).astype(np.float64), (role == 2).astype(np.float64)


def _pieces(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of the equal hash ranges that sorted keys fall into; empty ones are left out."""
    if not len(keys):
        return []
    of = (keys // np.uint64(-(-(1 << 64) // ranges))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))


def _questions(n: int, ranges: int, block: int, keys: np.ndarray, of_train: np.ndarray, of_held: np.ndarray) -> pd.DataFrame:
    """ASK_DDL rows of a block's sorted keys and their own counts."""
    out = []
    for i, a, z in _pieces(keys, ranges):
        gaps = np.diff(keys[a:z], prepend=np.uint64(0))
        out.append((n, i, block, pack(gaps), pack(of_train[a:z].astype(np.uint32)), pack(of_held[a:z].astype(np.uint32)) if block & 1 else None))
    return pd.DataFrame(out, columns=["n", "range", "block", "keys", "train", "held"])


def _ask(ranges: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b = _Tokens(row)
                weights = b.weights()
                words = (np.bincount(b.tokens, w, len(b.vocab))[b.word_order] for w in weights)
                yield _questions(1, ranges[1], row.block, b.vocab[b.word_order], *words)
                yield _questions(2, ranges[2], row.block, b.bigrams, *(np.bincount(b.bigram_of, w, len(b.bigrams)) for w in weights))
        trim()

    return run


def _ask_trigrams(ranges: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = _Answered(row, right)
            b.find_trigrams()
            out.append(_questions(3, ranges, row.block, b.trigrams[b.open], b.own_train[b.open], b.own_held[b.open]))
            del b
            trim()
        return pd.concat(out)

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a hash range over all blocks, to each block in the order of its keys; totals in a row of block -1."""
    n, at = int(rows["n"].iloc[0]), int(rows["range"].iloc[0])
    parts = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    sizes = [len(p) for p in parts]
    keys, where = np.unique(np.concatenate(parts), return_inverse=True)
    parts.clear()
    shared = np.bincount(where, minlength=len(keys)) > 1
    train = np.bincount(where, np.concatenate([unpack(t, np.uint32) for t in rows["train"]]), len(keys)).astype(np.int64)
    held = np.bincount(where, np.concatenate([unpack(h, np.uint32) if h is not None else np.zeros(s, np.uint32) for h, s in zip(rows["held"], sizes, strict=True)]), len(keys)).astype(np.int64)
    out, end = [], 0
    for block, size in zip(rows["block"].tolist(), sizes, strict=True):
        own = where[end : end + size]
        end += size
        bits = pack(np.packbits(shared[own])) if n == 2 else None
        out.append((n, at, block, pack(train[own].astype(np.uint64)), pack(held[own].astype(np.uint64)) if block & 1 else None, bits, None, None, None))
    if n == 1:
        bins, inverse = np.unique(_bins((train - held).astype(np.float64)), return_inverse=True)
        weights = np.bincount(inverse, held)
        bins = [{"bin": int(b), "weight": float(w)} for b, w in zip(bins, weights, strict=True) if w]
        out.append((n, at, -1, None, None, None, int((train > 0).sum()), int(train.sum()), bins))
    frame = pd.DataFrame(out, columns=["n", "range", "block", "train", "held", "shared", "known", "total", "bins"])
    del parts, keys, where, train, held
    trim()
    return frame.astype({"known": "Int64", "total": "Int64"})


def _bins(ratio: np.ndarray) -> np.ndarray:
    """Logarithmic bin of each ratio; NEVER for 0."""
    return np.where(ratio > 0, np.round(STEPS * np.log2(np.maximum(ratio, 1e-300))), NEVER).astype(np.int64)


def learn_weight(ratios: np.ndarray, weights: np.ndarray, rounds: int = 200) -> float:
    """EM for x in sum(weights * log(x * ratio + 1 - x)): the share of the higher-order estimate."""
    total, x = weights.sum(), 0.5
    for _ in range(rounds if total else 0):
        after = float((weights * x * ratios / (x * ratios + 1 - x)).sum() / total)
        done, x = abs(after - x) < 1e-9, min(after, 1 - 1e-6)
        if done:
            break
    return x


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)


class _Answered(_Tokens):
    """A block with the counts of its words (c1) and bigrams (c2), and with find_trigrams() of its trigrams (c3)."""

    def __init__(self, row, answers: pd.DataFrame):
        super().__init__(row)
        answers = answers.sort_values(["n", "range"])
        self.got = {n: answers[answers["n"] == n] for n in (1, 2, 3)}
        self.c1 = np.empty(len(self.vocab), np.int64)
        self.c1[self.word_order] = self.join(1, "train")
        self.c2 = self.join(2, "train")

    def join(self, n: int, column: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.uint64).astype(np.int64) for x in self.got[n][column])])

    def delete_held(self) -> None:
        held = np.empty(len(self.vocab), np.int64)
        held[self.word_order] = self.join(1, "held")
        self.c1 -= held
        self.c2 -= self.join(2, "held")

    def find_trigrams(self) -> None:
        """Trigrams with their own counts; open ones go on from a bigram that other blocks have, too."""
        sizes = [len(unpack(x, np.uint64)) for x in self.got[2]["train"]]
        bits = [np.unpackbits(unpack(x, np.uint8), count=n) for x, n in zip(self.got[2]["shared"], sizes, strict=True)]
        shared = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        later = np.ones(len(self.tokens), bool)
        later[self.starts] = False  # the first token of a text has no bigram before it
        self.later = np.flatnonzero(later)
        self.before = self.bigram_of[self.later - 1]
        keys = pair_keys(self.bigrams[self.before], self.vocab[self.tokens[self.later]])
        self.trigrams, self.trigram_of = np.unique(keys, return_inverse=True)
        self.open = np.zeros(len(self.trigrams), bool)
        self.open[self.trigram_of] = shared[self.before]
        self.own_train, self.own_held = (np.bincount(self.trigram_of, w[self.later], len(self.trigrams)).astype(np.int64) for w in self.weights())

    def count_trigrams(self, delete_held: bool) -> None:
        self.find_trigrams()
        self.c3 = self.own_train.copy()
        self.c3[self.open] = self.join(3, "train")
        if delete_held:
            held = self.own_held
            held[self.open] = self.join(3, "held")
            self.c3 -= held

    def low(self, total: float, vocabulary: int, share: float) -> np.ndarray:
        """Interpolated unigram estimate of each token."""
        return share * (self.c1[self.tokens] / total if total else 0.0) + (1 - share) / (vocabulary + 1)

    def second(self) -> tuple[np.ndarray, np.ndarray]:
        """(context count, bigram estimate) of each token."""
        context = self.c1[self.context]
        return context, np.where(context > 0, self.c2[self.bigram_of] / np.maximum(context, 1), 0.0)

    def third(self) -> tuple[np.ndarray, np.ndarray]:
        """(context count, trigram estimate) of each token; 0 where a text begins."""
        context, high = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens))
        context[self.later] = self.c2[self.before]
        high[self.later] = np.where(context[self.later] > 0, self.c3[self.trigram_of] / np.maximum(context[self.later], 1), 0.0)
        return context, high


def mixed(shares: np.ndarray, context: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    x = shares[bucket(context)]
    return x * high + (1 - x) * low


def _ratio_histogram(total: float, vocabulary: int, share: float, second: np.ndarray | None = None):
    """Ratios of bigram to unigram estimates or, given the weights of bigrams, of trigram to bigram mixture."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = _Answered(row, right)
            b.delete_held()
            context, high = b.second()
            low = b.low(total, vocabulary, share)
            if second is not None:
                low = mixed(second, context, high, low)
                b.count_trigrams(True)
                context, high = b.third()
            pairs, n = np.unique(np.stack((bucket(context), _bins(high / low))), axis=1, return_counts=True)
            out.append(pd.DataFrame({"bucket": pairs[0], "bin": pairs[1], "weight": n.astype(float)}))
            del b, context, high, low
            trim()
        return pd.concat(out) if out else pd.DataFrame({"bucket": [], "bin": [], "weight": []})

    return run


def _score(total: int, vocabulary: int, share: float, second: np.ndarray, third: np.ndarray):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = _Answered(row, right)
            chance = mixed(second, *b.second(), b.low(total, vocabulary, share))
            b.count_trigrams(False)
            chance = mixed(third, *b.third(), chance)
            add = np.add.reduceat
            base = np.log10((b.c1 + 0.5) / (total + 0.5 * (vocabulary + 1)))
            out.append(
                pd.DataFrame(
                    {
                        "doc": list(row.docs),
                        "held_out": b.roles == 0,
                        "n_tokens": b.lengths.astype(np.int64),
                        "n_known": add((b.c1[b.tokens] > 0).astype(np.int64), b.starts),
                        "base_score": add(base[b.tokens], b.starts),
                        "score": add(np.log10(chance), b.starts),
                    }
                )
            )
            del b, chance
            trim()
        return pd.concat(out)

    return run


def lm_scores(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int | None = None, range_keys: int | None = None) -> DataFrame:
    """Scores of every whole text under a model of the documents where held_out is false.

    block_tokens and range_keys follow from the estimated size of docs where
    they are None.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Null texts are empty and have the end token only; repeated rows
    count and are scored each time; a null held_out counts as false. Without
    training documents every text scores 0; an empty table gives no rows.
    Whole texts count, however long; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    root = math.isqrt(PIECE_KEYS * estimated_bytes(docs) // TOKEN_BYTES)
    block_tokens, range_keys = (x or min(MOST_BLOCK, max(LEAST_BLOCK, root)) for x in (block_tokens, range_keys))
    fold = F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT_ONE_IN)) == 0
    role = F.when(F.coalesce(held_out, F.lit(False)), 0).when(fold, 2).otherwise(1).cast("int")
    given = docs.select(F.col(id_col).alias("doc"), role.alias("role"), F.col(text_col).cast("binary").alias("text"))
    blocks = materialize(given.mapInArrow(_tokenize(block_tokens), f"docs array<{kind}>, {BLOCK_DDL}"), "blocks")
    n_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = {1: max(8, n_tokens // (8 * range_keys)), 2: max(32, n_tokens // range_keys)}
    asked = blocks.select("block", "lengths", "roles", "tokens", "vocab").mapInPandas(_ask(ranges), ASK_DDL)
    answers = materialize(asked.groupBy("n", "range").applyInPandas(_answer, ANSWER_DDL), "answers")
    facts = answers.filter("block = -1")
    sums = facts.agg(F.sum("known").alias("known"), F.sum("total").alias("total")).first()
    vocabulary, total = sums.known or 0, sums.total or 0
    words = [(r.bin, r.weight) for r in facts.select(F.explode("bins").alias("b")).groupBy("b.bin").agg(F.sum("b.weight").alias("weight")).collect()]
    held = sum(w for _, w in words)
    share = 0.0
    if words and total > held:
        bins, weights = np.array(words).T
        share = learn_weight(_ratios(bins) * (vocabulary + 1) / (total - held), weights)
    replies = answers.filter("block >= 0").select(REPLY)

    def meet(replies: DataFrame, odd: bool, run, ddl: str) -> DataFrame:
        kept = "block % 2 = 1" if odd else "true"
        return blocks.filter(kept).groupBy("block").cogroup(replies.filter(kept).groupBy("block")).applyInPandas(run, ddl)

    def learn(replies: DataFrame, *second: np.ndarray) -> np.ndarray:
        found = meet(replies, True, _ratio_histogram(total - held, vocabulary, share, *second), "bucket int, bin int, weight double")
        return bucket_shares([(r.bucket, r.bin, r.weight) for r in found.groupBy("bucket", "bin").agg(F.sum("weight").alias("weight")).collect()])

    second = learn(replies)
    asked = meet(replies, False, _ask_trigrams(ranges[2]), ASK_DDL)
    trigrams = materialize(asked.groupBy("n", "range").applyInPandas(_answer, ANSWER_DDL), "answers")
    replies = replies.union(trigrams.select(REPLY))
    third = learn(replies, second)
    scored = meet(replies, False, _score(total, vocabulary, share, second, third), f"doc {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _ratios(bins: np.ndarray) -> np.ndarray:
    return np.where(bins == NEVER, 0.0, np.exp2(np.maximum(bins, -60_000) / STEPS))


def bucket_shares(rows: list[tuple[int, int, float]]) -> np.ndarray:
    """Weight of the higher estimate in each bucket; a bucket without events takes that below it."""
    shares = np.zeros(BUCKETS)
    table = np.array(rows, float).reshape(-1, 3)
    for b in range(1, BUCKETS):
        own = table[table[:, 0] == b]
        shares[b] = learn_weight(_ratios(own[:, 1]), own[:, 2]) if len(own) else shares[b - 1]
    return shares


def lm_digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query; a null id is read as an empty text."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return lm_scores(docs, remainder == 1)

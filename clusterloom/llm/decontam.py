"""Benchmark decontamination with one Aho-Corasick automaton.

Texts become strings of word codes: a word of the benchmark is a few
characters, its digits in base 64, each digit place with an alphabet of its
own; every other word is as many NULs. A window of words is then a short key,
a match can only begin at a word, its position is a word index, and a text is
scanned once. The alphabets keep the automaton's nodes narrow, however many
words the benchmark has.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .words import alnum_words, trim

#: UTF-8 bytes of benchmark text that one automaton holds (up to 0.4 GB of nodes). A larger benchmark is
#: scanned in passes, one automaton each.
MAX_BYTES = 2 << 20
#: Windows of an item that stay together.
PIECE_WINDOWS = 50_000
BASE = 64
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The automaton of this worker, by the digest of its items.
_built: dict[str, tuple] = {}


def windows(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """All runs of width words; the whole sequence where it is shorter; none for no words."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


class _Codes(dict):
    """Codes of words; a word outside the benchmark is NULs."""

    def __init__(self, words: list[bytes]):
        self.digits = 1
        while BASE**self.digits < len(words):
            self.digits += 1
        super().__init__((w, self._code(n)) for n, w in enumerate(words))
        self.other = "\0" * self.digits

    def _code(self, n: int) -> str:
        return "".join(chr(1 + BASE * place + n // BASE**place % BASE) for place in range(self.digits))

    def __missing__(self, _):
        return self.other


def build(items: list[tuple[str | None, bytes]], width: int) -> tuple[_Codes, ahocorasick.Automaton, list[tuple[int, list[str]]]]:
    """Word codes, the automaton, and (words, items) of each window. An item without id is in no list."""
    of: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        for window in windows(alnum_words(text), width):
            of[window].update([] if item is None else [item])
    codes = _Codes(list(dict.fromkeys(w for window in of for w in window)))
    automaton, found = ahocorasick.Automaton(), []
    for window, owners in of.items():
        automaton.add_word("".join([codes[w] for w in window]), len(found))
        found.append((len(window), sorted(owners)))
    if found:
        automaton.make_automaton()
    return codes, automaton, found


def scan(words: list[bytes], built: tuple) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans [start, end) that windows cover, and the items of those windows."""
    codes, automaton, found = built
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if not found or not words:
        return spans, items
    get = codes.__getitem__
    seen = set()
    for last, k in automaton.iter("".join([get(w) for w in words])):
        seen.add(k)
        end = last // codes.digits + 1
        start = end - found[k][0]
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))
    for k in seen:
        items.update(found[k][1])
    return spans, items


def _cover(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as code-point spans of the original text."""
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]


SCANNED = "n_words long, n_hit long, items array<string>, spans array<struct<start int, end int>>, words array<struct<start int, end int>>"


def _row(text: bytes | None, n_words: int, spans: list, items) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    return n_words, n_hit, sorted(items), _offsets(text, spans) if spans else [], [{"start": a, "end": b} for a, b in spans]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "words"])


def _automaton(digest: str, items, width: int) -> tuple:
    if digest not in _built:
        _built.clear()
        _built[digest] = build(items.value, width)
    return _built[digest]


def _scanner(digest: str, items, width: int):
    @F.pandas_udf(SCANNED)
    def run(texts: pd.Series) -> pd.DataFrame:
        built, rows = _automaton(digest, items, width), []
        for text in texts:
            words = alnum_words(text)
            rows.append(_row(text, len(words), *scan(words, built)))
        trim()
        return _frame(rows)

    return run


def _rescanner(digest: str, items, width: int):
    @F.pandas_udf(SCANNED)
    def run(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        built, rows = _automaton(digest, items, width), []
        for text, known, own in zip(texts, before["words"], before["items"], strict=True):
            words = alnum_words(text)
            spans, found = scan(words, built)
            rows.append(_row(text, len(words), _cover([(int(s["start"]), int(s["end"])) for s in known], spans), {*own, *found}))
        return _frame(rows)

    return run


def _pieces(width: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(i, piece, t): items as words, cut so that each window lies in one piece."""
        for batch in batches:
            for item, text in zip(batch["i"], batch["t"], strict=True):
                words = alnum_words(text)
                starts = range(0, max(1, len(words) - width + 1), size)
                yield pd.DataFrame([(item, n, b" ".join(words[s : s + size + width - 1])) for n, s in enumerate(starts)], columns=["i", "piece", "t"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """(row, found) of each row of docs: its columns, and a struct (n_words, n_hit, items array<string>, spans
    array<struct<start, end>>, words).

    items are sorted ids of the benchmark rows with an occurring window; spans
    are code points of the original text. Null and empty texts have no words; a
    benchmark without words, an empty one too, hits nothing; benchmark rows
    without id hit words and are in no list; rows with one id count once;
    repeated rows of docs give a row each. Texts are scanned whole, however
    long. The benchmark's size is taken first: up to max_bytes there is one
    automaton, beyond that one for each pass over docs, whose results are
    written between the passes.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("binary").alias("t")).filter("t is not null")
    pieces = rows.mapInPandas(_pieces(width, piece_windows), "i string, piece long, t binary")
    total = pieces.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    state = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row").getField(text_col).cast("binary")
    for part in range(parts):
        own = pieces.filter(F.pmod(F.xxhash64("i", "piece"), F.lit(parts)) == part)
        listed = sorted(((r.i, bytes(r.t)) for r in own.collect()), key=lambda x: (x[0] is not None, x))
        digest = hashlib.sha256(repr((width, listed)).encode()).hexdigest()
        items = spark.sparkContext.broadcast(listed)
        if not part:
            state = state.withColumn("found", _scanner(digest, items, width)(text))
        else:
            before, state = state, materialize(state.withColumn("found", _rescanner(digest, items, width)(text, F.col("found"))), "scanned")
            discard(before)
            items.unpersist()
        if not part and parts > 1:
            state = materialize(state, "scanned")
            items.unpersist()
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, max_hit: int = 0) -> DataFrame:
    """Rows of docs, columns as they are, with max_hit or fewer words in benchmark windows.

    Null and empty texts stay, repeated rows too; an empty benchmark keeps all
    rows, an empty docs gives none. Extra columns may have any names.
    """
    return contaminated(docs, benchmark, text_col, width).filter(F.col("found.n_hit") <= max_hit).select("row.*")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of the registered query; items_sha256 of no item is that of the empty string."""
    found = contaminated(docs.select("doc_id", "text"), benchmark).select("row.doc_id", "found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )

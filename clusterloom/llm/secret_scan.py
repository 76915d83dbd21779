"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression implies a Boolean query over trigrams. The
index holds, for the trigrams that any rule needs, postings lists of documents
by bucket of document keys; AND intersects and OR unites the lists. Only the
documents left are scanned with the rule. Rules without mandatory trigrams
scan every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .trigram_query import ALL, grams, trigram_query

#: Documents whose postings lists share a bucket, on average.
BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """kind, a regular expression that means the same in Java and Python, and the least length of a group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What the operator finds besides.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _scan_pattern(rule: Rule) -> str:
    """A simple repeated class needs its least length at once: its matches are maximal runs."""
    simple = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if simple else rule.pattern


def spans(text: F.Column, rule: Rule) -> F.Column:
    """Code-point spans of the leftmost non-overlapping matches whose group is long enough.

    The gaps between matches (split) and the matches (extract) alternate, so
    running sums of their lengths are the offsets.
    """
    pattern = F.lit(_scan_pattern(rule))
    gaps = F.transform(F.split(text, _scan_pattern(rule), -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("long"), F.transform(checked, F.length).alias("of_group"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        a = acc["at"] + x["gap"]
        z = a + x["long"]
        added = F.when(x["of_group"] >= rule.least, F.concat(acc["out"], F.array(F.struct(a.alias("start"), z.alias("end"))))).otherwise(acc["out"])
        return F.struct(z.alias("at"), added.alias("out"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def build_index(texts: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """(bucket, postings map<gram, array<key>>) over the given grams of lower-cased texts.

    texts has key (long) and text. Keys without any of the grams have no entry.
    """
    lower = texts.select("key", F.lower("text").alias("lower"))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("lower"), t))
    postings = lower.select("key", F.pmod("key", F.lit(buckets)).alias("bucket"), F.explode(found).alias("gram"))
    lists = postings.groupBy("bucket", "gram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("postings"))


def matching(query: tuple, postings: F.Column) -> F.Column:
    """Keys of a bucket that satisfy a query other than ALL."""
    if query[0] == "gram":
        return F.coalesce(F.element_at(postings, query[1]), F.array().cast("array<bigint>"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(join, (matching(q, postings) for q in query[1:]))


def _tagged(keys: F.Column, kind: str) -> F.Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, kinds): rules to verify on each document that satisfies one; None if no rule has grams."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    terms = sorted(set().union(*map(grams, queries.values())))
    if not terms:
        return None
    rows = texts.count()
    index = build_index(texts, terms, max(8, -(-rows // BUCKET_ROWS)))
    hits = F.flatten(F.array(*(_tagged(matching(q, F.col("postings")), kind) for kind, q in queries.items())))
    return index.select(F.explode(hits).alias("hit")).groupBy("hit.key").agg(F.collect_set("hit.kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, found): spans array<struct<start, end>> of each rule by kind, in a map.

    Spans are code points, end exclusive. Null and empty texts have none. Each
    input row gives one row, repeated rows and null ids too; an empty table
    gives none. Whole texts are scanned, however long; columns beside id and
    text are not read, whatever their names.
    """
    texts = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    full = [r for r in rules if trigram_query(r.pattern) == ALL]
    chosen = [r for r in rules if r not in full]
    wanted = candidates(texts.select("key", "text"), rules)
    none = F.array().cast("array<struct<start:int,end:int>>")
    if wanted is None:
        return texts.select(F.col("id").alias(id_col), F.create_map(*(x for r in rules for x in (F.lit(r.kind), spans(F.col("text"), r)))).alias("found"))
    listed = materialize(wanted, "candidates")
    # Texts travel only where the index has a candidate; the other rows go without.
    verified = texts.join(listed, "key").select(
        "key", "id", F.xxhash64("text").alias("hash"), *(F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).otherwise(none).alias(f"s_{r.kind}") for r in chosen)
    )
    kept = texts.select("key", "id", F.xxhash64("text").alias("hash"), *(spans(F.col("text"), r).alias(f"s_{r.kind}") for r in full))
    one = verified.groupBy("key", "hash").agg(*(F.first(f"s_{r.kind}").alias(f"s_{r.kind}") for r in chosen))
    joined = kept.join(one, ["key", "hash"], "left")
    return joined.select(F.col("id").alias(id_col), F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.coalesce(f"s_{r.kind}", none)))).alias("found"))


def _listed(rules: tuple[Rule, ...]) -> F.Column:
    """kind:start:end of all spans by start, then kind in the order of the rules."""
    def ordered(i: int) -> F.Column:
        return F.transform(F.element_at("found", rules[i].kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), s["end"].alias("end")))

    rows = F.flatten(F.array(*map(ordered, range(len(rules)))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", kinds[s["at"]], s["start"], s["end"])))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.element_at("found", kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(BASE_RULES).cast("binary"), 256).alias("base_sha256"), _listed(BASE_RULES + MORE_RULES).alias("spans"))

"""Quality rules as a ledger of failure bits, in DataFrame functions only.

1. `ledger`: one pass evaluates every rule once and keeps the measurements and one bit per failed rule.
2. `apply_policy`: a policy version is a mask of enforced rules; a document stays if it fails none of them. Another
   version needs the ledger, not the texts.
3. `ablations`: documents are counted by their failure bits (at most 2**len(RULES) rows), from which every policy and
   rule gets how many documents fail it, how many only it, and how many stay without it; bitwise aggregates tell
   which rules ever act.

Each text is worked on by itself, in its row: no shuffle, and a hot source or a group of copies is no hot key. Repeated
8-word windows are found by sorting 64-bit hashes of four words of each window of a text; windows that share a hash are
then sorted and compared word by word.

Words are `[^\\x20\\x09-\\x0D]+`, of the text as it is; a null text has none. Empty texts and texts without words have
zero measurements and fail few_words. Very long texts are measured whole. Repeated rows, repeated or null ids are rows
of their own; ties don't occur; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelia.llm import common as C

SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: (name, condition that fails a document), over the measurements; the place in the list is the bit, so rules are only ever added at the end.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words AND n_wide = 0"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("bullets", "10 * n_bullets > 9 * n_lines"),
    ("ellipses", "10 * n_ellipses > 3 * n_lines"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versions stay as they are once used; a change is a new version.
POLICIES = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["repeated_lines"],
    3: BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["few_letters"] | BIT["bullets"] | BIT["ellipses"],
}
LATEST = max(POLICIES)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_wide", "n_letters", "n_bullets", "n_ellipses"]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once in a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, hashed=F.xxhash64) -> Column:
    """Words in windows that occur twice or more among the windows of `words`."""
    tail = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    paired = lambda a, k: let(a, lambda x: F.slice(F.zip_with(x, tail(x, k), lambda a, b: hashed(a, b)), 1, F.size(x) - k))
    hashes = paired(paired(words, 3), 4)  # of four of the eight words, which is enough to tell most windows apart

    def twice(items: Column, key: str) -> Column:
        """Of structs (key, at) sorted by key, the `at` of those that share their key with a neighbour, ascending."""
        differs = lambda s, k, j: F.coalesce(F.get(s, k)[key] != F.get(s, j)[key], F.lit(True))
        alike = lambda s: F.filter(s, lambda x, k: ~(differs(s, k, k - 1) & differs(s, k, k + 1)))
        return F.array_sort(F.transform(let(F.sort_array(items), alike), lambda x: x["at"]))

    by_hash = lambda h: twice(F.transform(h, lambda x, k: F.struct(x.alias("hash"), k.alias("at"))), "hash")
    by_words = lambda at: twice(F.transform(at, lambda k: F.struct(F.slice(words, k + 1, WINDOW).alias("window"), k.alias("at"))), "window")
    gaps = lambda at: F.zip_with(at, tail(at, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = lambda at: F.aggregate(gaps(at), F.lit(0), lambda s, x: s + x)
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(by_words(by_hash(h)), covered)).otherwise(0)
    return F.when(F.size(words) > WINDOW, let(hashes, some)).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    starts = lambda x: F.left(F.ltrim(x, F.lit(SPACES)), F.lit(1))
    ends = lambda x: F.rtrim(x, F.lit(SPACES))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda s, x: s + F.char_length(x)).alias("chars"), repeated_words(w).alias("again")))
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("again"),
            F.size(F.filter(x, lambda y: starts(y).isin("-", "*", "•"))).alias("bullets"),
            F.size(F.filter(x, lambda y: ends(y).endswith("...") | ends(y).endswith("…"))).alias("ellipses"),
        ),
    )
    wide = F.octet_length(text) - F.char_length(text)
    symbols, others = (F.regexp_count(text, F.lit(x)) for x in (f"[{SYMBOLS}]", "[^\\p{L}\\p{M}\\x20\\x09-\\x0D]"))
    rows = rows.select("doc_id", of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"), wide.alias("n_wide"), others.alias("n_others"))
    rows = rows.select("*", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), (F.col("w.chars") - F.col("n_others")).alias("n_letters"), F.col("w.again").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), F.col("l.again").alias("n_dup_lines"), F.col("l.bullets").alias("n_bullets"), F.col("l.ellipses").alias("n_ellipses"))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in MEASURES])


def failures(rules=None) -> Column:
    """The failure bits of a row of measurements."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(rules or RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that a document fails; written to the shared folder."""
    return C.saved(measured(docs).withColumn("failed", failures()), "ledger")


def apply_policy(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version; a base failure is never overruled."""
    fails = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.select("*", fails(BASE).alias("base_failed"), (~fails(BASE | POLICIES[version])).alias("kept"), F.lit(version).alias("policy"))


def ablations(rows: DataFrame, versions=None) -> DataFrame:
    """Per policy version and rule of it: n_docs, n_failed (fail the rule), n_only (fail no other rule of the policy),
    n_kept, n_kept_without (would stay without the rule), and of the whole ledger seen (bits that any document fails)
    and always (bits that all fail)."""
    by_bits = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(POLICIES[v] | BASE).alias("mask"), F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for v in versions or POLICIES for name, bit in BIT.items() if bit & (POLICIES[v] | BASE)])
    each = by_bits.select("failed", "n", F.explode(cases).alias("c")).select("failed", "n", "c.*")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(hit == F.col("bit"))("n_only"),
        total(hit == 0)("n_kept"),
        total((hit == 0) | (hit == F.col("bit")))("n_kept_without"),
        F.bit_or("failed").alias("seen"),
        F.bit_and("failed").alias("always"),
    )


def judged(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """doc_id, the measurements, failed, base_failed, kept and policy of every document."""
    return apply_policy(ledger(docs), version)

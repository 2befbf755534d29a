"""Quality rules kept as a ledger of bit masks.

Every rule is evaluated once for every text. The ledger keeps what was measured and one bit for each rule
that fails. A policy is a versioned mask: a text passes when none of the mask's bits is set. So a new policy,
or the question what a policy would do without one of its rules, needs the ledger only:
``ablations`` counts rows by their masked bits (at most 2 ** rules groups) and works on these counts.

Measures come from whole texts. Words are ``[^\\x20\\x09-\\x0D]+``. Words in repeated 8-word windows: every window
has a 64-bit hash; only texts in which some hash occurs twice sort them, and the places of those windows
are laid over each other.

Rows: a null text counts as empty. Empty texts have no words, so they fail. Repeated rows are measured each for
themselves. ``keep_good`` returns the rows as they came, whatever their columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import SPACE_CHARS, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails where the SQL condition on the measures is true; both engines read it alike."""

    name: str
    fails: str


# A rule's place is its bit: add new ones at the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 6 * word_chars"),
    Rule("repeated_lines", "n_lines >= 5 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
POLICIES = {"1": BASE, "2": BASE | BITS["symbols"], "3": (1 << len(RULES)) - 1}
CURRENT = "3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(documents: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``documents`` with ``<prefix>ledger``: the measures and ``bits``, as a struct.

    Each step refers to the array before it more than once, which keeps the optimiser from
    writing that array into a lambda, where it would be made again for each element."""
    work = unused(documents, prefix + "work")
    name = unused(documents, prefix + "ledger")
    value = F.coalesce(F.col(text), F.lit(""))
    df = documents.withColumn(work, F.struct(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w")))
    hashed = f"{work}.w"
    windows = F.expr(
        f"IF(size({hashed}) < {WINDOW}, CAST(array() AS array<bigint>),"
        f" transform(sequence(1, size({hashed}) - {WINDOW - 1}), i -> xxhash64(slice({hashed}, i, {WINDOW}))))"
    )
    df = df.withColumn(work, F.struct(F.size(hashed).alias("n"), windows.alias("h")))
    h = f"{work}.h"
    in_order = F.expr(
        f"IF(size(array_distinct({h})) = size({h}), NULL, sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i))))"
    )
    df = df.withColumn(work, F.struct(F.col(f"{work}.n").alias("n"), in_order.alias("s")))
    s = f"{work}.s"
    places = F.expr(
        f"array_sort(transform(filter({s}, (e, k) -> e.h <=> get({s}, k - 1).h OR e.h <=> get({s}, k + 1).h), e -> e.i))"
    )
    without = lambda chars: F.char_length(F.translate(value, chars, ""))
    with_lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(
        work,
        F.struct(
            F.col(f"{work}.n").cast("bigint").alias("n_words"),
            without(SPACE_CHARS).cast("bigint").alias("word_chars"),
            (F.char_length(value) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
            with_lines.alias("lines"),
            places.alias("places"),
        ),
    )
    own = lambda c: F.col(f"{work}.{c}")
    covered = F.expr(
        f"aggregate({work}.places, struct(-{WINDOW} AS last, 0L AS n),"
        f" (done, at) -> struct(at AS last, done.n + least(at - done.last, {WINDOW}) AS n), done -> done.n)"
    )
    df = df.withColumn(
        work,
        F.struct(
            own("n_words").alias("n_words"),
            own("word_chars").alias("word_chars"),
            own("n_symbols").alias("n_symbols"),
            F.size(own("lines")).cast("bigint").alias("n_lines"),
            (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("bigint").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        ),
    )
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        condition = rule.fails
        for measure in MEASURES:
            condition = _named(condition, measure, f"{work}.{measure}")
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[rule.name])).otherwise(F.lit(0)).cast("bigint"))
    made = F.struct(*(own(m).alias(m) for m in MEASURES), bits.alias("bits"))
    # A generator of one row: filters on the ledger stay above it and do not repeat its expressions.
    return df.select(*documents.columns, F.explode(F.array(made)).alias(name))


def _named(condition: str, measure: str, column: str) -> str:
    return " ".join(column if part == measure else part for part in condition.split())


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[version])) == 0


def judge(documents: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger of every row and the verdict of a policy."""
    rows = ledger(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "ledger.*")
    return rows.select(
        "doc_id",
        *MEASURES,
        (F.col("bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        passes(F.col("bits"), version).alias("kept"),
        F.col("bits").alias("failed_bits"),
    )


def keep_good(documents: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows that pass, all columns as they are."""
    held = ledger(documents)
    (name,) = set(held.columns) - set(documents.columns)
    return held.where(passes(F.col(f"{name}.bits"), version)).select(*documents.columns)


def ablations(judged: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else (they would pass without it),
    and rows that would pass if it were the only rule."""
    mask = POLICIES[version]
    masked = judged.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BITS[r.name]).cast("bigint").alias("bit")) for r in RULES if BITS[r.name] & mask))
    )
    return (
        masked.select("bits", "n", rules.alias("r"))
        .select("bits", "n", "r.*")
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_reason"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_alone"),
        )
    )


_SPLIT = r"regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')"
ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, list_filter({_SPLIT}, lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT row, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
    FROM d, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS t(i)
), found AS (
    SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), covered AS (
    SELECT row, sum(least({WINDOW}, i - before)) AS n
    FROM (SELECT row, i, lag(i, 1, -{WINDOW}) OVER (PARTITION BY row ORDER BY i) AS before FROM found) GROUP BY row
), m AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN covered USING (row)
), b AS (
    SELECT *, {" + ".join(f"CASE WHEN {rule.fails} THEN {BITS[rule.name]} ELSE 0 END" for rule in RULES)} AS bits FROM m
)
SELECT doc_id, {", ".join(f"{m}::BIGINT AS {m}" for m in MEASURES)}, bits & {BASE} <> 0 AS base_failed,
    bits & {POLICIES[CURRENT]} = 0 AS kept, bits::BIGINT AS failed_bits
FROM b
"""

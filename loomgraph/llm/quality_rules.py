"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition over statistics of a document's whole text. The rules run as one
``CASE`` chain: the first that rejects ends the evaluation of the row. Their order comes from
a sample: next is always the rule that rejects the most of the rows that reach it for each
second of its cost. The order changes the cost of the cascade, never its verdict.

``apply_quality_rules`` keeps each statistic inside the rules that need it, so a row that a
cheap rule rejects costs no more. ``judge_quality`` returns all statistics, so there only the
rules beyond them are saved.

Defined cases: a null or blank text has no words and fails the base test; an empty
table gives an empty result; repeated rows are judged one by one; of rules that reject
equally for their cost the one named first comes first; columns of the input that have the
name of a computed column are replaced by it in ``quality_features`` and left alone by
``apply_quality_rules``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, trimmed_words

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over the statistics and ``_text``."""

    name: str
    rejects: str


#: Production rules. Integer arithmetic, so any SQL engine agrees on them.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", r"5 * length(regexp_replace(_text, '[^A-Z]+', '')) > 2 * word_chars"),
    Rule("digits", r"5 * length(regexp_replace(_text, '[^0-9]+', '')) > 2 * word_chars"),
)
#: The base test, which comes with fixed limits.
BASE = (Rule("too_short", "n_words < 50"), Rule("repetition", "100 * n_repeat_words > 50 * n_words"))
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

_LINES = r"filter(split(_text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
#: Windows of three words that occur again, by place: sorted (hash, place) pairs, of which equal
#: hashes are neighbours. Each covers three words, less what the one before covers.
_REPEATED = """aggregate(transform(array(sort_array(transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS i)))),
  s -> array_sort(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i)))[0],
  named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"""
#: Statistics as SQL over the words ``_w`` and ``_text``.
STATISTICS = {
    "n_words": "CAST(size(_w) AS bigint)",
    "word_chars": "CAST(length(array_join(_w, '')) AS bigint)",
    "n_symbols": f"CAST(length(_text) - length(regexp_replace(_text, '{SYMBOLS}+', '')) AS bigint)",
    "n_lines": f"CAST(size({_LINES}) AS bigint)",
    "n_dup_lines": f"transform(array({_LINES}), l -> CAST(size(l) - size(array_distinct(l)) AS bigint))[0]",
    "n_repeat_words": f"IF(size(_w) < 3, 0L, {_REPEATED})",
}


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``n_lines`` and ``_text`` (the text, null as empty)."""
    computed = {*FEATURES, "n_lines", "_text", "_w", "_s", "_p"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in computed]
    d = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    d = d.withColumn("_w", trimmed_words(F.col("_text")))
    # Three-word windows as (hash, position), sorted so that equal ones are neighbours.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= 3, F.sort_array(windows)).alias("_s"),
    )
    same = lambda x, k: x["h"].eqNullSafe(F.get("_s", k)["h"])
    repeated = F.filter("_s", lambda x, k: ((k > 0) & same(x, k - 1)) | same(x, k + 1))
    d = d.select(
        "*",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("_p"),
    )
    # The windows at sorted positions p cover 3 words, less what the one before covers.
    step = F.transform("_p", lambda x, k: F.when(k > 0, F.least(F.lit(3), x - F.get("_p", k - 1))).otherwise(3))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_s", "_p", "_lines")


def self_contained(rule: Rule) -> Column:
    """The rule's condition over ``_text`` and ``_w``, with each statistic computed once in it."""
    needs = [n for n in STATISTICS if re.search(rf"\b{n}\b", rule.rejects)]
    condition = re.sub(rf"\b({'|'.join(needs)})\b", r"s.\1", rule.rejects) if needs else rule.rejects
    fields = ", ".join(f"'{n}', {STATISTICS[n]}" for n in needs)
    return F.coalesce(F.expr(f"exists(array(named_struct({fields})), s -> {condition})" if needs else condition), F.lit(False))


def _words_and_text(docs: DataFrame, text: str) -> list[Column]:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [t.alias("_text"), trimmed_words(t).alias("_w")]


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 500, text: str = "text", base: Sequence[Rule] = ()) -> list[Rule]:
    """The rules in the order of the cascade, measured on about ``sample_rows`` documents, of
    those that no rule of ``base`` rejects. The cost of a rule is the time of a job over the
    sample less that of a job without a rule; of its selectivity, counts of the combinations of
    verdicts reach the driver."""
    n = docs.count()
    if n == 0 or len(rules) < 2:
        return list(rules)
    sample = docs.sample(min(1.0, sample_rows / n), seed=7).select(*_words_and_text(docs, text)).persist()
    try:
        verdicts = [self_contained(r) for r in rules]
        failed = ~cascade([self_contained(r) for r in base])
        found = sample.groupBy(failed.alias("base"), *[v.alias(f"r{k}") for k, v in enumerate(verdicts)]).count().collect()
        found = [row for row in found if not row["base"]]

        def seconds(verdict: Column) -> float:
            began = time.perf_counter()
            sample.agg(F.count_if(verdict)).first()
            return time.perf_counter() - began

        idle = min(seconds(F.length("_text") < 0) for _ in range(2))
        cost = [max(min(seconds(v) for _ in range(2)) - idle, 1e-4) for v in verdicts]
    finally:
        sample.unpersist()
    left, order = list(range(len(rules))), []
    while left:
        gain = {k: sum(row["count"] for row in found if row[f"r{k}"]) / cost[k] for k in left}
        best = max(left, key=lambda k: (gain[k], -k))
        order.append(best)
        left.remove(best)
        found = [row for row in found if not row[f"r{best}"]]
    return [rules[k] for k in order]


def cascade(conditions: Sequence[Column]) -> Column:
    """True where no condition holds; those after the first that holds aren't evaluated."""
    verdict = None
    for c in conditions:
        verdict = F.when(c, False) if verdict is None else verdict.when(c, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 500) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    ordered = order_rules(docs, rules, sample_rows, base=BASE)
    judged = quality_features(docs.select("doc_id", "text"))
    conditions = [F.expr(BASE_FAILED), *[F.coalesce(F.expr(r.rejects), F.lit(False)) for r in ordered]]
    return judged.select("doc_id", *FEATURES, F.expr(BASE_FAILED).alias("base_failed"), cascade(conditions).alias("kept"))


def apply_quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 500) -> DataFrame:
    """The documents that pass, with the columns they came with. The base test takes its place
    among the rules."""
    ordered = order_rules(docs, [*BASE, *rules], sample_rows)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_words_and_text(docs, "text"))
    # A filter would be pushed below the words and split them again for each rule; the row
    # number, which isn't deterministic, keeps it above them.
    judged = whole.select("_doc", cascade([self_contained(r) for r in ordered]).alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    judged = judged.where("_kept AND _row >= 0")
    return judged.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


#: The statistics in DuckDB's SQL; {docs} stands for a relation with doc_id and text.
FEATURES_SQL = r"""
qw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
qg AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM qw WHERE len(w) >= 3)),
qd AS (SELECT rid, i FROM qg QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
qr AS (SELECT rid, count(DISTINCT i + k) AS n FROM qd, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
qf AS (SELECT qw.rid, doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM qw LEFT JOIN qr ON qw.rid = qr.rid),
qj AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM qf),
qk AS (SELECT *, NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 12 * n_words)
  AND NOT (2 * n_dup_lines > n_lines) AND NOT (5 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * word_chars)
  AND NOT (5 * length(regexp_replace(t, '[^0-9]+', '', 'g')) > 2 * word_chars) AS kept FROM qj)
"""
SQL = "WITH " + FEATURES_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM qk"""

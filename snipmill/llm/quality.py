"""Quality rules with risk-controlled thresholds. DataFrame functions only.

A rule rejects a text whose measure lies above a cutoff. For every stratum and rule,
labelled documents tell how many good ones a cutoff would reject. A cutoff is allowed if
an exact binomial tail shows that its rate of false rejections is at most ``RISK`` shared
among the rules, at the level ``ERROR`` shared among all strata and rules. Stricter cutoffs reject
more, so the tests of one rule run from lenient to strict and end at the first failure, which
needs no further correction. Of the allowed cutoffs the one counts that rejects most bad
documents beyond good ones. Too few labels allow none, and then nothing is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipmill.llm.common import WORDS, staged, table

#: Good documents that all rules together may reject, and the chance that a promise fails.
RISK = 0.03
ERROR = 0.1
#: The base rules: fewer words, or more per cent of words in repeated windows, fail.
LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

#: Measures, and their cutoffs from lenient to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    "lines": ("n_dup_lines / greatest(n_words, 1)", (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "length": ("word_chars / greatest(n_words, 1)", (20, 15, 12, 10, 9, 8, 7.5, 7, 6.5)),
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more.

    The windows are sorted, equal neighbours marked, and the marked places merged.
    """
    def windows(w: Column) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = lambda j: (
            F.get(s, j)["g"].eqNullSafe(F.get(s, j - 1)["g"]) | F.get(s, j)["g"].eqNullSafe(F.get(s, j + 1)["g"]))
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), again), lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda a, x: F.struct(
            (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return F.when(F.size(words) < 4, 0).otherwise(_let(windows(words), lambda s: _let(places(s), covered)))


def measures(text: Column) -> Column:
    """The base counts of a text as a struct; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    bare = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    return _let(counted, lambda c: F.struct(
        c["n"].cast("long").alias("n_words"), bare.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        c["r"].cast("long").alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for n draws with chance p, summed exactly in logarithms; for k up to n p."""
    first = n * math.log(1 - p)
    odds = math.log(p / (1 - p))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"]))


def learn(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cutoffs: a struct with a double or null for each rule).

    ``measured``: (key, stratum, the counts); ``labels``: (key, quality), 1 for good. Of a
    document's labels the lowest counts; null labels and keys count for nothing. Documents that fail the base
    rules take no part.
    """
    labels = labels.where("key IS NOT NULL AND quality IS NOT NULL").groupBy("key").agg(F.min("quality").alias("quality"))
    known = measured.where(~base_failed()).join(labels, "key")
    # How many cutoffs of a rule a document exceeds: all further counts are sums over this histogram.
    passed = [F.struct(F.lit(name).alias("rule"),
                       sum((F.expr(value) > c).cast("int") for c in cutoffs).alias("exceeds"))
              for name, (value, cutoffs) in RULES.items()]
    found = staged(known.select("stratum", "quality", F.explode(F.array(*passed)).alias("r"))
                   .groupBy("stratum", "r.rule", "r.exceeds").agg(
                       F.sum((F.col("quality") > 0).cast("long")).alias("good"),
                       F.sum((F.col("quality") <= 0).cast("long")).alias("bad")), "quality-counts")
    # Cutoffs fall, so cutoff i rejects what exceeds the last ones from it on.
    grid = F.when(F.lit(False), F.array().cast("array<double>"))
    for name, (_, cutoffs) in RULES.items():
        grid = grid.when(F.col("rule") == name, F.array(*[F.lit(float(c)) for c in cutoffs]))
    rules = found.select("stratum", "rule").distinct()
    cells = rules.select("stratum", "rule", F.size(grid).alias("many"), F.posexplode(grid).alias("i", "cutoff"))
    f = found.alias("f")
    rejected = F.col("exceeds") >= F.col("many") - F.col("i")
    sums = cells.alias("c").join(f, F.col("c.stratum").eqNullSafe(F.col("f.stratum")) & (F.col("c.rule") == F.col("f.rule"))).groupBy(
        "c.stratum", "c.rule", "i", "cutoff").agg(
        F.sum("good").alias("n"),
        F.sum(F.when(rejected, F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(rejected, F.col("bad")).otherwise(0)).alias("bad"))
    risk = RISK / len(RULES)
    tests = F.size(F.collect_set(F.coalesce(F.concat(F.lit("s"), F.col("stratum").cast("string")), F.lit("null"))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) * len(RULES)
    allowed = sums.withColumn("tests", tests).where(F.col("k") <= F.col("n") * risk).where(
        _tail(F.col("n"), F.col("k"), risk) <= ERROR / F.col("tests")).where("bad > k")
    best = allowed.groupBy("stratum", "rule").agg(
        F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), (-F.col("i")).alias("lenient"), "cutoff"))["cutoff"].alias("cutoff"))
    picked = [F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(name) for name in RULES]
    return best.groupBy("stratum").agg(*picked).select("stratum", F.struct(*RULES).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept; a stratum without cutoffs rejects nothing more."""
    out = measured.alias("m").join(cutoffs.alias("c"), F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left")
    rejects = F.lit(False)
    for name, (value, _) in RULES.items():
        rejects = rejects | F.coalesce(F.expr(value) > F.col(f"c.cutoffs.{name}"), F.lit(False))
    return out.select("m.*", base_failed().alias("base_failed"), (~base_failed() & ~rejects).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
           name: str = "quality_verdict") -> DataFrame:
    """``docs`` with a struct ``name``: the counts, base_failed and kept.

    ``labels``: (key, quality). Null and empty texts have no words and fail. A null stratum is one of its
    own. Rows that repeat are judged one by one. An empty table gives none. A column
    called ``name`` is replaced; other columns stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{key}`").alias("key"), F.col(f"`{stratum}`").alias("stratum"),
                       measures(F.col(text)).alias("x")).select("row", "key", "stratum", "x.*")
    rows = staged(rows, "quality")  # each text is measured once, for the cutoffs and for its verdict
    cutoffs = staged(learn(rows.drop("row"), labels.select(F.col(key).alias("key"), "quality")), "cutoffs")
    out = judge(rows, cutoffs)
    columns = [c for c in docs.columns if c != name]
    return out.select(*[F.col(f"row.`{c}`") for c in columns], F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").alias(name))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thin = staged(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("stratum"),
                              measures(F.col("text")).alias("x")).select("key", "stratum", "x.*"), "quality")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality")
    return judge(thin, staged(learn(thin, labels), "cutoffs")).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _sql() -> str:
    cells = ", ".join(
        f"('{name}', {i}, {float(c)!r})" for name, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))
    value = "CASE rule " + " ".join(f"WHEN '{name}' THEN {v}" for name, (v, _) in RULES.items()) + " END"
    risk = RISK / len(RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
q AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w
  LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
g AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
cells(rule, i, cutoff) AS (VALUES {cells}),
s AS (
  SELECT lang, rule, i, cutoff, count(*) FILTER (quality > 0) AS n, count(*) FILTER (quality > 0 AND x > cutoff) AS k,
    count(*) FILTER (quality <= 0 AND x > cutoff) AS bad
  FROM (SELECT lang, quality, rule, i, cutoff, {value} AS x FROM b JOIN g USING (doc_id), cells WHERE NOT base_failed)
  GROUP BY ALL),
a AS (
  SELECT s.*, (SELECT count(DISTINCT coalesce('s' || lang, 'null')) FROM s) * {len(RULES)} AS tests,
    (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}::DOUBLE) + (n - j) * ln(1 - {risk!r}::DOUBLE)))
     FROM (SELECT unnest(range(0, k + 1)) AS j)) AS tail
  FROM s WHERE k <= n * {risk!r} AND n > 0),
t AS (
  SELECT lang, rule, cutoff FROM a WHERE tail <= {ERROR} / tests AND bad > k
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - k DESC, i) = 1),
r AS (
  SELECT DISTINCT doc_id FROM (SELECT b.doc_id, cutoff, {value} AS x FROM b JOIN t ON b.lang IS NOT DISTINCT FROM t.lang)
  WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.doc_id IS NULL AS kept
FROM b LEFT JOIN r USING (doc_id)
"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": _sql()}

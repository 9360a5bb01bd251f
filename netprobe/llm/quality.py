"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Defined results: null or empty text has no words, counts 0, and fails the base rule; repeated rows
are judged each for itself; an empty table gives an empty table; extra columns are ignored, or kept
by ``filter_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import WS_CHARS, once, text_or_empty, words_of

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne ou par pas pour que qui sur un une "
    "al como con del el ella es esta las lo los mas no para pero por se su sus una y "
    "als auf aus das dem den der des die ein eine er im ist mit nicht sich sie und von wird zu zur"
).split()

#: metric, lower bound, upper bound (None: open). A document is kept if every metric is within its bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.30),
    ("shout_ratio", None, 0.50),
    ("stop_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.60),
]
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def _joined(hashes: Column, k: int) -> Column:
    """Hashes of runs of 2k words from those of runs of k words: each is hashed with the one k places on."""
    n = F.greatest(F.size(hashes) - k, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, k + 1, n), lambda x, y: F.xxhash64(x, y))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows of 8 words that the text holds twice or more; ``hashes``: those of all windows.

    Hashes settle the common case (all distinct); only texts with equal hashes sort
    them, compare the words of neighbours, and measure the union of the flagged windows."""
    n = F.size(words)
    window = lambda i: F.slice(words, i, WINDOW)
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))

    def flagged(pairs: Column) -> Column:
        def same(p: Column, q: Column) -> Column:
            other = F.get(pairs, q)
            return other.isNotNull() & (other["h"] == p["h"]) & (window(other["i"]) == window(p["i"]))

        return F.sort_array(F.filter(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda i: i.isNotNull()))

    def covered(begin: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(begin, zero, step, lambda acc: acc["n"])

    # an array of one holds the sorted windows, so that they are made once and not per use
    exact = F.get(F.transform(F.array(ranked), lambda pairs: covered(flagged(pairs))), F.lit(0))
    return F.when(n <= WINDOW, 0).when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(exact).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every document, next to its own columns."""
    text, words = text_or_empty(), F.col("_words")
    plain = F.translate(F.col("_text"), WS_CHARS, "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.trim(line, F.lit(WS_CHARS)) != "")
    stops = sorted(set(STOP_WORDS))
    out = docs.withColumn("_text", text).withColumns({"_words": once(words_of(F.col("_text"))), "_lines": once(lines)})
    out = out.withColumn("_windows", once(F.transform(words, lambda w: F.xxhash64(w))))
    for k in (1, 2, 4):  # runs of 1, 2 and 4 words make those of WINDOW
        out = out.withColumn("_windows", once(_joined(F.col("_windows"), k)))
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(plain).cast("long"),
            "n_symbols": (F.char_length("_text") - F.char_length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long"),
            "n_shouts": (F.char_length("_text") - F.char_length(F.translate(F.col("_text"), "!", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stops": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long"),
            "n_repeat_words": _repeat_words(words, F.col("_windows")),
        }
    ).drop("_text", "_words", "_lines", "_windows")


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "shout_ratio": ("n_shouts", "n_words"),
    "stop_ratio": ("n_stops", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def compile_rules(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """One boolean expression of all thresholds."""
    out = F.lit(True)
    for metric, low, high in thresholds:
        value = _ratio(*METRICS[metric])
        if low is not None:
            out = out & (value >= low)
        if high is not None:
            out = out & (value <= high)
    return out


def judge(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """``measure`` plus ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return judge(docs.withColumn("_all", F.struct("*")).select("_all", "text")).filter("kept").select("_all.*")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_shouts", "n_lines", "n_stops",
    )


ORACLE = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: list_contains([{', '.join(f"'{s}'" for s in sorted(set(STOP_WORDS)))}], lower(x))))::BIGINT AS n_stops
    FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed
    AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0 AND n_symbols / n_words <= 0.30
    AND n_shouts / n_words <= 0.50 AND n_stops / n_words >= 0.04
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.60) AS kept
FROM f
"""

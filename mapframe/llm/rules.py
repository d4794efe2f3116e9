"""Quality rules with thresholds that adapt to each language and source. DataFrame operations only.

Counts of each text become shares. KLL sketches hold the distribution of every share by (language, source); they are merged
into sketches by language and of everything, so one pass over the texts serves all levels. Fences around the quartiles
replace fixed cutoffs, and rows are joined with the fences of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, small, whole, without, written

#: Fixed values of the base rules: fewest words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
K = 2048  # size of the sketches: groups up to it have exact quantiles, larger ones ranks within 0.1 %
LEAST_ROWS = 100  # texts a group needs for fences of its own; else those of its language, else of all
REACH = 3.0  # a fence lies so many distances between the quartiles beyond them, at least the slack
#: Shares and the least distance of a fence: (lower, upper); None: no fence on that side.
SLACK = {"word_length": (1.0, 1.0), "symbols": (None, 0.2), "marks": (None, 0.1), "capitals": (None, 0.2),
         "repeated_lines": (None, 0.2), "repeated_words": (None, 0.2)}
FEW_GROUPS = 1 << 16  # fences that are sent to every task, at most; more are joined by a shuffle


def _repeated(words: str) -> tuple[Column, Column]:
    """Hash of the window at each word, and the sorted (hash, place) if any window comes twice."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda word, at: F.xxhash64(
        word, *[F.get(words, at + i) for i in range(1, WINDOW)]))
    placed = F.sort_array(F.transform("windows", lambda window, at: F.struct(window.alias("h"), at.alias("at"))))
    return windows, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)


def counts(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, ``keep`` and counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (lines with a word), n_marks (neither letters, digits nor white space), n_capitals.

    Windows are compared by a 64-bit hash of their words; every other count is exact. Each array is made in a
    projection of its own and used several times above, so that Spark does not make it anew for every element.
    """
    text = F.col("text")
    rows = whole(docs, keep).withColumn("words", F.filter(F.split(text, GAP), lambda word: word != ""))
    windows, placed = _repeated("words")
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != ""))
    rows = rows.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"))
    rows = rows.select(*[c for c in rows.columns if c != "windows"], placed.alias("placed"))
    again = F.filter("placed", lambda x, at: (F.get("placed", at - 1)["h"] == x["h"]) | (F.get("placed", at + 1)["h"] == x["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(*[x["at"] + i for i in range(WINDOW)]))))
    found = F.when(F.col("placed").isNull(), 0).otherwise(F.size(covered))
    return rows.withColumn("n_repeat_words", found.cast("long")).drop("placed")


def shares() -> dict[str, Column]:
    """What the fences judge; NULL for texts without words, which no fence is learned from."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    return {"word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words,
            "marks": F.col("n_marks") / chars, "capitals": F.col("n_capitals") / chars,
            "repeated_lines": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
            "repeated_words": F.col("n_repeat_words") / words}


def fences(measured: DataFrame, keys: tuple[str, str] = ("lang", "source"), least_rows: int = LEAST_ROWS) -> DataFrame:
    """(group_0, group_1, low_*, high_*) for every pair of values of ``keys``, NULL being a value like others.

    Learned from rows with at least LEAST_WORDS words. A pair with fewer than ``least_rows`` of them has the fences
    of its first key, and that one those of all rows. Without any such row at all fences are NULL: nothing is rejected.
    """
    names = list(SLACK)
    own = [F.col(key).alias(f"group_{i}") for i, key in enumerate(keys)]
    learned = F.col("n_words") >= LEAST_WORDS
    sketch = [F.kll_sketch_agg_double(F.when(learned, F.col(name)), F.lit(K)).alias(name) for name in names]
    pairs = written(measured.groupBy(*own).agg(F.count_if(learned).alias("n"), *sketch))
    merged = [F.kll_merge_agg_double(name, F.lit(K)).alias(f"{name}_up") for name in names]
    first = pairs.groupBy("group_0").agg(F.sum("n").alias("n_up"), *merged)
    total = [F.kll_merge_agg_double(f"{name}_up", F.lit(K)).alias(f"{name}_all") for name in names]
    first = written(first)
    every = first.agg(F.sum("n_up").alias("n_all"), *total)

    first = first.withColumnRenamed("group_0", "upper")
    joined = pairs.join(F.broadcast(every)).join(
        small(first, FEW_GROUPS), F.col("group_0").eqNullSafe(F.col("upper")), "left")
    bounds = []
    for name, (low, high) in SLACK.items():
        best = F.when(F.col("n") >= least_rows, F.col(name)).when(
            F.col("n_up") >= least_rows, F.col(f"{name}_up")).when(F.col("n_all") > 0, F.col(f"{name}_all"))
        q1, q3 = (F.kll_sketch_get_quantile_double(best, F.lit(q)) for q in (0.25, 0.75))
        if low is not None:
            bounds.append((q1 - F.greatest(REACH * (q3 - q1), F.lit(low))).alias(f"low_{name}"))
        if high is not None:
            bounds.append((q3 + F.greatest(REACH * (q3 - q1), F.lit(high))).alias(f"high_{name}"))
    return written(joined.select("group_0", "group_1", *bounds))


def judged(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), least_rows: int = LEAST_ROWS) -> DataFrame:
    """Counts, base_failed, kept and reason of every row of (doc_id, text, lang, source, ...).

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated windows. kept:
    not base_failed, and no share beyond the fences of the row's language and source; a share on a fence stays. reason:
    'base', or the first share that is beyond its fence; NULL for rows that stay. NULL and empty texts have no words.
    Repeated rows are judged one by one and count as often as they come. NULL keys form groups of their own. Other
    columns are not read. No rows give no rows.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = counts(docs, list(keys))
    measured = written(rows.withColumns(shares()))
    limits = fences(measured, keys, least_rows)
    joined = measured.join(small(limits, FEW_GROUPS), F.col(keys[0]).eqNullSafe(F.col("group_0"))
                           & F.col(keys[1]).eqNullSafe(F.col("group_1")), "left")
    reason = F.when(base, "base")
    for name, (low, high) in SLACK.items():
        for wanted, beyond in ((low, lambda: F.col(name) < F.col(f"low_{name}")),
                               (high, lambda: F.col(name) > F.col(f"high_{name}"))):
            if wanted is not None:
                reason = reason.when(beyond(), name)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))


def keep_good(docs: DataFrame) -> DataFrame:
    """(doc_id) of rows that stay, joined back to ``docs`` by id: all rows of an id go if one of them goes."""
    return without(docs, written(judged(docs).where(~F.col("kept")).select("doc_id")))

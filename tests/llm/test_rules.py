"""Quality rules against a plain version; fences against exact quantiles."""

import math
import random
import re

import pytest

from mapframe.llm import rules

SPACE = "[\x20\x09-\x0d]"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def measured(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()), key=repr)


def prose(rng, n, extra=""):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) + extra for _ in range(n))


def test_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\r\x0b\x0c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx", "# * $ % & | < >", "a b c", "\n".join(["l i n e"] * 5)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) + rng.choice(["", "\n"]) * 2 for _ in range(80)]
    texts.append(" ".join(rng.choice("abcdefghij") for _ in range(3000)))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    assert measured(rules.judged(docs(spark, rows))) == sorted(((i, *plain(t)) for i, t in enumerate(texts)), key=repr)


def test_fences_follow_each_group(spark):
    """The same share of symbols is usual in one source and an outlier in another."""
    rng, rows = random.Random(3), []
    for i in range(150):
        rows.append((i, prose(rng, 60), "en", "prose"))
        rows.append((1000 + i, prose(rng, 60, "#"), "en", "code"))
    rows += [(5000, prose(rng, 60, "#"), "en", "prose"), (5001, "short", "en", "prose"), (5002, "so it goes " * 40, "en", "prose")]
    got = {r.doc_id: (r.kept, r.base_failed, r.reason) for r in rules.judged(docs(spark, rows)).collect()}
    assert got[5000] == (False, False, "symbols")
    assert got[5001] == got[5002] == (False, True, "base")
    assert sum(not got[i][0] for i in range(150)) + sum(not got[1000 + i][0] for i in range(150)) <= 3


@pytest.mark.parametrize("least", [5, 40, 1000])
def test_fences_are_quantiles_of_the_first_group_large_enough(spark, least):
    rng, rows = random.Random(4), []
    for i in range(120):
        rows.append((i, prose(rng, rng.randint(40, 80), rng.choice(["", "!"])), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    table = rules.counts(docs(spark, rows), ["lang", "source"]).withColumns(rules.shares()).cache()
    data = [r for r in table.collect() if r.n_words >= 50]
    for fence in rules.fences(table, least_rows=least).collect():
        for level in ([r for r in data if (r.lang, r.source) == (fence.group_0, fence.group_1)],
                      [r for r in data if r.lang == fence.group_0], data):
            if len(level) >= least or level is data:
                values = sorted(r.marks for r in level)
                q1, q3 = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
                assert fence.high_marks == q3 + max(rules.REACH * (q3 - q1), rules.SLACK["marks"][1])
                break


def test_sketches_of_large_groups_stay_close(spark):
    rows = spark.range(200_000).selectExpr("'en' AS lang", "'s' AS source", "100L AS n_words", *[
        f"pmod(xxhash64(id), 1000003) / 1000003 AS {name}" for name in rules.SLACK])
    fence = rules.fences(rows).first()
    assert abs(fence.high_marks - (0.75 + rules.REACH * 0.5)) < 0.02


def test_edge_cases(spark):
    rows = [(None, "a b", None, None), (1, None, "en", None), (1, "a b", "en", None), (1, "a b", "en", None)]
    table = docs(spark, rows).selectExpr("*", "1 AS words", "2 AS n_words", "3 AS windows", "4 AS group_0", "5 AS lines")
    got = rules.judged(table)
    assert got.count() == 4 and got.where("kept").count() == 0
    assert rules.judged(table.where("false")).count() == 0
    assert rules.keep_good(table).columns == table.columns


def test_no_python_in_the_plan(spark):
    rows = rules.counts(docs(spark, [(1, "a b c", "en", "s")]), ["lang", "source"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

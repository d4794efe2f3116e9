"""The registered queries over the text tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, decontam, exact, jaccard, licenses, lm, quality, rules, secrets, toxicity, urls, variants
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def public_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and the text that they give back, as digests."""
    return bpe.digests(bpe.tokenized(table(spark, sf_dir, "documents"), *public_vocabulary()))


@query()
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of similar documents."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


@query()
def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log importance and whether it is sampled."""
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it gives away."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that fits its URL, or what the trees say."""
    return urls.judged(table(spark, sf_dir, "pages"))


@query()
def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets."""
    return secrets.summary(secrets.secret_spans(table(spark, sf_dir, "documents")))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice of every document."""
    return licenses.notices(table(spark, sf_dir, "documents"))


@query()
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability under the language model."""
    return lm.language_scores(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
own AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
        FROM runs GROUP BY doc_id, run),
crc AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                 range(CAST(length(x) / 2 AS BIGINT)), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1)
                                                         + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM own, tab),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n
      FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
                      ELSE run END AS word FROM crc)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, substring(word, 1, i) || '_' || substring(word, i + 2) AS hole,
               substring(word, 1, i) || substring(word, i + 2) AS shorter
        FROM v, unnest(range(length(word))) u(i)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
         UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.shorter = v.word
         UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.shorter = v.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS top, max(v.n) AS top_n
         FROM near JOIN v ON near.other = v.word GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * v.n THEN top END AS form,
             CASE WHEN top_n >= 2 * v.n THEN top_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
steps AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
          UNION ALL SELECT s.word, f.form FROM steps s JOIN f ON s.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.at FROM steps s JOIN f ON s.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(ends.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON f.word = ends.word""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its usual form."""
    return variants.variants(table(spark, sf_dir, "documents"))


@query()
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the alignment of its tokens under two public tokenizers, as counts and a digest."""
    import public_tokenizers

    one, two = (open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.aligned(table(spark, sf_dir, "documents"), one, two)


def _fence_sql() -> str:
    """Fences by quantiles of all rows of a group: what sketches give for groups that fit them."""
    names = list(rules.SLACK)
    quartiles = ", ".join(f"quantile_disc({name}, {q}) FILTER (n_words >= 50) AS {name}_{i}"
                          for name in names for i, q in ((1, 0.25), (3, 0.75)))
    levels = {"p": "GROUP BY lang, source", "l": "GROUP BY lang", "e": ""}
    level = ", ".join(f"{level} AS (SELECT {'lang, source,' if level == 'p' else 'lang,' if level == 'l' else ''} "
                      f"count(*) FILTER (n_words >= 50) AS n, {quartiles} FROM s {group})" for level, group in levels.items())
    chosen = ", ".join(f"CASE WHEN p.n >= 100 THEN p.{name}_{i} WHEN l.n >= 100 THEN l.{name}_{i} ELSE e.{name}_{i} END "
                       f"AS {name}_{i}" for name in names for i in (1, 3))
    reason = "CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN 'base'"
    for name, (low, high) in rules.SLACK.items():
        q1, q3 = f"{name}_1", f"{name}_3"
        reach = f"{rules.REACH}::DOUBLE * ({q3} - {q1})"
        if low is not None:
            reason += f" WHEN {name} < {q1} - greatest({reach}, {low}::DOUBLE) THEN '{name}'"
        if high is not None:
            reason += f" WHEN {name} > {q3} + greatest({reach}, {high}::DOUBLE) THEN '{name}'"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS solid,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT doc_id, i, ws[i:i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM wins) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(3) r(j) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, length(solid) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             len(regexp_extract_all(solid, '[^\p{{L}}\p{{N}}]')) AS n_marks, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals,
             len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, word_chars / nullif(n_words, 0) AS word_length, n_symbols / nullif(n_words, 0) AS symbols,
             n_marks / nullif(word_chars, 0) AS marks, n_capitals / nullif(word_chars, 0) AS capitals,
             n_dup_lines / nullif(n_lines, 0) AS repeated_lines, n_repeat_words / nullif(n_words, 0) AS repeated_words FROM c),
{level},
fences AS (SELECT p.lang, p.source, {chosen} FROM p JOIN l ON p.lang IS NOT DISTINCT FROM l.lang, e),
told AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {reason} END AS reason
         FROM s JOIN fences f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(reason = 'base', false) AS base_failed,
       reason IS NULL AS kept, reason FROM told"""


@query(_fence_sql())
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and whether base rules and adaptive thresholds keep it."""
    return rules.judged(table(spark, sf_dir, "documents"))

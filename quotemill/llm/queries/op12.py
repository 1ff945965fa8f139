"""Quality rules by distribution divergence over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import quality_rules as q
from quotemill.session import load

NAME = "op12_quality_rules"
_WORD = r"[\x20\x09-\x0D]+"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"


def _divergence(p: str, q: str) -> str:
    part = "CASE WHEN z[{i}] > 0 THEN z[{i}] * log2(z[{i}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part.format(i=1)} + {part.format(i=2)}) / 2))"


def _shares(counts: str) -> str:
    return f"list_transform({counts}, lambda c: c / list_sum({counts}))"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_WORD}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT *, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x)))::BIGINT, 0) AS word_chars, {_count("#*$%&|<>")} AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
c AS (SELECT *, [length(t) - word_chars, {_count("a-z")}, {_count(chr(92) + "p{Ll}")} - {_count("a-z")}, {_count(chr(92) + "p{Lu}")}, {_count(chr(92) + "p{Nd}")}, n_symbols, {_count(".,;:!?''" + chr(34) + "()-")}] AS taken FROM b),
cl AS (SELECT *, list_append(taken, length(t) - list_sum(taken)::BIGINT) AS classes FROM c),
tri AS (SELECT rid, i, (words[i], words[i + 1], words[i + 2]) AS g FROM (SELECT rid, words, unnest(range(1, n_words - 1)) AS i FROM cl)),
twice AS (SELECT * FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY 1),
base AS (SELECT cl.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM cl LEFT JOIN rep USING (rid)),
good AS (SELECT * FROM base WHERE lang IS NOT NULL AND n_words >= {q.MIN_WORDS}),
tot AS (SELECT lang, sum(n_words)::BIGINT AS total, [{", ".join(f"sum(classes[{i + 1}])::BIGINT" for i in range(len(q.CLASSES)))}] AS ref FROM good GROUP BY 1 HAVING sum(n_words) >= {q.MIN_REFERENCE_WORDS}),
cnt AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, lower(unnest(words)) AS w FROM good) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {q.COMMON}),
top AS (SELECT lang, list(w ORDER BY n DESC, w) AS ref_words, list(n ORDER BY n DESC, w) AS ref_n FROM cnt GROUP BY 1),
refs AS (SELECT lang, {_shares("ref")} AS ref_classes, ref_words, list_prepend(total - list_sum(ref_n)::BIGINT, ref_n) AS ref_all FROM tot JOIN top USING (lang)),
own AS (SELECT base.*, ref_classes, {_shares("ref_all")} AS ref_shares, list_transform(ref_words, lambda r: len(list_filter(words, lambda x: lower(x) = r))) AS own FROM base LEFT JOIN refs USING (lang)),
ow AS (SELECT *, list_prepend(n_words - list_sum(own)::BIGINT, own) AS counts FROM own),
v AS (SELECT *, CASE WHEN NOT base_failed AND ref_classes IS NOT NULL THEN {_divergence(_shares("classes"), "ref_classes")} END AS cd, CASE WHEN NOT base_failed AND ref_classes IS NOT NULL THEN {_divergence(_shares("counts"), "ref_shares")} END AS wd FROM ow)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_divergence, round(wd, 6) AS word_divergence,
       NOT base_failed AND NOT coalesce(cd > {q.MAX_CLASSES} + {q.NOISE} / n_words OR wd > {q.MAX_WORDS} + {q.NOISE} / n_words, false) AS kept FROM v
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = q.judge(load(spark, sf_dir, "documents"))
    return df.withColumns({c: F.round(c, 6) for c in ("class_divergence", "word_divergence")})

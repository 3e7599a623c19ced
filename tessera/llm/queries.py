"""The queries of the training-data operators, with production parameters, and their SQL.

Each is thin: the operator has its own interface in its own module, the query derives the digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, matroska, mixing, pieces, quality, secrets, substrings, toxicity, urls
from tessera.llm.common import crc_mod, table


def model_path() -> str:
    """The SentencePiece model that the queries use, as the installed package gives its place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: (verdict, host, path) of the URL rules, and the hosts that are blocked where no rule fits.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BLOCKED_HOSTS = ["spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org"]


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store(table(spark, sf_dir, "documents"))).drop("error")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_path(), full=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.classify(docs.withColumn("held_out", crc_mod("doc_id", 5) == 0), model, ["doc_id", "held_out"])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.train(docs, "text", "lang", crc_mod("doc_id", 4) != 2)
    return language.identify(docs, prototypes, extra={"held_out": crc_mod("doc_id", 4) == 2})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


OP5 = f"""
WITH parts AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
blocked(bad_host) AS (VALUES {", ".join(f"('{h}')" for h in BLOCKED_HOSTS)}),
ranked AS (SELECT split.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = bad_host OR ends_with(host, '.' || bad_host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM ranked WHERE k = 1
"""


def _time(knots: tuple) -> str:
    """SQL for a schedule's inverted integral at `part`."""
    sums, out = mixing.integral(knots), "CAST(1.0 AS DOUBLE)"
    for (t0, w0), (t1, w1), before, after in reversed(list(zip(knots, knots[1:], sums, sums[1:], strict=False))):
        d = lambda x: f"CAST({x!r} AS DOUBLE)"
        rest = f"(part * {d(sums[-1])} - {d(before)})"
        out = f"CASE WHEN part * {d(sums[-1])} <= {d(after)} THEN {d(t0)} + {d(2.0)} * {rest} / ({d(w0)} + sqrt({d(w0 * w0)} + {d(2 * (w1 - w0) / (t1 - t0))} * {rest})) ELSE {out} END"
    return out


OP6 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][nth % 3 + 1] AS BIGINT) AS weight FROM sources),
filled AS (SELECT *, row_number() OVER w AS j, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM weighed WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, nth)),
level AS (SELECT CAST(3 * total - 4 * full_size AS BIGINT) AS num, CAST(2 * rest_weight AS BIGINT) AS den, j AS first_free FROM filled
  WHERE (3 * total - 4 * full_size) * weight <= 4 * rest_weight * source_size ORDER BY j LIMIT 1),
wanted AS (SELECT source, nth, source_size, CASE WHEN j < first_free THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(num * weight AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM filled, level),
started AS (SELECT doc_id, size, source_size, target, nth, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN wanted ON sized.source IS NOT DISTINCT FROM wanted.source),
passed AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS one, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS two FROM started),
shares AS (SELECT *, (CAST(start AS DOUBLE) + CAST(one AS DOUBLE) / 2) / target AS part FROM passed)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN CASE nth % 3 WHEN 0 THEN {_time(mixing.SCHEDULES[0])} WHEN 1 THEN {_time(mixing.SCHEDULES[1])} ELSE {_time(mixing.SCHEDULES[2])} END END AS position
FROM shares
"""


OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
sets AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, len(any_value(s)) AS n FROM s GROUP BY 1),
each AS (SELECT k, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.k AS a, b.k AS b FROM each a JOIN each b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT k, k FROM sets),
reach AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM edges UNION SELECT t.a, edges.b FROM t JOIN edges ON t.b = edges.a) SELECT * FROM t),
docs AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
least AS (SELECT reach.a AS k, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.k = reach.b WHERE docs.n > 0 GROUP BY reach.a)
SELECT doc_id, CAST(docs.n AS BIGINT) AS n_shingles, CASE WHEN docs.n = 0 THEN doc_id ELSE component_id END AS component_id FROM docs LEFT JOIN least USING (k)
"""


def _bucket(v: str) -> str:
    off = f"greatest(0, length(bin({v})) - 5)"
    return f"((({v}) >> {off}) << {off})"


_WHITE = "[\\x20\\x09-\\x0D]"
_VALUES = [e.replace(" div ", " // ") for _, e, _, _ in quality.MEASURES]
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
starts AS (SELECT n, w, unnest(range(1, len(w) - 6)) AS i FROM d),
windows AS (SELECT n, i, count(*) OVER (PARTITION BY n, array_to_string(w[i:i + 7], ' ')) AS c FROM starts),
covered AS (SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM windows, range(8) AS r(j) WHERE c > 1 GROUP BY n),
c AS (SELECT d.n, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_WHITE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN dups USING (n) LEFT JOIN covered USING (n)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c),
m AS (SELECT lang, source, measure, v FROM (SELECT lang, source, unnest([0, 1, 2, 3]) AS measure, unnest([{", ".join(_VALUES)}]) AS v FROM b WHERE NOT base_failed)),
k AS (SELECT lang, source, measure, {_bucket("v")} AS low, count(*) AS n FROM m GROUP BY ALL),
leveled AS (SELECT 0 AS level, lang AS a, source AS s, measure, low, n FROM k UNION ALL SELECT 1, lang, NULL, measure, low, n FROM k UNION ALL SELECT 2, NULL, NULL, measure, low, n FROM k),
summed AS (SELECT level, a, s, measure, low, sum(n) AS n FROM leveled GROUP BY ALL),
cumulated AS (SELECT *, sum(n) OVER (PARTITION BY level, a, s, measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, a, s, measure) AS total FROM summed),
quartiles AS (SELECT level, a, s, measure, max(total) AS total, min(low) FILTER (upto * 4 >= total) AS q1, min(low) FILTER (upto * 4 >= total * 3) AS q3 FROM cumulated GROUP BY ALL),
fences AS (SELECT *, 3 * greatest(q3 - q1, [{", ".join(str(f) for _, _, f, _ in quality.MEASURES)}][measure + 1]) AS off FROM quartiles),
judged AS (SELECT b.n, b.measure, b.v, f.q1 - f.off AS lo, f.q3 + f.off AS hi, row_number() OVER (PARTITION BY b.n, b.measure ORDER BY f.level) AS best
  FROM (SELECT n, lang, source, unnest([0, 1, 2, 3]) AS measure, unnest([{", ".join(_VALUES)}]) AS v FROM b WHERE NOT base_failed) b
  JOIN fences f ON f.measure = b.measure AND (f.level = 2 OR f.total >= {quality.LEAST}) AND (f.level = 2 OR f.a IS NOT DISTINCT FROM b.lang) AND (f.level > 0 OR f.s IS NOT DISTINCT FROM b.source)),
passed AS (SELECT n, bool_and(v <= hi AND (measure > 0 OR v >= lo)) AS passes FROM judged WHERE best = 1 GROUP BY n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(passes, true)) AS kept FROM b LEFT JOIN passed USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3, "op5_url_filter": OP5, "op6_mixing": OP6, "op9_jaccard": OP9}

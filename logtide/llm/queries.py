"""The numbered queries: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can express one."""

import public_tokenizers
from pyspark.sql import functions as F

from logtide.llm import bpe
from logtide.llm import contamination as decon
from logtide.llm import html
from logtide.llm import rules
from logtide.llm import licenses, packed, quality, suffix, toxicity
from logtide.llm.simhash import simhash_components
from logtide.llm.storage import written


def op1_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digest(bpe.token_rows(docs, public_tokenizers.path("word_bpe_49k.json")))


def op3_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.score(docs, quality.train(docs, labels))


def op4_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed.read_tokens(packed.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op5_html(spark, sf_dir):
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontamination(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decon.digest(decon.contamination(docs, bench))


def op7_suffix_dedup(spark, sf_dir):
    rows = suffix.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark, sf_dir):
    """From a stored ledger, as any later policy would be applied to it."""
    rows = _ledger(spark, sf_dir)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*cols, (~rules.passes("base")).alias("base_failed"), rules.passes("v1").alias("kept"), F.col("failed").alias("failed_bits"))


def _ledger(spark, sf_dir):
    return written(rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger")


def rule_ablations(spark, sf_dir):
    """For each rule of the current policy: the documents that it fails, and those that it alone fails."""
    return rules.ablations(_ledger(spark, sf_dir), "v1")


def op9_licenses(spark, sf_dir):
    """Each document is the file source/lang/block/doc_id; ids of whole hundreds are licence files of source/lang.

    A part that is null is ``_``; a null id is no licence file.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = lambda c: F.coalesce(c.cast("string"), F.lit("_"))
    licence_file = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    names = [part(F.col("source")), part(F.col("lang")), F.when(~licence_file, part(F.floor(F.col("doc_id") / 1000))), part(F.col("doc_id"))]
    files = docs.select("doc_id", F.concat_ws("/", *names).alias("path"), "text")
    found = licenses.scan(files, licenses.template_table(spark), licence_file=licence_file, carry=("doc_id",))
    return found.select("doc_id", "path", "license", "cosine", "origin")


def op10_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.train(docs, labels))


QUERIES = {"op1_simhash": op1_simhash, "op2_bpe": op2_bpe, "op3_quality": op3_quality, "op4_token_files": op4_token_files, "op5_html": op5_html, "op6_decontamination": op6_decontamination, "op7_suffix_dedup": op7_suffix_dedup, "op8_quality_rules": op8_quality_rules, "op9_licenses": op9_licenses, "op10_toxicity": op10_toxicity, "rule_ablations": rule_ablations}

_MEASURED = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0B\f\r]')) AS ls FROM d),
t AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM t),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(ls) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, len(list_distinct(ws)) AS n_distinct_words FROM w LEFT JOIN r USING (rid)),
l AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(rules.RULES.values())) + " AS failed FROM m)"
_TEMPLATES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in licenses.template_rows())
_LICENSES = f"""WITH tpl(license, kind, text) AS (VALUES {_TEMPLATES}),
tt AS (SELECT *, row_number() OVER () AS tid, CASE WHEN kind = 'spdx' THEN [lower(text)] ELSE regexp_extract_all(lower(text), '[a-z0-9]+') END AS terms FROM tpl),
sizes AS (SELECT DISTINCT len(terms) AS n FROM tt WHERE kind = 'header'), firsts AS (SELECT list(DISTINCT terms[1]) AS f FROM tt WHERE kind = 'header'),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir, coalesce(doc_id % 100 = 0, false) AS is_file, regexp_matches(text, '{licenses.HEADER}') AS said FROM documents),
t AS (SELECT rid, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM d WHERE said),
tag AS (SELECT rid, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \t]*([^\r\n]*)', 1)) AS tag FROM d WHERE said),
p AS (SELECT rid, t, unnest(range(0, len(t))) AS p FROM t),
q AS (SELECT rid, t, p, n, unnest(range(greatest(0, p - n + 1), p + 1)) AS s FROM p, sizes WHERE regexp_matches(t[p + 1], '^(licen[cs]e|copyright)')),
found AS (SELECT DISTINCT * FROM (
 SELECT rid, 'spdx' AS kind, [id] AS terms FROM (SELECT rid, unnest(regexp_extract_all(lower(tag), '[a-z0-9.+-]+')) AS id FROM tag)
 UNION ALL SELECT rid, 'file', regexp_extract_all(lower(text), '[a-z0-9]+') FROM d WHERE is_file
 UNION ALL SELECT rid, 'header', t[s + 1 : s + n] FROM q, firsts WHERE (p - s) % greatest(1, n // 2) = 0 OR list_contains(f, t[s + 1])) WHERE len(terms) > 0),
lines AS (SELECT *, row_number() OVER () AS pid FROM (SELECT DISTINCT kind, terms FROM found)),
df AS (SELECT kind, term, count(*) AS df FROM (SELECT DISTINCT kind, tid, unnest(terms) AS term FROM tt) GROUP BY ALL), n AS (SELECT kind, count(*) AS n FROM tt GROUP BY kind),
pw AS (SELECT pid, kind, term, count(*) * (1 + ln((1 + n) / (1 + coalesce(df, 0)))) AS w FROM (SELECT pid, kind, unnest(terms) AS term FROM lines) LEFT JOIN df USING (kind, term) JOIN n USING (kind) GROUP BY pid, kind, term, df, n),
tw AS (SELECT tid, license, kind, term, count(*) * (1 + ln((1 + n) / (1 + df))) AS v FROM (SELECT tid, license, kind, unnest(terms) AS term FROM tt) JOIN df USING (kind, term) JOIN n USING (kind) GROUP BY tid, license, kind, term, df, n),
ps AS (SELECT pid, sqrt(sum(w * w)) AS size FROM pw GROUP BY pid), ts AS (SELECT tid, sqrt(sum(v * v)) AS size FROM tw GROUP BY tid),
dots AS (SELECT pid, tid, license, sum(w * v) AS dot FROM pw JOIN tw USING (kind, term) GROUP BY ALL),
best AS (SELECT pid, license, round(dot / (ps.size * ts.size), 6) AS cosine FROM dots JOIN ps USING (pid) JOIN ts USING (tid)
 QUALIFY cosine >= {licenses.LEAST} AND row_number() OVER (PARTITION BY pid ORDER BY cosine DESC, license) = 1),
own AS (SELECT rid, license, cosine, kind <> 'file' AS part FROM found JOIN lines USING (kind, terms) JOIN best USING (pid) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY kind <> 'file', cosine DESC, license) = 1),
up AS (SELECT dir, own.license, own.cosine FROM d JOIN own USING (rid) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY part, cosine DESC, own.license) = 1)
SELECT doc_id, dir || CASE WHEN is_file THEN '' ELSE '/' || coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), '_') END || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, coalesce(own.license, up.license) AS license, coalesce(own.cosine, up.cosine) AS cosine,
 CASE WHEN own.license IS NOT NULL THEN 'declared' WHEN up.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin FROM d LEFT JOIN own USING (rid) LEFT JOIN up USING (dir)"""
_V1 = rules.mask(rules.POLICIES["v1"])
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, least(13, len(ws)) AS size, i, ws FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS s FROM k),
dw AS (SELECT rid, i, size, array_to_string(ws[i : i + size - 1], ' ') AS s FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
h AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM h)) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)""",
    "op8_quality_rules": f"""{_MEASURED} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rules.mask(rules.POLICIES["base"])} <> 0 AS base_failed, failed & {_V1} = 0 AS kept, CAST(failed AS BIGINT) AS failed_bits FROM l""",
    "op9_licenses": _LICENSES,
    "rule_ablations": f"{_MEASURED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(count(*) FILTER (failed & {rules.mask((n,))} <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed & {_V1} = {rules.mask((n,))}) AS BIGINT) AS n_only FROM l" for n in rules.POLICIES["v1"]),
}

"""Queries of the text functions."""

from __future__ import annotations

from folia.functions import text as X
from folia.functions import trees
from folia.operators import shingles
from folia.plans.base import F, col_query, literal_query, table
from folia.sources.literal import Literal

C = F.col
_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_LIGHT = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?i)</?(?:b|i|u|s|em|strong|del|ins|mark|sub|sup)\s*>', '', 'g'), '\*\*|__|\*|`+', '', 'g'), '\s+', ' ', 'g'))"
_CONTENT = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?m)^[ \t]*(?:`{{3,}}|~{{3,}})[^\n]*$', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '\\(?:[a-zA-Z]+\*?|[^a-zA-Z\s])', ' ', 'g')), '[^0-9a-z]+', '', 'g')"

REASONS = Literal("id bigint, reason string", [(1, "No match found with threshold 0.8, best match ratio was 0.63"), (2, "No tables found"), (3, None), (4, "with threshold 0.9 only"), (5, "x with threshold 0.75 y best match ratio was 0.2")]).over("part", "p_partkey + 1000; CASE WHEN p_partkey % 3 = 0 THEN 'No tables found' ELSE 'No match found with threshold 0.8, best match ratio was 0.' || p_size END")
FENCES = Literal("id bigint, t string", [(1, "```markdown\n# A\ntext\n```"), (2, "```\nplain\n```  "), (3, "```python\nx=1\n```"), (4, "no fence"), (5, "```md\ncut short"), (6, "```\nopen"), (7, "   spaced  ")]).over("part", "p_partkey + 1000; '```md' || chr(10) || p_name || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '```' ELSE '' END")
PIPES = Literal("id bigint, t string", [(1, "| a | b |"), (2, "|x|y|z|"), (3, "1 | 2"), (4, "|:--|--:|"), (5, "  | lead ")]).over("part", "p_partkey + 1000; '| ' || p_name || ' | ' || p_brand || ' |'")
NUMBERS = Literal("id bigint, t string", [(1, "total $1,234.50 and 12% of -3"), (2, "none here"), (3, "1e3 + 2.5E-1"), (4, "7")]).over("documents", "doc_id + 1000; text")
RULES = Literal("id bigint, text string, labels array<string>, value string", [(1, "Sales 2019 were 1,200 units", ["Sales", "2019"], "1200"), (2, "Sales were low", ["Sales"], "12"), (3, "alpha beta n/a", ["alpha"], "n/a"), (4, "rate 12.5%", ["rate"], "12.5"), (5, "x 5", ["missing"], "5")])
NAMES = Literal("id bigint, t string", [(1, "form1[0].#subform[0].Last_Name[0]"), (2, "topmost.firstName"), (3, "DateOfBirth2"), (4, "field"), (5, "a_b_c")]).over("part", "p_partkey + 1000; p_brand || '.' || p_name || '[0]'")
TABLES = Literal("id bigint, t string", [(1, "x <table><tr><td>1</td></tr></table> y <TABLE a=1><tr><th >2</th><td>3</td></tr></TABLE>"), (2, "none"), (3, "| a | b |\n|--|--|\n| 1 | 2 |"), (4, "<table>open")]).over("pages", "page_id + 1000; html")
PAIRS = Literal("id bigint, a string, b string", [(1, "kitten", "sitting"), (2, "", ""), (3, "**bold** text", "bold  text"), (4, "abc", ""), (5, "<b>x</b> y", "x y"), (6, "# Head\n\n| a | b |", "head a b"), (7, "\\frac{1}{2} x", "12x")]).over("customer", "c_custkey + 1000; c_name; c_mktsegment")


def _conversation_pairs(spark, sf_dir):
    """Each turn beside the next one of its conversation."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    return c.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))


def _sim(fn):
    """Similarity of each turn with the next, whatever their script."""
    return lambda spark, sf_dir: _conversation_pairs(spark, sf_dir).where("next IS NOT NULL").select("conv_id", "turn", F.round(fn(F.col("text"), F.col("next")), 9).alias("sim"))


def _shingle_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(C("doc_id").alias("doc"), "text")
    return shingles.counts(docs, X.norm_simple(C("text"))).withColumnRenamed("doc", "doc_id")


def _repetition(d):
    r = X.repetition(C("text"))
    return d.select("doc_id", r.alias("r")).select("doc_id", F.round("r.repeated", 9).alias("repeated"), F.round("r.top", 9).alias("top"))


def _rule_recall(spark, sf_dir):
    f = RULES.df(spark, sf_dir)
    nums, v = X.numbers_in(C("text")), F.regexp_replace("value", "[$%, ]", "").try_cast("double")
    value_ok = F.when(v.isNotNull(), F.exists(nums, lambda n: X.close_to(n, v))).otherwise(F.contains("text", F.col("value")))
    return f.select("id", (F.forall("labels", lambda x: F.contains("text", x)) & value_ok).alias("recalled"))


def _partial(spark, sf_dir):
    return PAIRS.df(spark, sf_dir).select("id", F.round(X.partial_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


def _family_router(spark, sf_dir):
    """Score by kind: without gold 0; tables (identical markup) 1 or 0; other text by edit similarity."""
    f = PAIRS.df(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    score = F.when(b == "", F.lit(0.0)).when(X.has_table(b), F.when(X.light_norm(a) == X.light_norm(b), 1.0).otherwise(0.0)).otherwise(X.edit_sim(a, b))
    return f.select("id", F.when(b == "", "none").when(X.has_table(b), "table").otherwise("edit").alias("metric"), F.round(score, 9).alias("score"))


MARKUP = Literal("id bigint, a string, b string", [(1, "<table><tr><td>1</td><td>2</td></tr></table>", "<table><tr><td>1</td><td>2</td></tr></table>"), (2, "<table><tr><td>1</td><td>2</td></tr></table>", "<table><tr><td>1</td></tr></table>"), (3, "no table", "<table></table>"), (4, "<table><tr><td>abcd</td></tr></table>", "<table><tr><td>abce</td></tr></table>"), (5, "<table><tr><td>x</td></tr>", "<table><tr><th>x</th></tr></table>")])


QUERIES = {
    "str_teds": (lambda s, d: MARKUP.df(s, d).select("id", F.round(trees.table_similarity(C("a"), C("b")), 6).alias("teds")), "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE), (2::BIGINT, 0.75::DOUBLE), (3::BIGINT, 0.0::DOUBLE), (4::BIGINT, 0.916667::DOUBLE), (5::BIGINT, 0.666667::DOUBLE)) AS t(id, teds)"),
    "str_norm_simple": col_query("", "documents", "doc_id", lambda: {"h": F.md5(X.norm_simple(C("text")).cast("binary"))}, f"SELECT doc_id, md5({_NORM}) AS h FROM documents"),
    "str_normalize_nfkc": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.norm_nfkc(C("text")).cast("binary")).alias("h")), None),
    "str_content_norm": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.content_norm(C("text")).cast("binary")).alias("h")), None),
    "str_edit_sim": (_sim(X.edit_sim), None),
    "str_content_sim": (_sim(X.content_sim), None),
    "str_effective_length": col_query("", "documents", "doc_id", lambda: {"n": X.effective_length(C("text"))}, "SELECT doc_id, length(text) + 1.5::DOUBLE * length(regexp_replace(text, '[^\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]', '', 'g')) AS n FROM documents"),
    "str_char_shingles": (_shingle_counts, f"WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM d) SELECT doc_id, CASE WHEN length(t) >= 12 THEN len(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) WHEN length(t) > 0 THEN 1 ELSE 0 END::BIGINT AS n, len(list_distinct(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i : i + 7], ' '))))::BIGINT AS n_words FROM w"),
    "str_word_shingles": col_query("", "benchmark", "item_id", lambda: {"g": F.array_join(F.array_sort(X.word_shingles(X.norm_simple(C("text")))), "|")}, f"WITH w AS (SELECT item_id, string_split({_NORM}, ' ') AS w FROM benchmark) SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i : i + 7], ' ')))), '|') AS g FROM w"),
    "str_value_seq": col_query("", "documents", "doc_id", lambda: {"v": F.array_join(X.value_tokens(C("text")), " ")}, r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[0-9][0-9,.\-$%()]*|[A-Z]{2,}[0-9A-Z\-]*'), lambda x: length(x) > 1), ' ') AS v FROM documents"),
    "str_light_norm": col_query("", "pages", "page_id", lambda: {"h": F.md5(X.light_norm(F.col("html")).cast("binary"))}, f"SELECT page_id, md5({_LIGHT.format('html')}) AS h FROM pages"),
    "str_edit_distance_js": literal_query(PAIRS, lambda: {"d": F.levenshtein("a", "b")}, "SELECT id, levenshtein(a, b)::INTEGER AS d FROM f"),
    "str_partial_ratio": (_partial, None),
    "str_repetition": (lambda s, d: _repetition(table(s, d, "documents")), r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, CASE WHEN len(w) < 40 AND length(text) >= 40 THEN string_split(text, '') ELSE w END AS u, CASE WHEN len(w) < 40 AND length(text) >= 40 THEN 30 ELSE 10 END AS k FROM d),
      g AS (SELECT doc_id, array_to_string(u[i : i + k - 1], chr(1)) AS g FROM u, unnest(range(1, len(u) - k + 2)) AS t(i) WHERE len(u) >= k), c AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL), s AS (SELECT doc_id, round(1.0 - count(*) / sum(c), 9) AS repeated, round(max(c) / sum(c), 9) AS top FROM c GROUP BY doc_id)
      SELECT doc_id, coalesce(repeated, 0.0)::DOUBLE AS repeated, coalesce(top, 0.0)::DOUBLE AS top FROM d LEFT JOIN s USING (doc_id)"""),
    "str_table_markup": col_query("", "pages", "page_id", lambda: {"has": X.has_table(F.col("html"))}, r"SELECT page_id, contains(lower(html), '<table') OR regexp_matches(html, '(?m)^\s*\|.*\|\s*$') AS has FROM pages"),
    "str_strip_emphasis": col_query("", "documents", "doc_id", lambda: {"h": F.md5(X.strip_emphasis(C("text")).cast("binary")), "rate": F.round(X.emphasis_rate(C("text")), 9)}, "SELECT doc_id, md5(regexp_replace(text, '[*_~`]+', '', 'g')) AS h, round(CASE WHEN length(text) > 0 THEN 1000.0 * len(regexp_extract_all(text, '[*_~`]+')) / length(text) ELSE 0 END, 9)::DOUBLE AS rate FROM documents"),
    "str_scorer_ratio": literal_query(REASONS, lambda: {"threshold": X.scorer_ratio(F.col("reason"))[0], "ratio": X.scorer_ratio(F.col("reason"))[1]}, r"SELECT id, CASE WHEN b IS NOT NULL THEN a END AS threshold, CASE WHEN a IS NOT NULL THEN b END AS ratio FROM (SELECT id, TRY_CAST(regexp_extract(reason, 'with threshold ([\d.]+)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(reason, 'best match ratio was ([\d.]+)', 1) AS DOUBLE) AS b FROM f)"),
    "str_strip_fence": literal_query(FENCES, lambda: {"out": X.strip_fence(F.col("t"))}, r"""SELECT id, CASE WHEN o AND regexp_matches(body, '```$') THEN regexp_replace(regexp_replace(body, '```$', ''), '^\s+|\s+$', '', 'g') WHEN o AND tag <> '' THEN regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE s END AS out
      FROM (SELECT id, s, regexp_replace(s, '^```[^\n]*\n', '') AS body, lower(trim(regexp_extract(s, '^```([^\n]*)\n', 1))) AS tag, regexp_matches(s, '^```[^\n]*\n') AND lower(trim(regexp_extract(s, '^```([^\n]*)\n', 1))) IN ('', 'markdown', 'md') AS o FROM (SELECT id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s FROM f))"""),
    "str_pipe_split": literal_query(PIPES, lambda: {"cells": F.array_join(X.pipe_cells(F.col("t")), "/"), "align": F.forall(X.pipe_cells(F.col("t")), lambda c: F.rlike(c, F.lit("^:?-+:?$"))), "html": F.concat(F.lit("<tr>"), F.array_join(F.transform(X.pipe_cells(F.col("t")), lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))}, r"SELECT id, array_to_string(c, '/') AS cells, len(list_filter(c, lambda x: NOT regexp_matches(x, '^:?-+:?$'))) = 0 AS align, '<tr>' || array_to_string(list_transform(c, lambda x: '<td>' || x || '</td>'), '') || '</tr>' AS html FROM (SELECT id, list_transform(string_split(regexp_replace(trim(t), '^\||\|$', '', 'g'), '|'), lambda x: trim(x)) AS c FROM f)"),
    "str_numbers_in": literal_query(NUMBERS, lambda: {"n": F.array_join(F.transform(X.numbers_in(F.col("t")), lambda x: F.when(F.abs(x) >= 1e12, "big").otherwise(F.format_string("%.4f", x))), " ")}, r"SELECT id, array_to_string(list_transform(regexp_extract_all(t, '[-+]?[$]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?%?'), lambda x: CASE WHEN abs(TRY_CAST(regexp_replace(x, '[$%, ]', '', 'g') AS DOUBLE)) >= 1e12 THEN 'big' ELSE printf('%.4f', TRY_CAST(regexp_replace(x, '[$%, ]', '', 'g') AS DOUBLE)) END), ' ') AS n FROM f"),
    "str_rule_recall": (_rule_recall, f"""WITH {RULES.cte('f')}, n AS (SELECT *, TRY_CAST(regexp_replace(value, '[$%, ]', '', 'g') AS DOUBLE) AS v, list_transform(regexp_extract_all(text, '[-+]?[$]?\\d[\\d,]*(?:\\.\\d+)?(?:[eE][-+]?\\d+)?%?'), lambda x: TRY_CAST(regexp_replace(x, '[$%, ]', '', 'g') AS DOUBLE)) AS nums FROM f)
      SELECT id, len(list_filter(labels, lambda x: NOT contains(text, x))) = 0 AND CASE WHEN v IS NOT NULL THEN len(list_filter(nums, lambda y: abs(y - v) <= greatest(1e-6 * greatest(abs(y), abs(v)), 1e-9))) > 0 ELSE contains(text, value) END AS recalled FROM n"""),
    "str_md_inline": col_query("", "pages", "page_id", lambda: {"h": F.md5(X.md_inline(F.col("html")).cast("binary"))}, r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g'), '(?i)</?(?:b|strong)>', '**', 'g'), '(?i)</?(?:i|em)>', '*', 'g'), '(?i)</?code>', '`', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS h FROM pages"""),
    "str_split_words": col_query("", "documents", "doc_id", lambda: {"n_words": F.size(X.plain_words(C("text"))).cast("bigint"), "n_digits": F.regexp_count(C("text"), F.lit(r"\d+")).cast("bigint")}, r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]'))::BIGINT AS n_words, len(regexp_extract_all(text, '\d+'))::BIGINT AS n_digits FROM documents"),
    "str_split_sentences": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(X.sentences(C("text"))).cast("bigint").alias("n")), None),
    "str_page_markdown": (lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("md")))), lambda x: x["md"]), "\n\n").alias("md")).select("conv_id", F.md5(F.col("md").cast("binary")).alias("h")), "SELECT conv_id, md5(string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id"),
    "str_cell_count": literal_query(TABLES, lambda: {"n": F.regexp_count(F.col("t"), F.lit("<t[dh][ >]")).cast("bigint")}, "SELECT id, len(regexp_extract_all(t, '<t[dh][ >]'))::BIGINT AS n FROM f"),
    "str_family_router": (_family_router, f"WITH {PAIRS.cte('f')}, n AS (SELECT *, {_LIGHT.format('a')} AS x, {_LIGHT.format('b')} AS y, contains(lower(b), '<table') OR regexp_matches(b, '(?m)^\\s*\\|.*\\|\\s*$') AS tb FROM f) SELECT id, CASE WHEN b = '' THEN 'none' WHEN tb THEN 'table' ELSE 'edit' END AS metric, round(CASE WHEN b = '' THEN 0.0 WHEN tb THEN CASE WHEN x = y THEN 1.0 ELSE 0.0 END WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) END, 9)::DOUBLE AS score FROM n"),
    "scan_tables_in_md": literal_query(TABLES, lambda: {"n": F.size(F.regexp_extract_all(F.col("t"), F.lit("(?is)<table.*?</table>"), F.lit(0))).cast("bigint"), "h": F.md5(F.array_join(F.regexp_extract_all(F.col("t"), F.lit("(?is)<table.*?</table>"), F.lit(0)), "|").cast("binary"))}, "SELECT id, len(x)::BIGINT AS n, md5(array_to_string(x, '|')) AS h FROM (SELECT id, regexp_extract_all(t, '(?is)<table.*?</table>') AS x FROM f)"),
    "clip_text": col_query("", "documents", "doc_id", lambda: {"h": F.md5(X.clip(C("text")).cast("binary"))}, "SELECT doc_id, md5(CASE WHEN length(text) <= 1200 THEN text ELSE left(text, 900) || ' [...] ' || right(text, 300) END) AS h FROM documents"),
}
QUERIES["str_clean_name"] = literal_query(NAMES, lambda: {"label": X.clean_label(F.col("t"))}, r"""SELECT id, upper(left(x, 1)) || substr(x, 2) AS label FROM (SELECT id, trim(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^.*\.', ''), '\[\d+\]', '', 'g'), '[#_]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '\d+$', '')), '\s+'), lambda w: lower(w) NOT IN ('subform', 'form', 'field', 'topmostsubform')), ' ')) AS x FROM f)""")

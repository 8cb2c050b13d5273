"""Queries of sources and sinks: data are written through a sink into the shared folder and read through a source."""

from __future__ import annotations

from folia.operators import joins as J
from folia.plans.base import F, literal_query, table
from folia.sources import readers as R
from folia.sources import sinks as K
from folia.sources.literal import Literal
from folia.sources.sinks import place

C = F.col
REPORT = Literal("id bigint, t string", [(1, "log\n  f1 : 10.0% (1/10 tests)\nFinal Summary\n  f1 : 50.0% (5/10 tests)\n  f2 : 25.5% (1/4 tests)\n"), (2, "nothing")])
FAILLOG = Literal("line bigint, t string", [(1, "[FAIL] Test a_1 on p Ex: first"), (2, "ok"), (3, "[FAIL] Test a_1 on p Ex: second"), (4, "[FAIL] Test b_2 x Ex: No tables found")]).over("part", "p_partkey + 1000; '[FAIL] Test t_' || (p_partkey % 10) || ' on p Ex: ' || p_name")
METRICS = Literal("id bigint, t string", [(1, '{"text": {"all": 0.8}, "table": {"all": 0.6}, "math": {"all": 0.7}}'), (2, '{"text": {"all": 0.9}, "table": {}, "math": {"all": 0.1}}')]).over("part", "p_partkey + 1000; '{\"text\": {\"all\": 0.' || (p_size % 9 + 1) || '}, \"table\": {\"all\": 0.5}, \"math\": {\"all\": 0.25}}'")
OLD = Literal("rung bigint, n bigint, note string", [(64, 10, "x"), (256, 20, "y")]).over("region", "r_regionkey + 2000; r_regionkey; r_name")
NEW = Literal("rung bigint, n bigint", [(256, 25), (1024, 5)]).over("nation", "n_nationkey + 2000; n_regionkey")
SKIPS = Literal("id bigint, test string, gold string, rules bigint", [(1, None, "g", 1), (2, "t", None, 1), (3, "t", "g", 0), (4, "t", "g", 2)]).over("documents", "doc_id + 1000; CASE WHEN doc_id % 5 > 0 THEN 't' END; CASE WHEN doc_id % 7 > 0 THEN 'g' END; doc_id % 3")


def _jsonl(required):
    def run(s, d):
        at = place(s)
        K.jsonl(table(s, d, "documents").select("doc_id", "lang", "n_chars"), at)
        return R.jsonl(s, at, "doc_id bigint, lang string, n_chars bigint", required)

    return run


def _lines(s, d):
    """The lines that the sink writes, as text."""
    at = place(s)
    K.jsonl(table(s, d, "documents").select("doc_id", "lang", "n_chars"), at)
    return s.read.text(at).select(C("value").alias("line"))


def _lenient(s, d):
    at = place(s)
    table(s, d, "benchmark").select(F.when(F.pmod("item_id", F.lit(7)) == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("item_id", "text")))).coalesce(1).write.text(at)
    return R.jsonl_lenient(s, at, "item_id bigint, text string").where("item_id IS NOT NULL")


def _array(s, d):
    at = place(s)
    one = table(s, d, "nation").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("data"))).alias("v"))
    one.coalesce(1).write.text(at)
    return R.json_array(s, at, "struct<n_nationkey:bigint,n_name:string>").select("n_nationkey", "n_name")


def _rules(s, d):
    at = place(s)
    lit = Literal("pdf string, type string, text string", [("p1", "present", "a"), ("p1", "absent", "b"), ("p1", "present", "c"), ("p2", "order", "d")])
    lit.df(s, d).coalesce(1).write.json(at)
    return R.rule_gold(s, at)


def _split(s, d):
    at = place(s)
    K.split(table(s, d, "documents").select("doc_id", "lang"), at, "lang")
    return s.read.parquet(at).groupBy("lang").agg(F.count("*").alias("n"))


def _csv(s, d):
    at = place(s)
    K.csv(table(s, d, "nation").select("n_nationkey", "n_name"), at)
    return s.read.schema("n_nationkey bigint, n_name string").option("header", True).csv(at)


def _volume(s, d):
    at = place(s)
    table(s, d, "region").select("r_name").coalesce(1).write.text(at)
    return R.texts(s, at, ".txt").select(F.regexp_count("text", F.lit("[A-Z ]+")).cast("bigint").alias("n"))


def _store(s, d):
    at = place(s)
    table(s, d, "region").repartition(2).write.parquet(at)
    return R.listing(s, at, "*.parquet").agg(F.count("*").alias("files"))


def _manifest(s, d):
    lit = Literal("id bigint, t string", [(1, '{"version": 2, "images": {}}'), (2, '{"a": 1}\n{"a": 2}'), (3, "text")])
    return lit.df(s, d).select("id", R.is_manifest(C("t")).alias("manifest"))


def _errors(s, d):
    good, bad = K.with_errors(table(s, d, "documents").select("doc_id", "n_chars"), C("n_chars") > 0)
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


def _skip():
    return {"reason": F.when(C("test").isNull(), "missing_test_json").when(C("gold").isNull(), "no_gold_markdown").when(C("rules") == 0, "no_chart_rules")}


def _slices():
    g = lambda k: F.get_json_object("t", f"$.{k}.all").cast("double")
    return {"text": g("text"), "composite": F.round((g("text") + g("table") + g("math")) / 3 * 100, 4)}


def _headers(s, d):
    """Sizes and digests of the contents of a store, file by file."""
    at = place(s)
    table(s, d, "region").select("r_name").orderBy("r_name").coalesce(1).write.text(at)
    files = s.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at)
    return files.select(F.sha2("content", 256).alias("sha"), C("length").alias("bytes"), F.hex(F.substring("content", 1, 2)).alias("magic"))


def _incremental(s, d):
    from folia.streaming.incremental import stream_once

    at = place(s)
    src = table(s, d, "events").select("event_id", "user_id", "value")
    src.where("event_id % 2 = 0").write.parquet(f"{at}/in/a")
    opts = {"source": f"{at}/in/*", "schema": "event_id bigint, user_id bigint, value double", "sink": f"{at}/out", "checkpoint": f"{at}/ck", "key": "event_id"}
    stream_once(s, **opts)
    src.write.parquet(f"{at}/in/b")
    stream_once(s, **opts)
    return s.read.parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _probes(s, d):
    """Probe rows written as JSON lines of mixed labels, read, checked and counted by family."""
    at = place(s)
    name = F.when(C("doc_id") % 5 == 0, F.lit("pl3_")).otherwise(F.lit("pl1_"))
    site = F.when(C("doc_id") % 7 == 0, F.lit("pooled"))
    image = F.concat(F.lit("docs/"), "source", F.lit("_s001__p"), C("doc_id").cast("string"))
    label = F.when(C("doc_id") % 2 == 0, F.to_json(F.array(C("n_chars")))).otherwise(F.to_json(F.struct(C("lang").alias("l"))))
    rows = table(s, d, "documents").select(F.concat(name, "lang").alias("probe"), image.alias("image_id"), label.alias("label"), F.when(site.isNull(), F.array(F.lit(0.25), F.lit(0.5))).alias("point_xy"), site.alias("site"), F.when(C("doc_id") % 3 == 0, "classification").alias("task_type"), F.when(C("doc_id") % 4 == 0, F.concat(F.lit("own"), C("doc_id").cast("string"))).alias("doc_id"))
    K.jsonl(rows, at)
    p = R.probes(s, at)
    return p.groupBy("probe", "pooled").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count("task_type").alias("typed"))


def _features(s, d):
    """A point's vector from whole grids (4 x 4 cells of four numbers) or from stored sites, pooled vectors, and how many have neither."""
    e = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("im"), C("vec_id").cast("string")).alias("image_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    kind = C("vec_id") % 5
    stored = e.where(kind < 3).select("image_id", F.when(kind != 1, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4))).alias("tokens"), F.when(kind != 0, F.array(F.struct(F.lit(0.375).alias("x"), F.lit(0.625).alias("y"), F.slice("v", 1, 4).alias("vec")))).alias("sites"), F.slice("v", 5, 4).alias("pooled"))
    at = f"{place(s)}/features"
    stored.write.parquet(at)
    probes = e.select("image_id", (kind != 4).alias("site")).select("image_id", (~C("site")).alias("pooled"), F.when(C("site"), F.array(F.lit(0.375), F.lit(0.625))).alias("point_xy"))
    probes = probes.unionByName(e.where("vec_id % 2 = 0").select("image_id", F.lit(True).alias("pooled"), F.lit(None).cast("array<double>").alias("point_xy")))
    found = J.assembled(probes, s.read.parquet(at), grid=4)
    return found.select("image_id", "pooled", "layout", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


_FEATURES_SQL = """WITH e AS (SELECT vec_id, 'im' || vec_id AS image_id, vec_id % 5 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT *, k = 4 AS pooled FROM e UNION ALL SELECT *, true FROM e WHERE vec_id % 2 = 0)
  SELECT image_id, pooled, CASE WHEN k >= 3 THEN NULL WHEN pooled THEN 'pooled' WHEN k = 1 THEN 'sites' ELSE 'grid' END AS layout, CASE WHEN k < 3 THEN list_transform(CASE WHEN pooled THEN v[5:8] WHEN k = 1 THEN v[1:4] ELSE v[37:40] END, lambda x: round(x, 6)) END AS vec FROM p"""


def _layers(s, d):
    """Text layers of pages, stored by file and page, put together per file."""
    at = place(s)
    table(s, d, "conversations").select(C("conv_id").alias("file"), C("turn").alias("page"), "text").repartition(4).write.json(at)
    return R.text_layers(s.read.schema("file bigint, page bigint, text string").json(at)).select("file", F.md5(C("text").cast("binary")).alias("h"), "pages")


def _store(s, d):
    """The folders of a store in which files of the glob are, sorted."""
    at = place(s)
    table(s, d, "documents").select("doc_id", "source").write.partitionBy("source").parquet(at)
    return R.listing(s, at, "*.parquet").select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source")).distinct().orderBy("source")


def _sidecar(s, d):
    """Optional nested files beside a manifest, named by whole paths or by paths from the root."""
    at = f"{place(s)}/side"
    name = F.concat(F.lit("s/"), C("doc_id").cast("string"), F.lit(".json"))
    table(s, d, "labels").select(F.concat(F.lit("/root/"), name).alias("path"), F.to_json(F.struct(F.struct("quality", "toxic").alias("layout"))).alias("content")).write.parquet(at)
    manifest = table(s, d, "documents").select("doc_id", F.when(C("doc_id") % 3 == 0, F.concat(F.lit("/root/"), name)).when(C("doc_id") % 3 == 1, name).alias("side"))
    got = J.with_sidecar(manifest, "side", s.read.parquet(at), "/root", "struct<layout:struct<quality:int,toxic:int>>")
    return got.select("doc_id", C("sidecar.layout.quality").alias("quality"))


def _presence(s, d):
    """Which sources have files of either layout."""
    at = place(s)
    docs = table(s, d, "documents").select("doc_id", "source", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("k"))
    for layout, on in (("grid", "k % 3 = 0"), ("sites", "k % 3 = 1")):
        docs.where(on).select("doc_id", "source").write.partitionBy("source").parquet(f"{at}/{layout}")
    listing = R.listing(s, at, "*.parquet").select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("id")).distinct()
    return J.missing(docs.select(C("source").alias("id")).distinct(), listing, "id").select("id")


def _predictions(s, d):
    """Predictions, one text file each, beside the manifest; null where there is no file."""
    at = place(s)
    table(s, d, "nation").where("n_nationkey % 2 = 0").select("n_name", C("n_nationkey").alias("id")).repartition("id").write.partitionBy("id").text(at)
    preds = R.texts(s, at, ".txt").select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("bigint").alias("id"), "text")
    return table(s, d, "nation").select(C("n_nationkey").cast("bigint").alias("id")).join(J.small(preds), "id", "left")


def _atomic(s, d):
    """Two versions of a table and a write cut short: readers see the last whole one."""
    at = place(s)
    docs = table(s, d, "documents").select("doc_id", "lang")
    K.atomic(docs.where("doc_id % 2 = 0"), at)
    K.atomic(docs, at)
    docs.where("doc_id % 3 = 0").write.parquet(f"{at}/_writing-0")
    return K.latest(s, at).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {
    "scan_jsonl": (_jsonl([]), "SELECT doc_id, lang, n_chars FROM documents"),
    "scan_manifest_limit": (lambda s, d: _jsonl(["doc_id", "lang"])(s, d).orderBy("doc_id").limit(20), "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 20"),
    "scan_probes": (_probes, "WITH p AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'pl3_' ELSE 'pl1_' END || lang AS probe, doc_id % 5 = 0 OR doc_id % 7 = 0 AS pooled, CASE WHEN doc_id % 4 = 0 THEN 'own' || doc_id ELSE 'docs/' || source END AS doc, CASE WHEN doc_id % 3 = 0 THEN 1 END AS typed FROM documents) SELECT probe, pooled, count(*) AS n, count(DISTINCT doc) AS docs, count(typed) AS typed FROM p GROUP BY ALL"),
    "scan_features": (_features, _FEATURES_SQL),
    "scan_dir_presence": (_presence, "SELECT DISTINCT source AS id FROM documents WHERE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3 = 2"),
    "scan_json_array": (_array, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "scan_jsonl_gold": (_lenient, "SELECT item_id, text FROM benchmark WHERE item_id % 7 <> 0"),
    "scan_rule_gold": (_rules, "SELECT * FROM (VALUES ('p1', 'a c'), ('p2', 'd')) AS t(pdf, text)"),
    "scan_pdf_gold": (_layers, "SELECT conv_id AS file, md5(string_agg(text, chr(10) ORDER BY turn)) AS h, count(*) AS pages FROM conversations GROUP BY conv_id"),
    "scan_pdf_store": (_store, "SELECT DISTINCT source FROM documents ORDER BY source"),
    "scan_sidecar": (_sidecar, "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN quality END AS quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "scan_site_manifest": (_manifest, "SELECT * FROM (VALUES (1::BIGINT, true), (2::BIGINT, false), (3::BIGINT, false)) AS t(id, manifest)"),
    "scan_report_text": (lambda s, d: REPORT.df(s, d).select("id", F.explode(R.report_files(C("t"))).alias("f")).select("id", "f.name", "f.score", "f.passed", "f.total"), "SELECT * FROM (VALUES (1::BIGINT, 'f1', 50.0::DOUBLE, 5::BIGINT, 10::BIGINT), (1::BIGINT, 'f2', 25.5::DOUBLE, 1::BIGINT, 4::BIGINT)) AS t(id, name, score, passed, total)"),
    "scan_fail_log": (lambda s, d: FAILLOG.df(s, d).select("line", F.regexp_extract("t", R.FAIL_LINE, 1).alias("test"), F.regexp_extract("t", R.FAIL_LINE, 2).alias("reason")).where("test <> ''").groupBy("test").agg(F.min_by("reason", "line").alias("reason")), f"WITH {FAILLOG.cte('f')}, x AS (SELECT line, regexp_extract(t, '{R.FAIL_LINE}', 1) AS test, regexp_extract(t, '{R.FAIL_LINE}', 2) AS reason FROM f) SELECT test, arg_min(reason, line) AS reason FROM x WHERE test <> '' GROUP BY test"),
    "scan_report_json": literal_query(METRICS, _slices, "SELECT id, a AS text, round((a + b + c) / 3 * 100, 4) AS composite FROM (SELECT id, CAST(json_extract_string(t, '$.text.all') AS DOUBLE) AS a, CAST(json_extract_string(t, '$.table.all') AS DOUBLE) AS b, CAST(json_extract_string(t, '$.math.all') AS DOUBLE) AS c FROM f)"),
    "scan_binary_header": (_headers, "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS sha, length(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS bytes, upper(hex(substr(min(r_name), 1, 2))) AS magic FROM region"),
    "scan_volume_text": (_volume, "SELECT count(*) AS n FROM region"),
    "scan_pred_dir": (_predictions, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || chr(10) END AS text FROM nation"),
    "sink_jsonl": (_lines, """SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS line FROM documents"""),
    "sink_csv": (_csv, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "sink_split_dataset": (_split, "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "sink_atomic": (_atomic, "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "sink_upsert": (lambda s, d: K.upsert(OLD.df(s, d), NEW.df(s, d), "rung"), f"WITH {OLD.cte('o')}, {NEW.cte('n')} SELECT rung, coalesce(n.n, o.n) AS n, note FROM o FULL JOIN n USING (rung)"),
    "sink_errors": (_errors, "SELECT count(*) FILTER (WHERE n_chars > 0) AS good, count(*) FILTER (WHERE NOT coalesce(n_chars > 0, false)) AS bad FROM documents"),
    "sink_skipped": literal_query(SKIPS, _skip, "SELECT id, CASE WHEN test IS NULL THEN 'missing_test_json' WHEN gold IS NULL THEN 'no_gold_markdown' WHEN rules = 0 THEN 'no_chart_rules' END AS reason FROM f"),
    "sink_log_chunks": (lambda s, d: table(s, d, "pages").select("page_id", F.explode(K.chunks(C("html"))).alias("c")).select("page_id", "c.seq", F.md5(C("c.part").cast("binary")).alias("h")), "SELECT page_id, i::INTEGER AS seq, md5(substr(b, i * 3000 + 1, 3000)) AS h FROM (SELECT page_id, base64(encode(html)) AS b FROM pages), unnest(range(0, greatest(1, CAST(ceil(length(b) / 3000) AS BIGINT)))) AS t(i)"),
    "sink_markdown": (lambda s, d: s.sql("SELECT 1 AS one").select(F.lit(K.markdown(table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))).alias("md")), "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS md FROM region"),
    "sink_report_json": (lambda s, d: s.sql("SELECT 1 AS one").select(F.lit(K.report_json(table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))).alias("report")), """SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_name": "' || r_name || '",' || chr(10) || '    "r_regionkey": ' || r_regionkey || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS report FROM region"""),
    "incremental_batch": (_incremental, "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id"),
}

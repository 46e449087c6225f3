"""Sources and sinks on the given tables."""

from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.plans.registry import query
from tidewatch.plans.views import OBS, VECTORS, observations, vectors
from tidewatch.sources import files
from tidewatch.sources.tables import table


@query("io1_csv_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS obs_id, o_custkey AS source_id, o_totalprice AS rate,
  o_orderstatus = 'F' AS included FROM orders""")
def io1(spark, sf):
    path = files.scratch(spark, "csv")
    o = table(spark, sf, "orders")
    out = o.select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("source_id"), F.col("o_totalprice").alias("rate"),
                   F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("included"))
    out.write.csv(path, header=True)
    return files.read_table(spark, path, "obs_id string, source_id bigint, rate double, included string", ["included"])


@query("io2_spaced_text_scan", "SELECT p_partkey AS part, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part")
def io2(spark, sf):
    path = files.scratch(spark, "txt")
    p = table(spark, sf, "part")
    p.select(F.concat(F.lit("  "), F.concat_ws("   ", "p_partkey", "p_brand", "p_size", "p_retailprice")).alias("value")).write.text(path)
    return files.read_spaced(spark, path, {"part": "bigint", "brand": "string", "size": "int", "price": "double"})


@query("io3_json_lines", """SELECT doc_id, lang, n_chars, CASE WHEN quality = 1 THEN 'ok' ELSE 'failed' END AS status
  FROM documents JOIN labels USING (doc_id)""")
def io3(spark, sf):
    path = files.scratch(spark, "jsonl")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", "lang", "n_chars", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    files.append_json(d.where("status = 'ok'"), path)
    files.append_json(d.where("status <> 'ok'"), path)
    return files.read_json(spark, path, "doc_id bigint, lang string, n_chars bigint, status string")


@query("io4_union_tagged", f"""WITH {OBS}, u AS (SELECT *, 'first' AS sample, 0 AS prio FROM obs WHERE rate > 250000
  UNION ALL SELECT *, 'second', 1 FROM obs WHERE status = 'F' UNION ALL SELECT *, 'third', 2 FROM obs WHERE mjd < 51000)
  SELECT obs_id, source_id, rate, sample FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY prio) AS rn FROM u) WHERE rn = 1""")
def io4(spark, sf):
    o = observations(spark, sf)
    frames = {"first": o.where("rate > 250000"), "second": o.where("status = 'F'"), "third": o.where("mjd < 51000")}
    return files.union_tagged(frames, ["obs_id"]).select("obs_id", "source_id", "rate", "sample")


@query("io5_content_manifest", "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def io5(spark, sf):
    return files.manifest(table(spark, sf, "documents"), ["doc_id"], "text")


@query("io5_page_manifest", "SELECT page_id, url, octet_length(encode(html))::BIGINT AS bytes, sha256(html) AS sha256 FROM pages")
def io5b(spark, sf):
    return files.manifest(table(spark, sf, "pages"), ["page_id", "url"], "html")


_LOG = """log AS (SELECT user_id AS source_id, ts AS logged, event_type AS status FROM events),
  latest AS (SELECT source_id, arg_max(status, logged) AS status FROM log GROUP BY 1)"""


@query("io6_pending_work", f"""WITH {_LOG} SELECT c_custkey AS source_id, c_mktsegment AS segment FROM customer
  WHERE c_custkey NOT IN (SELECT source_id FROM latest WHERE status <> 'error')""")
def io6(spark, sf):
    work = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("segment"))
    done = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), "ts", "event_type")
    return files.pending(work, done, ["source_id"], at="ts", ok=F.col("event_type") != "error")


@query("io7_vector_table", f"""WITH {VECTORS} SELECT vec_id, label, count(*) AS n_bins, round(sum(x), 6) AS total,
  round(max(CASE WHEN bin = 17 THEN x END), 9) AS x17 FROM vec GROUP BY 1, 2""")
def io7(spark, sf):
    path = files.write_vectors(vectors(spark, sf).select("vec_id", "label", "x"), files.scratch(spark, "vectors"), ["label"])
    keys = table(spark, sf, "embeddings").select("vec_id")
    d = spark.read.schema("vec_id bigint, x array<double>, label int").parquet(path).join(keys, "vec_id")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return d.select("vec_id", "label", F.size("x").cast("long").alias("n_bins"), F.round(total, 6).alias("total"),
                    F.round(F.element_at("x", 17), 9).alias("x17"))


@query("io8_lookup_filter", """SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN
  (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))""")
def io8(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return files.found_only(s, table(spark, sf, "nation"), "n_nationkey", F.col("n_regionkey").isin(1, 3)).select("s_suppkey", "s_name")


@query("io9_interval_report", """SELECT l_suppkey AS source_id, l_returnflag AS stratum,
  printf('%.3f [%.3f,%.3f]', quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.16), quantile_cont(l_quantity, 0.84)) AS report
  FROM lineitem GROUP BY 1, 2""")
def io9(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("stratum"), "l_quantity")
    p = ordered.percentiles(li, ["source_id", "stratum"], "l_quantity", {"mid": 0.5, "low": 0.16, "high": 0.84})
    return p.select("source_id", "stratum", files.interval_text("mid", "low", "high").alias("report"))

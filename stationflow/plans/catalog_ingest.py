"""Queries over raw files, naming, typing, file choice and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import numbers as N, text as X, times as D
from ..operators import cleaning as C, experiments as R, profiles as P, series as Q
from ..session import shared_dir
from ..sources import features as SF, raw, records, sinks, streams
from .registry import query
from .views import FEAT, WH, WX, WX_MEASURES, features, now, rounded, rr, sr, table, wh, wx

WX_ALL = f"WITH {WX} SELECT municipio, data_hora, {sr(*WX_MEASURES)} FROM wx"


def _raw_dir(spark, sf):
    root = shared_dir(spark, "raw-files")
    sinks.write_raw_station_files(wx(spark, sf), root)
    return root


RAW_NAMES = {v: k for k, v in S.RENAME_MAP.items()}


def _folder(path, name):
    return F.regexp_extract(path, name + "=([^/]+)", 1)


@query(WX_ALL)
def read_station_csv(spark, sf):
    rows = raw.read_station_csv(spark, _raw_dir(spark, sf))
    rows = rows.withColumn("municipio", _folder(F.col("path"), "municipio")).drop("path")
    return rounded(C.clean(rows).select("municipio", "data_hora", *WX_MEASURES), *WX_MEASURES)


@query(f"WITH {WX} SELECT municipio, count(*) AS n, {sr('sum(temp_ar_c) AS total', digits=3)} FROM wx GROUP BY 1")
def read_many_stations(spark, sf):
    root = _raw_dir(spark, sf)
    paths = [f"{root}/municipio=st_{i}" for i in range(3)]
    cols = [S.RAW_DATE, S.RAW_HOUR, RAW_NAMES["temp_ar_c"]]
    rows = raw.read_station_csv(spark, paths, cols)
    rows = rows.withColumn("municipio", _folder(F.col("path"), "municipio")).drop("path")
    out = C.clean(rows).groupBy("municipio").agg(F.count(F.lit(1)).alias("n"), F.sum("temp_ar_c").alias("total"))
    return rounded(out, "total", digits=3)


STATION_NAME = "'INMET_S_RS_A' || CAST(c_custkey AS VARCHAR) || '_' || c_mktsegment || ' do Sul_01-01-2026_A_31-03-2026.CSV'"


def _station_names(spark, sf):
    c = table(spark, sf, "customer")
    good = F.concat(
        F.lit("INMET_S_RS_A"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_mktsegment"),
        F.lit(" do Sul_01-01-2026_A_31-03-2026.CSV"),
    )
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(".csv"))).otherwise(good)
    return c.select("c_custkey", name.alias("name"), F.concat(F.lit("/raw/"), name).alias("path"))


def _renamed(spark, root, pattern, name):
    """Give the files that Spark has written below a folder names of their own; a file for each station and year."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for r in raw.list_files(spark, root, pattern).select("path").collect():
        new = path(name(dict(p.split("=") for p in r.path.split("/") if "=" in p)))
        fs.mkdirs(new.getParent())
        fs.rename(path(r.path), new)


@query(f"""WITH {WX} SELECT municipio, upper(municipio) AS original, count(DISTINCT year(data_hora)) AS n_files, count(*) AS n_rows
FROM wx GROUP BY 1, 2""")
def discover_station_files(spark, sf):
    """A folder of station files and others; those that are found are read."""
    root, out = _raw_dir(spark, sf), shared_dir(spark, "stations")
    _renamed(spark, root, "*.txt", lambda p: (
        f"{out}/{p['ano']}/INMET_S_RS_A801_{p['municipio'].upper()}_01-01-{p['ano']}_A_31-12-{p['ano']}.CSV"))
    spark.range(1).select(F.lit("a;b").alias("value")).write.text(f"{out}/other")
    _renamed(spark, f"{out}/other", "*.txt", lambda p: f"{out}/other/notes.csv")
    found = raw.discover_station_files(spark, out)
    cols = [S.RAW_DATE, S.RAW_HOUR]
    rows = raw.read_station_csv(spark, [r.path for r in found.select("path").collect()], cols)
    n = rows.groupBy("municipio").agg(F.count(F.lit(1)).alias("n_rows"))
    return found.groupBy("municipio", "original").agg(F.count("path").alias("n_files")).join(n, "municipio")


@query(f"""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || '.csv' ELSE {STATION_NAME} END AS name FROM customer),
p AS (SELECT *, regexp_extract(name, '^INMET_[^_]+_[^_]+_[A-Z0-9]+_(.+?)_\\d{{2}}-\\d{{2}}-\\d{{4}}_A_\\d{{2}}-\\d{{2}}-\\d{{4}}\\.csv$', 1, 'i') AS o FROM f)
SELECT c_custkey, nullif(o, '') AS original, nullif(regexp_replace(lower(o), '[^a-z0-9]+', '_', 'g'), '') AS slug FROM p""")
def parse_station_filename(spark, sf):
    parsed = X.parse_station_filename("name")
    return _station_names(spark, sf).select("c_custkey", parsed["original"].alias("original"), parsed["slug"].alias("slug"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text || ' fino No7 XII Abc (3)')), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
FROM documents""")
def slugify(spark, sf):
    # whole texts, and signs that stand for several letters or lie beyond the first plane
    text = F.concat("text", F.lit(" \ufb01no \u21167 \u216b \U0001d400bc \u2476"))
    return table(spark, sf, "documents").select("doc_id", X.slugify(text).alias("slug"))


@query("""SELECT t AS term, count(doc_id) AS n_files FROM (VALUES ('SRC1'), ('src2'), ('nothing')) AS k(t)
LEFT JOIN documents ON contains(lower(source), lower(t)) GROUP BY 1""")
def match_terms(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("path"))
    return C.match_terms(d, ["SRC1", "src2", "nothing"]).groupBy("term").agg(F.count("path").alias("n_files"))


@query(f"""WITH {WX} SELECT municipio, count(*) AS n FROM wx WHERE municipio NOT LIKE '%2' GROUP BY 1""")
def discover_staging_files(spark, sf):
    """CSV files named like their folder, but for some stations; those that are found are read."""
    root, out = shared_dir(spark, "csv"), shared_dir(spark, "staging-files")
    rows = wx(spark, sf).select("municipio", "data_hora", "temp_ar_c")
    rows.repartition("municipio").write.partitionBy("municipio").option("header", "true").csv(root)
    _renamed(spark, root, "*.csv", lambda p: (
        f"{out}/{p['municipio']}/{'other' if p['municipio'].endswith('2') else p['municipio']}.csv"))
    paths = [r.path for r in raw.discover_staging_files(spark, out).select("path").collect()]
    lines = spark.read.option("header", "true").csv(paths).select(F.col("_metadata.file_path").alias("path"))
    return raw.staging_files(lines).groupBy("municipio").agg(F.count(F.lit(1)).alias("n"))


@query(WX_ALL)
def write_and_read_staging(spark, sf):
    root = shared_dir(spark, "staging")
    sinks.write_staging(wx(spark, sf), root)
    out = raw.read_staging(spark, root)
    return rounded(out.select("municipio", "data_hora", *WX_MEASURES), *WX_MEASURES)


@query(f"WITH {WX} SELECT municipio, data_hora, CASE WHEN municipio = 'st_1' THEN 1.5 ELSE {sr('temp_ar_c AS x').rpartition(' AS ')[0]} END AS temp_ar_c FROM wx")
def versioned_staging(spark, sf):
    """One station replaced by a new version of the table."""
    root = shared_dir(spark, "staging")
    rows = wx(spark, sf).select("municipio", "data_hora", "temp_ar_c")
    sinks.write_staging(rows, root, fmt="snapshot")
    sinks.write_staging(rows.where("municipio = 'st_1'").withColumn("temp_ar_c", F.lit(1.5)), root, fmt="snapshot")
    return rounded(raw.read_staging(spark, root, "snapshot").select("municipio", "data_hora", "temp_ar_c"), "temp_ar_c")


@query(f"WITH {FEAT} SELECT municipio, data_hora, {sr(*S.FEATURE_COLUMNS)} FROM feat")
def read_features(spark, sf):
    root = shared_dir(spark, "features")
    sinks.write_features(features(spark, sf), root)
    out = SF.read_features(spark, root)
    return rounded(out.select("municipio", "data_hora", *S.FEATURE_COLUMNS), *S.FEATURE_COLUMNS)


@query(f"WITH {FEAT} SELECT municipio, count(*) AS rows_processed, 14 AS n_columns FROM feat GROUP BY 1")
def write_features(spark, sf):
    out = sinks.write_features(features(spark, sf), shared_dir(spark, "features"))
    return out.select("municipio", "rows_processed", F.size(F.split("columns", ",")).alias("n_columns"))


@query(f"""WITH {WX}, k AS (SELECT * FROM wx WHERE umidade_rel_ar_percent IS NOT NULL AND hour(data_hora) <> 5)
SELECT municipio, data_hora, {sr('temp_ar_c', 'umidade_rel_ar_percent')}, 'station_1' AS "group",
row_number() OVER (PARTITION BY municipio ORDER BY data_hora) - 1 AS time_idx, 'vento_vel_ms' AS missing FROM k""")
def read_serving(spark, sf):
    odd = wx(spark, sf).withColumn(
        "temp_ar_c", F.when(F.hour("data_hora") == 5, float("inf")).otherwise(F.col("temp_ar_c"))
    )
    # the folder itself holds no data: the first one below it is served, the other not
    root = shared_dir(spark, "serving")
    odd.write.partitionBy("municipio").parquet(f"{root}/h072")
    odd.where("municipio = 'st_1'").write.parquet(f"{root}/h168")
    out, missing = SF.read_serving(spark, root, ["temp_ar_c", "umidade_rel_ar_percent", "vento_vel_ms"], f"{root}/no-models")
    return rounded(out, "temp_ar_c", "umidade_rel_ar_percent").withColumn("missing", F.lit(",".join(missing)))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'weather_forecasting' END AS experiment_name,
CASE WHEN s_suppkey % 3 = 0 THEN 168 ELSE 24 END AS sequence_length, CASE WHEN s_suppkey % 3 = 0 THEN 72 ELSE 1 END AS horizon,
0.8::DOUBLE AS train_ratio, CASE WHEN s_suppkey % 5 = 0 THEN 'xgboost' ELSE 'lstm' END AS model_type, 50 AS epochs, 'medium' AS risk_level, 14 AS n_features,
CASE WHEN s_suppkey % 5 = 0 THEN 'model.model_type is xgboost, not one of lstm, transformer, tft, nbeats' END AS problem FROM supplier""")
def read_experiments(spark, sf):
    """A JSON file for each hundred suppliers."""
    s = table(spark, sf, "supplier")
    even, third, fifth = (F.col("s_suppkey") % n == 0 for n in (2, 3, 5))
    text = F.to_json(
        F.struct(
            F.when(even, F.col("s_name")).alias("experiment_name"), F.col("s_suppkey").cast("string").alias("run_name"),
            F.when(third, F.struct(F.lit(168).alias("sequence_length"), F.lit(72).alias("horizon"))).alias("data"),
            F.when(fifth, F.struct(F.lit("xgboost").alias("model_type"))).alias("model"),
        )
    )
    root = shared_dir(spark, "experiments")
    file = F.floor(F.col("s_suppkey") / 100).alias("file")
    files = s.groupBy(file).agg(F.collect_list(text).alias("t"))
    files.select("file", F.concat(F.lit("["), F.array_join("t", ","), F.lit("]")).alias("value")).write.partitionBy("file").text(root)
    out = records.read_experiments(spark, root, invalid="mark", glob="*.txt")
    return out.select(
        F.col("run_name").cast("bigint").alias("s_suppkey"), "experiment_name", "data.sequence_length", "data.horizon",
        "data.train_ratio", "model.model_type", "epochs", "governance.risk_level",
        F.size("data.feature_columns").alias("n_features"), "problem",
    )


@query("""SELECT s_suppkey, k AS key, v AS value FROM (SELECT s_suppkey,
 unnest(['experiment_name', 'data.sequence_length', 'data.shuffle', 'data.targets']) AS k,
 unnest([s_name, CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END, '[''a'', ''b'']']) AS v FROM supplier)""")
def flatten_config(spark, sf):
    s = table(spark, sf, "supplier")
    nested = s.select(
        F.struct(
            F.col("s_name").alias("experiment_name"),
            F.struct(
                F.col("s_suppkey").alias("sequence_length"), (F.col("s_suppkey") % 2 == 0).alias("shuffle"),
                F.array(F.lit("a"), F.lit("b")).alias("targets"), F.lit(None).cast("int").alias("limit"),
            ).alias("data"),
            F.struct(F.lit("x").alias("owner")).alias("governance"),
        ).alias("c"), "s_suppkey",
    ).select("c.*", F.col("s_suppkey").alias("__k"))
    flat = R.flatten_config(nested.drop("__k").withColumn("s_suppkey", F.col("data.sequence_length")))
    return flat.select("s_suppkey", F.explode("params")).where("key <> 's_suppkey'")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'unknown' END AS owner,
CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS fairness_checked FROM orders""")
def resolve_governance(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, F.lit("  ")).alias("config_owner"),
        F.when(k % 3 == 1, F.concat(F.lit("'"), "o_orderstatus", F.lit("' "))).when(k % 3 == 2, F.lit('""')).alias("env_owner"),
        (k % 2 == 0).alias("fair"),
    )
    out = R.resolve_governance(o, {"owner": ["config_owner", "env_owner"], "fairness_checked": ["fair"]})
    return out.select("o_orderkey", "owner", "fairness_checked")


@query("""SELECT l_orderkey, l_partkey, l_linenumber,
CASE l_linenumber WHEN 1 THEN 'int' WHEN 2 THEN 'float' WHEN 3 THEN 'bool' WHEN 4 THEN 'list' WHEN 5 THEN 'map' WHEN 6 THEN 'int' ELSE 'text' END AS kind,
CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS DOUBLE) END AS int_value,
CASE l_linenumber WHEN 2 THEN l_extendedprice END AS float_value,
CASE l_linenumber WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END END AS bool_value,
CASE l_linenumber WHEN 4 THEN l_returnflag || ',' || l_linestatus || '|' || CAST(l_partkey AS VARCHAR) || '|[1, [2.5, true]]' END AS list_value,
CASE WHEN l_linenumber > 6 THEN l_returnflag || 'x' END AS text_value,
CASE l_linenumber WHEN 5 THEN '{"a": [' || CAST(l_partkey AS VARCHAR) || ', null], "1": "' || l_returnflag || '"}'
 WHEN 6 THEN '7' || CAST(l_partkey AS VARCHAR) || '00000000000000000000' END AS json_value FROM lineitem""")
def parse_param(spark, sf):
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit(" "), F.col("l_partkey").cast("string")))
        .when(n == 2, F.col("l_extendedprice").cast("string"))
        .when(n == 3, F.when(F.col("l_partkey") % 2 == 0, F.lit("True")).otherwise(F.lit("FALSE")))
        .when(n == 4, F.concat(F.lit("('"), "l_returnflag", F.lit(","), "l_linestatus", F.lit("', "), F.col("l_partkey").cast("string"), F.lit(", [1, [2.5, True]])")))
        .when(n == 5, F.concat(F.lit("{'a': ["), F.col("l_partkey").cast("string"), F.lit(", None], 1: '"), "l_returnflag", F.lit("'}")))
        .when(n == 6, F.concat(F.lit("7"), F.col("l_partkey").cast("string"), F.lit("0" * 20)))
        .otherwise(F.concat("l_returnflag", F.lit("x")))
    )
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", N.parse_param(text).alias("p"))
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "p.kind", F.col("p.int_value").cast("double").alias("int_value"),
        "p.float_value", F.col("p.bool_value").cast("string").alias("bool_value"),
        F.array_join("p.list_value", "|").alias("list_value"), "p.text_value",
        F.when(n.isin(5, 6), F.col("p.json_value")).alias("json_value"),
    )


@query("""SELECT y AS year, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(1994, 2003)) AS y)
LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1""")
def year_range(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey")
    return raw.year_range(spark, 1994, 2003).join(o, "year", "left").groupBy("year").agg(F.count("o_orderkey").alias("n"))


@query(f"""WITH {WX} SELECT municipio || '.zip' AS archive, n AS name, sha256(c) AS content, CAST(ceil(length(c) / 100.0) AS BIGINT) AS parts FROM (
 SELECT municipio, unnest(['data.csv', 'data_1.csv']) AS n, unnest([repeat('x' || chr(10), count(*)), repeat('xy' || chr(10), count(*))]) AS c FROM wx GROUP BY 1)""")
def expand_archives(spark, sf):
    """An archive for each station, read back in parts of 100 bytes."""
    import io
    import zipfile

    import pandas as pd

    root = shared_dir(spark, "zips")

    def pack(batches):
        for pdf in batches:
            for n, station in zip(pdf["n"], pdf["municipio"]):
                blob = io.BytesIO()
                with zipfile.ZipFile(blob, "w") as z:
                    z.writestr("a/data.csv", "x\n" * n)
                    z.writestr("b/data.csv", "xy\n" * n)
                    z.writestr("readme.txt", "no table")
                with streams.create_file(f"{root}/{station}.zip") as f:
                    f.write(blob.getvalue())
            yield pd.DataFrame({"done": pdf["n"]})

    sizes = wx(spark, sf).groupBy("municipio").agg(F.count(F.lit(1)).alias("n"))
    sizes.mapInPandas(pack, "done bigint").agg(F.sum("done")).collect()
    parts = raw.expand_archives(spark, root, 100).withColumn("archive", X.file_name("archive"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", F.decode("content", "utf-8").alias("t")))), lambda p: p["t"]), "")
    return parts.groupBy("archive", "name").agg(F.sha2(text, 256).alias("content"), F.count(F.lit(1)).alias("parts"))


LINKS = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*"[^"]+"[^>]*>.*?</a\\s*>')) AS l,
 generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*"[^"]+"[^>]*>.*?</a\\s*>'), 1) - 1 AS position FROM pages),
k AS (SELECT page_id, url, position, regexp_extract(l, 'href\\s*=\\s*"([^"]+)"', 1) AS href,
 trim(regexp_replace(regexp_replace(l, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM l)"""


@query(f"""WITH {LINKS} SELECT page_id, position, href, text FROM k""")
def page_links(spark, sf):
    links = raw.page_links(table(spark, sf, "pages"))
    return links.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


# Each page gets links that a parser must read with care, their parts taken from the page.
ARCHIVES = """a AS (SELECT page_id, url, CAST(page_id % 3 AS INTEGER) AS k FROM pages),
o AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
 regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM a)"""


@query(f"""WITH {ARCHIVES} SELECT page_id, 2024 AS year, CASE k WHEN 0 THEN 10 WHEN 1 THEN 10 ELSE 6 END AS score,
CASE k WHEN 0 THEN origin || '/z/2024.zip' WHEN 1 THEN origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'a&b.zip?y=2024'
 ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'first.zip' END AS url FROM o
UNION ALL SELECT page_id, 2025, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 6 END,
CASE k WHEN 0 THEN origin || '/z/2024.zip' WHEN 1 THEN origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'a&b.zip?y=2024'
 ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'second2025.zip' END FROM o""")
def pick_archive_links(spark, sf):
    pages = table(spark, sf, "pages")
    k = F.col("page_id") % 3
    added = (
        F.when(k == 0, '<a data-href="bad.zip" href="/q/../z/./2024.zip" title="2 > 1">Data of 2024</a>')
        .when(k == 1, "<a href='a&amp;b.zip?y=2024'>Year&nbsp;2024 &#38; more</a>")
        .otherwise('<a href="first.zip">2024</a><a href=second2025.zip>all</a>')
    )
    html = F.regexp_replace("html", r"(?i)\.zip", ".tar")
    return raw.pick_archive_links(pages.withColumn("html", F.concat(html, added)), [2024, 2025], required=False)


@query("""SELECT user_input, response, reference, n_contexts FROM (SELECT text AS user_input, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS response,
'' AS reference, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n_contexts FROM conversations)""")
def read_eval_set(spark, sf):
    path = shared_dir(spark, "eval-set")
    c = table(spark, sf, "conversations").select(
        F.col("text").alias("user_input"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("response"),
        F.when(F.col("turn") % 3 == 0, F.array("role")).alias("retrieved_contexts"),
    )
    c.write.json(path)
    out = records.read_eval_set(spark, path)
    return out.select("user_input", "response", "reference", F.size("retrieved_contexts").alias("n_contexts"))


@query("""SELECT doc_id, l AS text FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(160)) AS l FROM documents) WHERE l <> ''""")
def read_text_lines(spark, sf):
    return records.text_lines(table(spark, sf, "documents"), "text", ["doc_id"])


@query("""WITH l AS (SELECT source, doc_id, doc_id // 100 AS block, doc_id || ',' || lang || ',' || n_chars || ',' || text || chr(10) AS line FROM documents)
SELECT source, block, CAST(sum(strlen(line)) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY doc_id)) AS sha256 FROM l GROUP BY 1, 2""")
def file_fingerprint(spark, sf):
    """Whole rows of the documents, a file for each source and hundred ids: a hot source is many files."""
    root = shared_dir(spark, "rows")
    line = F.concat_ws(",", "doc_id", "lang", "n_chars", "text")
    d = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("block"), "doc_id", line.alias("value"))
    streams.write_lines(d, root, ["source", "block"], ["doc_id"])
    out = SF.file_fingerprint(spark, root, [".txt"])
    source = F.url_decode(F.nullif(_folder(F.col("path"), "source"), F.lit(streams.NO_VALUE)))
    return out.select(source.alias("source"), _folder(F.col("path"), "block").cast("bigint").alias("block"), "length", "sha256")


@query("""SELECT 'src3' AS preferred, '/spec/' || source || '/' || CAST(doc_id AS VARCHAR) || '.parquet' AS path, n_chars AS length, 0 AS level
FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, path LIMIT 1""")
def pick_serving_file(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/spec/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".parquet"))
    files = d.select(path.alias("path"), F.col("n_chars").alias("length"))
    return SF.pick_serving_file(files, "src3").withColumn("preferred", F.lit("src3"))


@query("SELECT event_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS stamp FROM events")
def combine_date_hour(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy/MM/dd").alias(S.RAW_DATE),
        F.concat(F.date_format("ts", "HHmm"), F.lit(" UTC")).alias(S.RAW_HOUR),
    )
    return C.combine_date_hour(e, out="stamp")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_extendedprice END AS price, l_discount AS discount FROM lineitem""")
def parse_decimals(spark, sf):
    price = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    odd = F.when(F.col("l_linenumber") == 2, F.lit("-")).when(F.col("l_linenumber") == 3, F.concat(price, F.lit("d"))).otherwise(price)
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", odd.alias("price"), F.col("l_discount").cast("string").alias("discount")
    )
    return C.parse_decimals(li)


@query("SELECT n_nationkey AS id, n_name AS municipio, n_regionkey FROM nation")
def rename_columns(spark, sf):
    return C.rename_columns(table(spark, sf, "nation"), {"n_nationkey": "id", "n_name": "municipio", "absent": "x"})


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def drop_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.drop(*[c for c in li.columns if c not in ("l_orderkey", "l_partkey", "l_quantity")])


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) THEN 'merged' ELSE 'n' || CAST(c_nationkey AS VARCHAR) END AS municipio FROM customer)
SELECT * FROM c WHERE municipio IN ('merged', 'n3', 'n4') AND municipio NOT IN ('n4')""")
def filter_stations(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("municipio")
    )
    return C.filter_stations(c, ["merged", "n3", "n4"], ["n4"], {"n1": "merged", "n2": "merged"})


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
WHEN 2 THEN date_trunc('minute', ts) END AS instant FROM events""")
def parse_instant(spark, sf):
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format("ts", " yyyy-MM-dd "))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
        .otherwise(F.concat(F.lit("not a time "), F.col("event_id").cast("string")))
    )
    return table(spark, sf, "events").select("event_id", D.parse_instant(text).alias("instant"))


@query("""SELECT event_id, CASE WHEN (SELECT max(event_id) FROM events) = (SELECT max(event_id) FROM events WHERE event_type IS NOT NULL)
THEN 'late' END AS time_column FROM events""")
def resolve_time_column(spark, sf):
    # "early" is readable in all rows but one, "late" in all: only the whole column tells
    e = table(spark, sf, "events")
    last = e.agg(F.max("event_id").alias("last"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = e.join(last, F.col("event_id") <= F.col("last")).select(
        "event_id", F.when(F.col("event_id") < F.col("last"), stamp).otherwise("no time").alias("early"), stamp.alias("late")
    )
    return e.select("event_id", F.lit(C.resolve_time_column(rows)).alias("time_column"))


@query("""SELECT o_orderkey, ['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(o_orderdate)] AS mes_nome,
CASE (o_orderkey % 4 + 1) * 72 WHEN 72 THEN '3 dias' ELSE CAST((o_orderkey % 4 + 1) * 72 AS VARCHAR) || 'h' END AS horizon_label FROM orders""")
def label_lookup(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.month_label(F.month("o_orderdate")).alias("mes_nome"),
        X.horizon_label((F.col("o_orderkey") % 4 + 1) * 72).alias("horizon_label"),
    )


def _two(x):
    return f"CAST(printf('%.2f', {x}) AS DOUBLE) + 0.0"


@query(f"""WITH {WH}, p AS (SELECT municipio, month(data_hora) AS m, avg(temp_ar_c) AS mean, stddev_samp(temp_ar_c) AS std, min(temp_ar_c) AS low,
 max(temp_ar_c) AS high, quantile_cont(temp_ar_c, 0.05) AS a, quantile_cont(temp_ar_c, 0.95) AS z FROM wh GROUP BY 1, 2),
e AS (SELECT municipio, count(*) AS n, strftime(max(data_hora), '%Y-%m-%d') AS last FROM wh GROUP BY 1)
SELECT municipio, CAST(m AS VARCHAR) AS month, {_two('mean')} AS mean, {_two('std')} AS std, {_two('low')} AS min, {_two('high')} AS max,
 {_two('a')} AS p5, {_two('z')} AS p95, n AS row_count, last AS date_end FROM p JOIN e USING (municipio)""")
def write_profiles(spark, sf):
    w = wh(spark, sf)
    root = shared_dir(spark, "profiles")
    cols = ["temp_ar_c"]
    sinks.write_profiles(P.monthly_profiles(w, cols), P.seasonal_extremes(w, cols), P.snapshot_metadata(w, now(), cols), root)

    def months(name, fields):
        kind = f"map<string,map<string,struct<{','.join(f + ':double' for f in fields)}>>>"
        rows = spark.read.text(f"{root}/{name}").select("municipio", F.explode(F.from_json("value", kind)).alias("month", "c"))
        return rows.select("municipio", "month", *[F.element_at("c", "temp_ar_c")[f].alias(f) for f in fields])

    meta = spark.read.text(f"{root}/metadata").select(
        "municipio", F.get_json_object("value", "$.row_count").cast("bigint").alias("row_count"),
        F.substring(F.get_json_object("value", "$.date_end"), 1, 10).alias("date_end"),
    )
    both = months("monthly_profiles", ["mean", "std", "min", "max"]).join(months("seasonal_extremes", ["p5", "p95"]), ["municipio", "month"])
    return both.join(meta, "municipio")


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, printf('%.4f', round(avg({c}), 8)) AS score FROM lineitem"
                          for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def write_scores(spark, sf):
    from ..operators.eda import score_rollup

    path = shared_dir(spark, "scores")
    sinks.write_scores(score_rollup(table(spark, sf, "lineitem")), path, "20240125T000000Z")
    return spark.read.option("header", "true").csv(f"{path}/results_20240125T000000Z_csv")

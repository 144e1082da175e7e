"""Queries over messages, snippets and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import numbers as N, text as X
from ..operators import retrieval as V, vector_index as I
from ..session import shared_dir
from .registry import query
from .views import rounded, rr, sr, table


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _spaces(p: str) -> str:
    """Blanks as the checked text may hold them."""
    return p.replace(r"[-\s]", r"(?:-|\s)").replace(r"\s", r"[\s\x{00a0}]")


def _any(col, patterns, flags=""):
    return "(" + " OR ".join(f"regexp_matches({col}, {_lit(flags + _spaces(p))})" for p in patterns) + ")"


def _first_reason(col, patterns, template):
    return " ".join(
        f"WHEN regexp_matches({col}, {_lit('(?i)' + _spaces(p))}) THEN {_lit(template.format(p[:60]))}" for p in patterns
    )


PII = [X.CPF_PATTERN, X.EMAIL_PATTERN, X.PHONE_PATTERN]


def _threat(col):
    return (
        f"CASE WHEN {_any(col, X.INJECTION_PATTERNS, '(?i)')} THEN 'prompt_injection' "
        f"WHEN {_any(col, X.EXFILTRATION_PATTERNS, '(?i)')} THEN 'exfiltration' WHEN {_any(col, PII)} THEN 'pii' END"
    )


def _reason(col):
    return (
        f"CASE {_first_reason(col, X.INJECTION_PATTERNS, X.INJECTION_REASON)} "
        f"{_first_reason(col, X.EXFILTRATION_PATTERNS, X.EXFILTRATION_REASON)} "
        f"WHEN {_any(col, PII)} THEN {_lit(X.PII_REASON)} ELSE '' END"
    )


@query(f"""SELECT doc_id, {_threat('text')} IS NULL AS passed, {_threat('text')} AS threat_type, {_reason('text')} AS reason FROM documents""")
def check_input(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.check_input("text").alias("g")).select("doc_id", "g.*")


@query(f"""SELECT conv_id, turn, {_threat('text')} AS threat_type FROM conversations WHERE role = 'user'""")
def check_input_turns(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", X.check_input("text")["threat_type"].alias("threat_type"))


@query("SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, {_lit(_spaces(p))})) AS {n}" for n, p in zip(("cpf", "email", "phone"), PII)) + " FROM documents")
def detect_pii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.detect_pii("text").alias("p")).select("doc_id", "p.*")


MIXED = """m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN text || ' Períodos do dia: manhã' WHEN 1 THEN 'Regras para escolha de tool ' || text
WHEN 2 THEN text || ' AIza' || repeat('a', 35) ELSE text END AS text FROM conversations WHERE role = 'assistant')"""


LEAKS = "".join(
    f" WHEN contains(text, {_lit(lit)}) THEN ['system_leak', {_lit(X.SYSTEM_REASON.format(lit))}]" for lit in X.SYSTEM_LITERALS
) + f" WHEN regexp_matches(text, {_lit(X.API_KEY_PATTERN)}) THEN ['api_key_leak', {_lit(X.API_KEY_REASON)}]"


@query(f"""WITH {MIXED}, t AS (SELECT conv_id, turn, CASE {LEAKS} END AS hit FROM m)
SELECT conv_id, turn, hit IS NULL AS passed, hit[1] AS threat_type, coalesce(hit[2], '') AS reason FROM t""")
def check_output(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = (
        F.when(k == 0, F.concat("text", F.lit(" Períodos do dia: manhã")))
        .when(k == 1, F.concat(F.lit("Regras para escolha de tool "), "text"))
        .when(k == 2, F.concat("text", F.lit(" AIza" + "a" * 35))).otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", X.check_output(text).alias("g")).select("conv_id", "turn", "g.*")


STRIPPED = r"trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE {STRIPPED} END AS text FROM documents),
t AS (SELECT doc_id, text, trim(text) AS s, {_threat('text')} AS threat FROM d)
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 2000 THEN 'too_long' WHEN threat IS NOT NULL THEN 'blocked' ELSE 'ok' END AS status,
CASE WHEN s <> '' AND length(s) <= 2000 THEN threat END AS threat_type FROM t""")
def validate_message(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return d.select("doc_id", X.validate_message(text, 2000).alias("v")).select("doc_id", "v.*")


@query(f"""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_snippets,
md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user'), {_lit(S.NO_CONTEXT_TEXT)})) AS digest
FROM conversations GROUP BY 1""")
def join_snippets(spark, sf):
    c = table(spark, sf, "conversations")
    # one conversation is one answer's context: few turns
    parts = c.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda p: p["text"]
        ).alias("p")
    )
    return parts.select(
        "conv_id", F.size("p").cast("bigint").alias("n_snippets"), F.md5(X.join_snippets("p")).alias("digest")
    )


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '[\s\x{00a0}]+', '', 'g') <> '') AS p FROM documents)
SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM s""")
def split_snippets(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", X.split_snippets("text").alias("p"))
    return parts.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


CENT = """p AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""


@query(f"WITH {CENT} SELECT label, pos, {sr('avg(CAST(v AS DOUBLE)) AS value')} FROM p GROUP BY 1, 2")
def centroid(spark, sf):
    out = V.centroid(table(spark, sf, "embeddings"), "embedding", ["label"])
    return rounded(out.select("label", F.posexplode("centroid").alias("pos", "value")), "value")


@query(f"""WITH {CENT}, b AS (SELECT pos, avg(CAST(v AS DOUBLE)) AS m FROM p GROUP BY 1), c AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM p GROUP BY 1, 2),
s AS (SELECT label, 1 - sum(b.m * c.m) / (sqrt(sum(b.m * b.m)) * sqrt(sum(c.m * c.m))) AS d FROM b JOIN c USING (pos) GROUP BY 1)
SELECT label, {sr('d AS drift')}, d > 0.3 AS alert FROM s""")
def semantic_drift(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(V.semantic_drift(e, e, "embedding", ["label"], digits=None), "drift")


@query(f"""SELECT a.vec_id AS a_id, b.vec_id AS b_id, {sr('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine')}
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b_id"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("y"))
    return a.join(b, "b_id").select("a_id", "b_id", rr(N.cosine_similarity("x", "y")).alias("cosine"))


@query(f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
d AS (SELECT q.query_id, v.vec_id AS doc_id, list_sum(list_transform(list_zip(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM q, embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM d)
SELECT query_id, doc_id, rank, {sr('distance')} FROM r WHERE rank <= 3""")
def topk_similar(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    return rounded(V.topk_similar(q, docs, 3), "distance")


@query("""SELECT 3 * count(*) AS results, true AS recall_over_90, count(*) AS own_first FROM embeddings""")
def topk_similar_index(spark, sf):
    """Every vector searched in the index and exactly: recall at 3, and the vectors found first at distance 0."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.withColumnRenamed("doc_id", "query_id")
    path = shared_dir(spark, "found")  # read twice
    I.search_index(q, I.indexed(e, 3), 3).write.parquet(path)
    found = spark.read.parquet(path)
    first = found.where("rank = 1 AND distance = 0").agg(F.count(F.lit(1)).alias("own_first"))
    return I.recall(found, V.topk_similar(q, e, 3)).select(
        "results", (F.col("recall") >= 0.9).alias("recall_over_90"), first.scalar().alias("own_first")
    )

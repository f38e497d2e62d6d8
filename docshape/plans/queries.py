"""Registered queries of the engine's own operators, with their SQL equivalents, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.functions import text as T
from docshape.operators import cluster, embed, fields, grouping, judged, metrics, presence, similar
from docshape.sources import export, files
from docshape.sources.rendered import SQL as RENDERED
from docshape.sources.rendered import rendered
from docshape.storage import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _re(name: str, column: str = "t") -> str:
    pattern, flags = T.PATTERNS[name]
    return f"len(regexp_extract_all({column}, '" + (f"(?{flags})" if flags else "") + pattern.replace("'", "''") + "'))"


_COUNTS = f"""c AS (SELECT *, length(t) AS chars, length(t) - length(replace(t, chr(10), '')) + 1 AS lines, len(regexp_extract_all(t, '\\S+')) AS words,
  {", ".join(f"{_re(k)} AS {k}" for k in T.PATTERNS)},
  len(list_filter(string_split(t, chr(10)), lambda x: length(x) - length(replace(x, chr(9), '')) >= 2 OR length(x) - length(replace(x, '|', '')) >= 2)) AS table_n,
  (length(t) - length(replace(t, chr(10) || chr(10), ''))) // 2 AS paragraphs FROM d)"""
_FEATURES = [
    "least(chars / 10000.0, 5)", "least(lines / 100.0, 5)", "least(words / 2000.0, 5)", *(f"least({k} / lines, 1)" for k in ("dates", "amounts", "emails", "phones", "urls", "kv")),
    "least(headers / 10.0, 1)", "least(table_n / lines, 1)", "CASE WHEN paragraphs > 0 THEN least((paragraphs + 1) / lines, 1) ELSE 0 END",
    "(dates > 0)::INT", "(amounts > 0)::INT", "(emails > 0)::INT", "(table_n > 0)::INT", "(headers > 0)::INT", "(kv > 3)::INT",
]
_D = "d AS (SELECT *, coalesce(text, '') AS t FROM documents)"
_RAW = ", ".join(f"CASE WHEN t = '' THEN 0 ELSE CAST({e} AS DOUBLE) END AS {f}" for e, f in zip(_FEATURES, T.FEATURES))


@query(f"WITH {_D}, {_COUNTS}, f AS (SELECT doc_id, {_RAW} FROM c) SELECT doc_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in T.FEATURES) + " FROM f")
def structural_fingerprint(spark, d):
    raw = T.fingerprinted(_docs(spark, d), "doc_id")
    return raw.select("doc_id", *(F.round(f, 6).alias(f) for f in T.FEATURES))


_NORM = "sqrt(" + " + ".join(f"{f} * {f}" for f in T.FEATURES) + ")"


@query(f"WITH {_D}, {_COUNTS}, f AS (SELECT doc_id, {_RAW} FROM c), n AS (SELECT *, CASE WHEN {_NORM} = 0 THEN 1 ELSE {_NORM} END AS norm FROM f) SELECT doc_id, " + ", ".join(f"round({f} / norm, 6) AS {f}" for f in T.FEATURES) + " FROM n")
def fingerprint_normalized(spark, d):
    raw = T.fingerprinted(_docs(spark, d), "doc_id")
    unit = raw.select("doc_id", *T.normalized([F.col(f) for f in T.FEATURES]))
    return unit.select("doc_id", *(F.round(f, 6).alias(f) for f in T.FEATURES))


@query(f"WITH {_D}, {_COUNTS} SELECT lang, count(*) AS n, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in T.PATTERNS) + " FROM c GROUP BY lang")
def pattern_totals_by_lang(spark, d):
    counted = _docs(spark, d).select("lang", *(T.pattern_count(F.coalesce("text", F.lit("")), k).alias(k) for k in T.PATTERNS))
    return counted.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in T.PATTERNS))


@query(f"WITH {_D}, {_COUNTS} SELECT doc_id, CAST(table_n AS INT) AS n_table_lines FROM c")
def table_lines(spark, d):
    return _docs(spark, d).select("doc_id", T.table_lines(F.coalesce("text", F.lit(""))).alias("n_table_lines"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 666) || chr(10) || '...' || chr(10) || substr(text, length(text) // 2 - 332, 666) || chr(10) || '...' || chr(10) || substr(text, length(text) - 665) END AS truncated FROM documents")
def smart_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.smart_truncate(F.col("text")).alias("truncated"))


@query("SELECT doc_id, substr(text, 1, 500) AS snippet, substr(text, 1, 600) AS excerpt FROM documents")
def snippets(spark, d):
    return files.snippets(_docs(spark, d))


@query(r"SELECT count(*) AS n_input, count(*) FILTER (regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '') AS total_docs, count(*) FILTER (regexp_replace(coalesce(text, ''), '\s+', '', 'g') = '') AS parse_errors, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars FROM documents")
def nonblank_scan_stats(spark, d):
    return files.scan_stats(_docs(spark, d))


_HUMP = "([a-z])([A-Z])"


def _sql_name(x: str) -> str:
    x = rf"lower(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '{_HUMP}', '\1_\2', 'g'))"
    for pattern, by in ((r"[-.\s]+", "_"), ("[^a-z0-9_]", ""), ("_+", "_"), ("^_|_$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_LINE = r"'^([^:=]{2,40})[:=]\s*(\S.*)$'"
_TYPE = "CASE WHEN regexp_matches(value, '^[$€£]?-?[0-9][0-9,]*([.][0-9]+)?$') THEN 'number' WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN lower(value) IN ('true','false','yes','no') THEN 'boolean' ELSE 'string' END"
_FOUND = f"""r AS ({RENDERED}), l AS (SELECT cluster_id, doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM r),
kv AS (SELECT cluster_id, doc_id, CAST(line AS INT) AS line, trim(regexp_extract(s, {_LINE}, 1)) AS name, trim(regexp_extract(s, {_LINE}, 2)) AS value FROM l),
found AS (SELECT cluster_id, doc_id, line, name, {_sql_name("name")} AS norm, value, {_TYPE} AS type, substr(name || ': ' || value, 1, 200) AS quote FROM kv WHERE name <> '')"""


@query(f"WITH {_FOUND} SELECT * FROM found WHERE norm <> ''")
def kv_extract(spark, d):
    return presence.extract_fields(rendered(spark, d))


_NAMES = ["Invoice Number", "invoiceNumber", "totalAmountDue", "invoice-number", "vendor.name", "amount ($)", "  Tax %  ", "   ", "invoice__number", "__leading__trailing__"]


@query("WITH n AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS name UNION ALL SELECT DISTINCT p_name FROM part UNION ALL SELECT DISTINCT event_type FROM events) SELECT name, " + _sql_name("name") + " AS norm FROM n")
def normalize_field_names(spark, d):
    given = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    read = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("name")).distinct()
    return given.union(read("part", "p_name")).union(read("events", "event_type")).select("name", T.field_name(F.col("name")).alias("norm"))


_PARTS = "n AS (SELECT DISTINCT p_brand, p_name FROM part)"


def _part_names(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_name").distinct()
    return n.select(F.col("p_brand").alias("key"), F.struct(F.col("p_name").alias("name")).alias("item"))


def _name_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.col("key").alias("brand"), F.col("a.name").alias("name1"), F.col("b.name").alias("name2")).where("name1 < name2").distinct()


@query(f"WITH {_PARTS} SELECT a.p_brand AS brand, a.p_name AS name1, b.p_name AS name2, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2")
def levenshtein_pairs(spark, d):
    met = similar.within_edits(_part_names(spark, d), F.col("item.name"), 2)
    return _name_pairs(met).withColumn("distance", F.levenshtein("name1", "name2", 2)).where("distance >= 0")


def _sql_jaccard(a: str, b: str) -> str:
    words = [f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda w: w <> ''))" for x in (a, b)]
    return f"CASE WHEN len({words[0]}) = 0 OR len({words[1]}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({words[0]}, {words[1]})) AS DOUBLE) / len(list_distinct(list_concat({words[0]}, {words[1]}))) END"


@query(f"WITH {_PARTS}, p AS (SELECT a.p_brand AS brand, a.p_name AS name1, b.p_name AS name2, round({_sql_jaccard('a.p_name', 'b.p_name')}, 6) AS overlap FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name) SELECT * FROM p WHERE overlap >= 0.3")
def description_jaccard(spark, d):
    met = similar.sharing_words(_part_names(spark, d), F.col("item.name"), 30)
    return _name_pairs(met).withColumn("overlap", F.round(T.words_jaccard(F.col("name1"), F.col("name2")), 6)).where("overlap >= 0.3")


def discovered(spark: SparkSession, d: str) -> DataFrame:
    """One row per found line as a field: ``ord`` is document, then line."""
    return as_fields(presence.extract_fields(rendered(spark, d)))


def as_fields(found: DataFrame) -> DataFrame:
    return found.select("cluster_id", (F.col("doc_id") * 1_000_000 + F.col("line")).alias("ord"), "name", "type", F.col("quote").alias("description"), F.col("value").alias("example"), "norm")


_DISC = f"{_FOUND}, disc AS (SELECT cluster_id, doc_id * 1000000 + line AS ord, name, type, quote AS description, value AS example, norm FROM found WHERE norm <> '')"
_MERGED = f"""{_DISC}, m AS (SELECT cluster_id, norm, min(ord) AS ord, first(description ORDER BY length(description) DESC, ord) AS description, coalesce(first(type ORDER BY ord) FILTER (type <> 'string'), 'string') AS type, first(example ORDER BY ord) AS example FROM disc GROUP BY ALL),
e AS (SELECT cluster_id, norm, example, min(ord) AS ord FROM disc GROUP BY ALL), e5 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, norm ORDER BY ord, example) AS nth FROM e QUALIFY nth <= 5),
merged AS (SELECT m.*, ex.examples FROM m JOIN (SELECT cluster_id, norm, string_agg(example, ' | ' ORDER BY nth) AS examples FROM e5 GROUP BY ALL) ex USING (cluster_id, norm))"""


@query(f"WITH {_MERGED} SELECT * FROM merged")
def merge_field_lists(spark, d):
    found = written(presence.extract_fields(rendered(spark, d)), "found")
    return fields.merge_fields(as_fields(found)).withColumn("examples", F.array_join("examples", " | "))


_FREQ = f"""{_FOUND}, t AS (SELECT cluster_id, count(*) AS n_docs FROM r GROUP BY 1),
freq AS (SELECT cluster_id, norm AS name, count(DISTINCT doc_id) AS doc_count, count(DISTINCT CASE WHEN quote <> '' THEN doc_id END) AS grounded_count, n_docs, round(least(count(DISTINCT doc_id) * 100.0 / n_docs, 100), 1) AS frequency FROM found JOIN t USING (cluster_id) WHERE norm <> '' GROUP BY cluster_id, norm, n_docs)"""


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    docs = rendered(spark, d)
    return presence.field_frequency(docs, presence.extract_fields(docs))


@query(f"WITH {_FREQ} SELECT *, frequency >= 80 AS required FROM freq")
def field_frequency(spark, d):
    return frequencies(spark, d)


@query(f"WITH {_FREQ} SELECT cluster_id, count(*) AS n_fields, round(sum(doc_count) * 100.0 / (count(*) * max(n_docs)), 1) AS coverage FROM freq GROUP BY 1")
def field_coverage(spark, d):
    return presence.coverage(frequencies(spark, d))


_ALIASES = [("Part Name", "Item Name", 0), ("Customer Name", "Party Name", 1), ("Supplier Name", "Party Name", 2), ("Retail Price", "price", 3), ("Total Price", "total", 4), ("Total Price", "price", 5)]


def _with_ord(spark: SparkSession, d: str) -> DataFrame:
    """The merged fields with their frequencies. Lines are extracted once, into a written table that all steps read."""
    docs = rendered(spark, d)
    found = written(presence.extract_fields(docs), "found")
    merged = fields.merge_fields(as_fields(found)).select("cluster_id", "ord", F.col("norm").alias("name"), "type", "description", "example")
    return merged.join(presence.field_frequency(docs, found).select("cluster_id", "name", "frequency", "doc_count", "required"), ["cluster_id", "name"])


_FREQ_ONLY = _FREQ[len(_FOUND) + 2 :]
_ALL = f"{_MERGED}, {_FREQ_ONLY}, fld AS (SELECT m.cluster_id, m.ord, m.norm AS name, m.type, m.description, m.example, f.frequency, f.doc_count, f.frequency >= 80 AS required FROM merged m JOIN freq f ON f.cluster_id = m.cluster_id AND f.name = m.norm)"


@query(
    f"WITH {_ALL}, al AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}', {o})" for a, c, o in _ALIASES) + f""") AS v(alias, canonical, o)), k AS (SELECT {_sql_name("alias")} AS a, {_sql_name("first(canonical ORDER BY o DESC)")} AS c FROM al GROUP BY 1),
x AS (SELECT fld.*, coalesce(k.c, fld.name) AS canonical FROM fld LEFT JOIN k ON k.a = fld.name)
SELECT cluster_id, canonical, min(ord) AS ord, first(description ORDER BY length(description) DESC, ord) AS description, coalesce(first(type ORDER BY ord) FILTER (type <> 'string'), 'string') AS type, max(frequency) AS frequency,
first(doc_count ORDER BY frequency DESC, ord) AS doc_count, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (name <> canonical), '') AS aliases FROM x GROUP BY 1, 2"""
)
def dedup_fields(spark, d):
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string, ord int")
    return fields.dedup_fields(_with_ord(spark, d), aliases).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {_FREQ} SELECT name, count(*) AS n_clusters, round(avg(frequency), 1) AS avg_frequency, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM freq GROUP BY 1 HAVING count(*) >= 2")
def cross_cluster_fields(spark, d):
    return fields.cross_cluster_fields(frequencies(spark, d)).select("name", "n_clusters", "avg_frequency", F.array_join("clusters", ",").alias("clusters"))


_LEV = "levenshtein(a.name, b.name)"
_JAC = _sql_jaccard("a.d", "b.d")
_MERGE_SQL = f"""s AS (SELECT cluster_id, ord, name, replace(name, '_', ' ') AS d FROM fld UNION ALL SELECT 'all', ord + 1000000000000000000, name, replace(name, '_', ' ') FROM fld UNION ALL SELECT * FROM (VALUES ('all', 1, 'total', 'sum to pay'), ('all', 2, 'totals', 'sum to pay'), ('all', 3, 'sum_due', 'the sum to pay'), ('all', 4, 'sum_dues', 'unlike')) AS v(c, o, n, d)),
p AS (SELECT a.cluster_id, a.ord AS o1, b.ord AS o2, a.name AS name1, b.name AS name2, CASE WHEN {_LEV} < 6 THEN {_LEV} ELSE -1 END AS dist, {_JAC} AS j, contains(a.name, b.name) OR contains(b.name, a.name) AS inside FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.ord < b.ord AND a.name <> b.name)
SELECT cluster_id, name1, name2, CASE WHEN length(name2) > length(name1) THEN name2 ELSE name1 END AS suggested_name, concat_ws(', ', CASE WHEN dist BETWEEN 0 AND 2 THEN 'similar names (distance=' || dist || ')' END, CASE WHEN j > 0.5 THEN 'similar descriptions (' || CAST(floor(j * 100) AS INT) || '% overlap)' END, CASE WHEN inside THEN 'one name contains the other' END) AS reason
FROM p WHERE dist BETWEEN 0 AND 2 OR (j > 0.5 AND dist >= 0) OR inside QUALIFY row_number() OVER (PARTITION BY cluster_id, least(name1, name2), greatest(name1, name2) ORDER BY o1, o2) = 1"""


@query(f"WITH {_ALL}, {_MERGE_SQL}")
def suggest_merges(spark, d):
    f = _with_ord(spark, d).select("cluster_id", "ord", "name", F.replace("name", F.lit("_"), F.lit(" ")).alias("description"))
    odd = spark.createDataFrame([("all", 1, "total", "sum to pay"), ("all", 2, "totals", "sum to pay"), ("all", 3, "sum_due", "the sum to pay"), ("all", 4, "sum_dues", "unlike")], f.schema)
    return fields.suggest_merges(f.union(odd).union(f.select(F.lit("all"), F.col("ord") + 1_000_000_000_000_000_000, "name", "description")))


@query(
    """WITH found AS (SELECT doc_id, lang AS field, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk, s, i FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
x AS (SELECT doc_id, field, chunk, length(s) > 20 AS present, contains(s, '.') AS grounded, substr(s, 1, 200) AS quote, CASE WHEN length(s) % 3 = 0 THEN '' ELSE substr(s, 1, 10) END AS value FROM found), p AS (SELECT *, grounded AND quote <> '' AS sure FROM x WHERE present)
SELECT doc_id, field, coalesce(first(quote ORDER BY chunk DESC) FILTER (sure), first(quote ORDER BY chunk)) AS quote, first(value ORDER BY chunk) FILTER (value <> '') AS value, bool_or(sure) OR first(grounded ORDER BY chunk) AS grounded FROM p GROUP BY 1, 2"""
)
def chunk_presence_merge(spark, d):
    lines = _docs(spark, d).select("doc_id", F.col("lang").alias("field"), F.posexplode(F.split("text", "\n", -1)).alias("chunk", "s"))
    value = F.when(F.char_length("s") % 3 == 0, "").otherwise(F.substring("s", 1, 10))
    return presence.merge_chunks(lines.select("doc_id", "field", "chunk", (F.char_length("s") > 20).alias("present"), F.contains("s", F.lit(".")).alias("grounded"), F.substring("s", 1, 200).alias("quote"), value.alias("value")))


@query("WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM n WHERE n <= 8 OR i IN (0, n // 8, 2 * n // 8, 3 * n // 8, 4 * n // 8, 5 * n // 8, 6 * n // 8, 7 * n // 8)")
def systematic_sample(spark, d):
    return fields.systematic_sample(_docs(spark, d).select("source", "doc_id"), "source", "doc_id", 8)


_GROUPS = [(0, "Identity", ["Order Number", "Customer Name", "Part Name", "supplierName"]), (1, "Money", ["Total Price", "Retail Price", "Account Balance"]), (2, "Other", ["order_status", "Part Name"])]


@query(
    f"WITH {_ALL}, g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{g}', {j}, '{f}')" for i, g, fs in _GROUPS for j, f in enumerate(fs)) + f""") AS v(group_id, g, nth, field)),
h AS (SELECT {_sql_name("field")} AS norm, first(group_id ORDER BY group_id, nth) AS group_id, first(g ORDER BY group_id, nth) AS g FROM g GROUP BY 1)
SELECT cluster_id, name, coalesce(g, 'Ungrouped') AS "group", CASE group_id WHEN 0 THEN '#3868b8' WHEN 1 THEN '#5cb85c' WHEN 2 THEN '#e74c3c' ELSE '#9a8e80' END AS color FROM fld LEFT JOIN h ON h.norm = fld.name"""
)
def group_assignment(spark, d):
    groups = spark.createDataFrame(_GROUPS, "group_id int, name string, fields array<string>")
    return grouping.assign_groups(_with_ord(spark, d), groups).select("cluster_id", "name", "group", "color")


@query("""WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(CAST(v AS DOUBLE)), 9) AS v FROM e GROUP BY 1, 2),
r AS (SELECT label, list(v ORDER BY pos) AS c FROM m GROUP BY 1)
SELECT vec_id, CAST(first(r.label ORDER BY dist, r.label) AS BIGINT) AS ref_id, first(r.label ORDER BY dist, r.label) AS cluster_id, min(dist) AS distance FROM embeddings q, r, LATERAL (SELECT round(list_distance(CAST(q.embedding AS DOUBLE[]), r.c), 6) AS dist) GROUP BY 1""")
def nearest_cluster_assign(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    of = cluster.centres(v).withColumn("vec_id", F.col("label").cast("long"))
    return cluster.nearest_cluster(v, of)


@query("""WITH c AS (SELECT label AS a, vec_id % 7 + 3 * (label % 2) AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), rs AS (SELECT a, sum(n) AS an FROM c GROUP BY 1), cs AS (SELECT b, sum(n) AS bn, max(n) AS top FROM c GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS pab, (SELECT sum(an * (an - 1) / 2) FROM rs) AS pa, (SELECT sum(bn * (bn - 1) / 2) FROM cs) AS pb, (SELECT count(*) FROM rs) AS n_classes, (SELECT count(*) FROM cs) AS n_clusters, (SELECT sum(top) FROM cs) AS top),
e AS (SELECT s.*, (SELECT sum(-an / s.n * ln(an / s.n)) FROM rs) AS ha, (SELECT sum(-bn / s.n * ln(bn / s.n)) FROM cs) AS hb, (SELECT sum(c.n / s.n * ln(s.n * c.n / (an * bn))) FROM c JOIN rs USING (a) JOIN cs USING (b)) AS mi FROM s),
x AS (SELECT *, mi / ha AS h, mi / hb AS cc, pa * pb / (n * (n - 1) / 2) AS ex FROM e)
SELECT CAST(n AS BIGINT) AS n, n_clusters, n_classes, round((pab - ex) / ((pa + pb) / 2 - ex), 4) AS ari, round(2 * h * cc / (h + cc), 4) AS nmi, round(2 * h * cc / (h + cc), 4) AS v_measure, round(h, 4) AS homogeneity, round(cc, 4) AS completeness, round(top / n, 4) AS purity FROM x""")
def clustering_metrics(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("label", (F.col("vec_id") % 7 + 3 * (F.col("label") % 2)).alias("cluster_id"))
    return metrics.clustering_metrics(v, "label", "cluster_id")


@query("SELECT label AS cluster_id, count(*) AS doc_count, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def cluster_sizes(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("doc_count"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("WITH e AS (SELECT event_type, event_id, unnest(json_keys(props)) AS k, props FROM events), t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, k AS field, count(DISTINCT event_id) AS doc_count, round(count(DISTINCT event_id) * 100.0 / n, 1) AS frequency FROM e JOIN t USING (event_type) GROUP BY event_type, k, n")
def event_json_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "props")
    found = e.select("event_type", "event_id", F.explode(F.json_object_keys("props")).alias("field")).distinct().groupBy("event_type", "field").agg(F.count("*").alias("doc_count"))
    return found.join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_type", "field", "doc_count", F.round(F.col("doc_count") * 100.0 / F.col("n"), 1).alias("frequency"))


@query(f"""WITH {_ALL} SELECT cluster_id, string_agg(name, ',' ORDER BY ord) || chr(10) || string_agg('"' || replace(example, '"', '""') || '"', ',' ORDER BY ord) || chr(10) AS csv FROM fld GROUP BY 1""")
def export_csv(spark, d):
    return export.csv_headers(_with_ord(spark, d))


@query(f"""WITH {_ALL} SELECT cluster_id, '## ' || cluster_id || chr(10) || chr(10) || '| Field | Type | Required | Frequency | Description |' || chr(10) || '' || repeat('|---', 5) || '|' || chr(10) || string_agg('| ' || name || ' | ' || type || ' | ' || CASE WHEN required THEN 'Yes' ELSE 'No' END || ' | ' || CAST(CAST(frequency AS DECIMAL(18,1)) AS VARCHAR) || '% | ' || replace(description, '|', chr(92) || '|') || ' |', chr(10) ORDER BY ord) AS markdown FROM fld GROUP BY 1""")
def export_markdown(spark, d):
    return export.markdown(_with_ord(spark, d))


@query(f"WITH {_ALL} SELECT cluster_id, name, description, CASE type WHEN 'number' THEN 'float' WHEN 'integer' THEN 'int' WHEN 'boolean' THEN 'string' ELSE type END AS type, required FROM fld")
def export_entities(spark, d):
    return export.entities(_with_ord(spark, d))


_PROPERTY = """to_json(name)::VARCHAR || ':{"type":"' || CASE WHEN type IN ('number', 'integer', 'boolean') THEN type ELSE 'string' END || '","description":' || to_json(description)::VARCHAR || CASE WHEN type = 'date' THEN ',"format":"date"' ELSE '' END || ',"examples":[' || to_json(example)::VARCHAR || ']}'"""


@query(f"""WITH {_ALL} SELECT cluster_id, '{{"$schema":"https://json-schema.org/draft/2020-12/schema","title":"' || cluster_id || '","type":"object","properties":{{' || string_agg({_PROPERTY}, ',' ORDER BY ord) || '}},"required":[' || coalesce(string_agg(to_json(name)::VARCHAR, ',' ORDER BY ord) FILTER (required), '') || ']}}' AS json_schema FROM fld GROUP BY 1""")
def export_json_schema(spark, d):
    return export.json_schema(_with_ord(spark, d))


def _sql_last(mark: str) -> str:
    """Place (from 0) of the last ``mark`` that begins past a third of the chunk and ends in it, -1 for none."""
    window = "substr(text, pos + 1334, 2667)"
    return f"CASE WHEN contains({window}, {mark}) THEN pos + 1333 + length({window}) - position(reverse({mark}) IN reverse({window})) - length({mark}) + 1 ELSE -1 END"


_MARKS = [("chr(10) || chr(10)", 0), ("'. '", 1), ("'.' || chr(10)", 1), ("'! '", 1), ("'? '", 1), ("chr(10)", 0), ("' '", 1)]
_TO = "CASE WHEN pos + 4000 >= length(text) THEN pos + 4000 " + " ".join(f"WHEN {_sql_last(m)} >= 0 THEN {_sql_last(m)} + {extra}" for m, extra in _MARKS) + " ELSE pos + 4000 END"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""WITH RECURSIVE t AS (SELECT doc_id, text FROM documents WHERE trim(coalesce(text, ''), {_BLANK}) <> ''), cut AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS upto, CAST('' AS VARCHAR) AS part, 0 AS step FROM t WHERE length(text) > 4000
UNION ALL SELECT doc_id, text, nxt, nxt, trim(substr(text, CAST(pos AS INT) + 1, CAST(nxt - pos AS INT)), {_BLANK}), step + 1 FROM (SELECT *, {_TO} AS nxt FROM cut WHERE pos < length(text))),
parts AS (SELECT doc_id, text AS part, 1 AS step FROM t WHERE length(text) <= 4000 UNION ALL SELECT doc_id, part, step FROM cut WHERE step > 0 AND part <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INT) AS chunk, CAST(length(part) AS INT) AS n_chars, md5(part) AS digest FROM parts"""
)
def chunk_documents(spark, d):
    from docshape.functions.chunks import chunks

    return _docs(spark, d).select("doc_id", F.posexplode(chunks(F.col("text"), 4000)).alias("chunk", "part")).select("doc_id", "chunk", F.char_length("part").alias("n_chars"), F.md5("part").alias("digest"))


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")
def json_repair(spark, d):
    """Replies with prose before the JSON, every other one cut short by a character, come out whole."""
    from docshape.functions.jsonfix import repaired

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "props")
    cut = F.concat(F.lit("Here it is: "), F.substr("props", F.lit(1), F.char_length("props") - F.pmod("event_id", F.lit(2)).cast("int")))
    return e.select("event_id", repaired(cut).alias("props"))


@query(f"WITH {_FREQ}, m AS (SELECT r.cluster_id, r.doc_id, freq.name FROM r JOIN freq USING (cluster_id)), o AS (SELECT cluster_id, doc_id, norm AS name, min(quote) AS quote FROM found WHERE norm <> '' GROUP BY ALL) SELECT m.*, o.quote IS NOT NULL AS present, o.quote FROM m LEFT JOIN o USING (cluster_id, doc_id, name)")
def presence_matrix(spark, d):
    docs = rendered(spark, d)
    found = written(presence.extract_fields(docs), "found")
    return presence.presence_matrix(docs, presence.field_frequency(docs, found), found)


@query(f"WITH {_FOUND}, f AS (SELECT cluster_id, doc_id, norm, first(quote ORDER BY line) AS quote, first(value ORDER BY line) AS value, true AS grounded FROM found WHERE norm <> '' GROUP BY 1, 2, 3) SELECT * FROM f")
def verify_fields(spark, d):
    from docshape.plans.analyst import RuleAnalyst

    docs = rendered(spark, d)
    # Names are all that verification needs: no document is counted for them.
    names = written(presence.extract_fields(docs).select("cluster_id", F.col("norm").alias("name")).distinct(), "names")
    return judged.verify_fields(docs, names, RuleAnalyst())


_EIGHT = "s AS (SELECT cluster_id, doc_id, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM r), few AS (SELECT cluster_id, doc_id FROM s WHERE n <= 8 OR i IN (0, n // 8, 2 * n // 8, 3 * n // 8, 4 * n // 8, 5 * n // 8, 6 * n // 8, 7 * n // 8))"


@query(
    f"""WITH {_FOUND}, {_EIGHT}, x AS (SELECT found.* FROM found JOIN few USING (cluster_id, doc_id) WHERE norm <> '')
SELECT cluster_id, norm AS name, coalesce(first(type ORDER BY doc_id, line) FILTER (type <> 'string'), 'string') AS type, first(quote ORDER BY length(quote) DESC, doc_id, line) AS description, first(value ORDER BY doc_id, line) AS example FROM x GROUP BY 1, 2"""
)
def discover_fields(spark, d):
    from docshape.plans.analyst import RuleAnalyst

    samples = fields.systematic_sample(rendered(spark, d), "cluster_id", "doc_id", 8)
    return judged.discover_fields(samples, RuleAnalyst()).select("cluster_id", "name", "type", "description", "example")


@query(f"WITH r AS ({RENDERED}), n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS i FROM r), h AS (SELECT cluster_id, string_split(text, chr(10))[1] AS head, count(*) AS c, (SELECT count(*) FROM n x WHERE x.cluster_id = n.cluster_id AND x.i <= 5) AS k FROM n WHERE i <= 5 GROUP BY 1, 2), b AS (SELECT cluster_id, first(head ORDER BY c DESC, head) AS head, max(k) AS k FROM h GROUP BY 1) SELECT cluster_id, head[1] || lower(head[2:]) AS name, k || ' documents like: ' || head[1] || lower(head[2:]) AS description FROM b")
def cluster_labels(spark, d):
    from docshape.plans.analyst import RuleAnalyst
    from docshape.plans.pipeline import first_texts

    return judged.label_clusters(first_texts(rendered(spark, d)), RuleAnalyst()).select("cluster_id", "name", "description")


@query()
def group_fields(spark, d):
    from docshape.plans.analyst import RuleAnalyst

    listed = written(_with_ord(spark, d), "listed")
    types = listed.select("cluster_id", F.initcap("cluster_id").alias("name")).distinct()
    return judged.group_fields(listed, types, RuleAnalyst())


@query()
def embed_documents(spark, d):
    return embed.embed_documents(_docs(spark, d)).select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query()
def hdbscan_clusters(spark, d):
    return cluster.cluster_points(spark.read.parquet(f"{d}/embeddings.parquet"))


@query()
def subclusters(spark, d):
    return cluster.sub_clusters(spark.read.parquet(f"{d}/embeddings.parquet"))


@query()
def pca_coords(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    out = cluster.project(v, *cluster.principal_components(v))
    return out.select("vec_id", F.transform("coord_3d", lambda x: F.round(x, 4)).alias("coord_3d"))


@query()
def discover_pipeline(spark, d):
    from docshape.plans.pipeline import discover

    return discover(rendered(spark, d).select("doc_id", F.concat("cluster_id", F.lit("_"), F.col("doc_id").cast("string")).alias("name"), "text")).fields


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

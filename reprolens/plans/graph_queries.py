"""Queries over graphs made from the driver tables: quads, patterns, diff, shapes, scores; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.operators import diff, graph, scoring, shapes
from reprolens.sources.tables import table

C = F.col


def study(key: str):
    return F.concat(F.lit("study/"), C(key))


def activities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as activities of the study of their nation; some produce a dataset."""
    k = C("c_custkey")
    return graph.to_quads(
        table(spark, sf, "customer"), study("c_nationkey"), F.concat(F.lit("activity/"), k), "ResearchActivity",
        {"title": C("c_name"), "rdfs:label": F.when(k % 5 != 0, C("c_name")), "segment": C("c_mktsegment"), "identifier": F.when(C("c_acctbal") > 9000, F.concat(F.lit("https://doi.org/10.1/"), k))},
        {"generatesDataset": F.when(k % 3 == 0, F.concat(F.lit("dataset/"), k))},
    )


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    k = C("c_custkey")
    rows = table(spark, sf, "customer").filter(k % 3 == 0)
    return graph.to_quads(rows, study("c_nationkey"), F.concat(F.lit("dataset/"), k), "Dataset", {"dataLicense": F.when(k % 2 == 0, F.lit("CC-BY-4.0")), "accessLevel": F.when(C("c_nationkey") % 4 == 0, F.lit("open")).when(C("c_nationkey") % 4 == 1, F.lit("on request"))})


def software(spark: SparkSession, sf: str) -> DataFrame:
    k = C("s_suppkey")
    licence = F.when(C("s_nationkey") % 3 == 0, F.lit("MIT")).when(C("s_nationkey") % 3 == 1, F.lit("LicenseRef-Custom"))
    return graph.to_quads(table(spark, sf, "supplier"), study("s_nationkey"), F.concat(F.lit("software/"), k), "SoftwareApplication", {"softwareLicense": licence, "commitHash": F.when(C("s_acctbal") > 5000, F.md5(C("s_name")))})


def quads(spark: SparkSession, sf: str) -> DataFrame:
    return graph.merge(activities(spark, sf), datasets(spark, sf), software(spark, sf))


QUADS = """
q AS (
  SELECT 'study/' || c_nationkey AS graph, 'activity/' || c_custkey AS s, unnest(['rdf:type', 'title', 'rdfs:label', 'segment', 'identifier', 'generatesDataset']) AS p,
         unnest(['ResearchActivity', c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_name END, c_mktsegment, CASE WHEN c_acctbal > 9000 THEN 'https://doi.org/10.1/' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'dataset/' || c_custkey END]) AS o,
         unnest(['iri', 'literal', 'literal', 'literal', 'literal', 'iri']) AS o_kind, unnest([NULL, 'xsd:string', 'xsd:string', 'xsd:string', 'xsd:string', NULL]) AS o_type FROM customer
  UNION SELECT 'study/' || c_nationkey, 'dataset/' || c_custkey, unnest(['rdf:type', 'dataLicense', 'accessLevel']),
         unnest(['Dataset', CASE WHEN c_custkey % 2 = 0 THEN 'CC-BY-4.0' END, CASE c_nationkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'on request' END]), unnest(['iri', 'literal', 'literal']), unnest([NULL, 'xsd:string', 'xsd:string']) FROM customer WHERE c_custkey % 3 = 0
  UNION SELECT 'study/' || s_nationkey, 'software/' || s_suppkey, unnest(['rdf:type', 'softwareLicense', 'commitHash']),
         unnest(['SoftwareApplication', CASE s_nationkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'LicenseRef-Custom' END, CASE WHEN s_acctbal > 5000 THEN md5(s_name) END]), unnest(['iri', 'literal', 'literal']), unnest([NULL, 'xsd:string', 'xsd:string']) FROM supplier),
quads AS (SELECT * FROM q WHERE o IS NOT NULL)
"""


def quads_from_tables(spark, sf):
    return quads(spark, sf)


def triple_counts(spark, sf):
    return graph.counts(quads(spark, sf))


def entity_type_counts(spark, sf):
    return graph.type_counts(quads(spark, sf))


def distinct_graphs(spark, sf):
    return quads(spark, sf).select("graph").distinct()


def fetch_graph(spark, sf):
    return graph.fetch(quads(spark, sf), "study/7")


def graph_exists(spark, sf):
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("study/"), C("n_nationkey") * 2).alias("graph"))
    return graph.exists(quads(spark, sf), wanted)


def ask_batch(spark, sf):
    return graph.ask(quads(spark, sf), {
        "has_activity": scoring.is_a("ResearchActivity"), "has_building": (C("p") == "segment") & (C("o") == "BUILDING"), "has_doi": (C("p") == "identifier") & C("o").contains("doi.org"),
        "has_open_data": (C("p") == "accessLevel") & (C("o") == "open"), "has_method": C("p") == "usedMethod",
    })


def graph_merge_distinct(spark, sf):
    a = activities(spark, sf)
    return graph.counts(graph.merge(a, a.filter("p != 'segment'"), software(spark, sf)))


def graph_replace(spark, sf):
    new = graph.to_quads(table(spark, sf, "nation").filter("n_nationkey < 5"), study("n_nationkey"), F.concat(F.lit("nation/"), C("n_nationkey")), "Place", {"title": C("n_name")})
    return graph.counts(graph.replace(quads(spark, sf), new))


def graph_delete(spark, sf):
    gone = table(spark, sf, "nation").filter("n_regionkey = 1").select(study("n_nationkey").alias("graph"))
    return graph.counts(graph.delete(quads(spark, sf), gone))


def bgp_optional_deps(spark, sf):
    return graph.star(quads(spark, sf), {"title": "title", "segment": "segment"}, {"identifier": "identifier", "generatesDataset": "dataset"}, "ResearchActivity")


def construct_links(spark, sf):
    found = graph.star(quads(spark, sf), {"generatesDataset": "dataset"}, {}, "ResearchActivity")
    return graph.construct(found, [(C("dataset"), "wasGeneratedBy", C("s")), (C("dataset"), "inGraph", C("graph"))])


# --- diff -------------------------------------------------------------------------------------------


def _dependencies(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_linenumber in (1, 2)").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    rows = lines.join(parts, C("l_partkey") == C("p_partkey")).select(
        C("l_orderkey").alias("pair"), "l_linenumber", F.replace(C("p_brand"), F.lit("#"), F.lit("-")).alias("name"), F.when(C("p_size") % 10 == 0, F.lit("unspecified")).otherwise(C("p_size").cast("string")).alias("version"))
    return rows.filter("l_linenumber = 1"), rows.filter("l_linenumber = 2")


def version_conflicts(spark, sf):
    return diff.version_conflicts(*_dependencies(spark, sf))


VERSION = """
d AS (SELECT l_orderkey AS pair, l_linenumber, lower(replace(replace(p_brand, '#', '-'), '-', '_')) AS name, CASE WHEN p_size % 10 = 0 THEN 'unspecified' ELSE p_size::VARCHAR END AS version
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber IN (1, 2)),
vc AS (SELECT DISTINCT a.pair, a.name, a.version AS original_value, b.version AS reproduction_value FROM d a JOIN d b ON a.pair = b.pair AND a.name = b.name
       WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.version <> 'unspecified' AND b.version <> 'unspecified' AND a.version <> b.version)
"""


def digest_conflicts(spark, sf):
    a = table(spark, sf, "orders").select(C("o_custkey").alias("pair"), F.when(C("o_orderkey") % 7 == 0, F.lit("unspecified")).otherwise(F.md5(C("o_orderpriority"))).alias("digest"))
    b = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(C("c_custkey").alias("pair"), F.md5(F.concat((C("c_custkey") % 5 + 1).cast("string"), F.lit("-URGENT"))).alias("digest"))
    return diff.digest_conflicts(a, b)


def _seeds(spark, sf):
    day = F.date_trunc("DAY", C("ts"))
    base = table(spark, sf, "events").select("user_id", "event_type", F.date_format(day, "d").cast("int").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return base.groupBy("user_id", "event_type", "day").agg(F.max("k").cast("string").alias("value")).withColumnRenamed("event_type", "name")


def seed_conflicts(spark, sf):
    rows = _seeds(spark, sf)
    pair = lambda d: F.concat_ws(":", C("user_id").cast("string"), d.cast("string"))
    return diff.seed_conflicts(rows.select(pair(C("day")).alias("pair"), "name", "value"), rows.select(pair(C("day") - 1).alias("pair"), "name", "value"))


def _environment(spark, sf, side: int):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey"))
    k = C("s_suppkey")
    props = F.array(
        F.struct(F.lit("cuda").alias("prop"), F.concat(F.lit("11."), ((k + side * (k % 2)) % 9).cast("string")).alias("value")),
        F.struct(F.lit("gpu").alias("prop"), F.when((k + side) % 3 != 0, C("n_name")).alias("value")),
        F.struct(F.lit("os").alias("prop"), F.concat(F.lit("os"), ((k + side) % 2).cast("string")).alias("value")),
        F.struct(F.lit("ram").alias("prop"), k.cast("string").alias("value")))
    return rows.select(k.alias("pair"), F.inline(props)).filter("value is not null")


def hardware_conflicts(spark, sf):
    return diff.hardware_conflicts(_environment(spark, sf, 0), _environment(spark, sf, 1))


HARDWARE = """
e AS (SELECT s_suppkey AS pair, side, unnest(['cuda', 'gpu', 'os']) AS prop,
             unnest(['11.' || ((s_suppkey + side * (s_suppkey % 2)) % 9), CASE WHEN (s_suppkey + side) % 3 <> 0 THEN n_name END, 'os' || ((s_suppkey + side) % 2)]) AS value
      FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (SELECT unnest([0, 1]) AS side) x),
hc AS (SELECT a.pair, a.prop, CASE a.prop WHEN 'cuda' THEN 'HIGH' WHEN 'gpu' THEN 'MEDIUM' ELSE 'LOW' END AS severity, a.value AS original_value, coalesce(b.value, 'absent') AS reproduction_value
       FROM (SELECT * FROM e WHERE side = 0 AND value IS NOT NULL) a LEFT JOIN (SELECT * FROM e WHERE side = 1 AND value IS NOT NULL) b ON a.pair = b.pair AND a.prop = b.prop
       WHERE b.value IS NULL OR a.value <> b.value)
"""


def conflict_construct(spark, sf):
    return diff.conflict_triples(version_conflicts(spark, sf), "VersionConflict", "HIGH", "name", "original_value", "reproduction_value")


def conflict_counts(spark, sf):
    v, h = version_conflicts(spark, sf), hardware_conflicts(spark, sf)
    return diff.summary({"version": (v, diff.conflict_triples(v, "VersionConflict", "HIGH", "name", "original_value", "reproduction_value")), "hardware": (h, diff.conflict_triples(h, "HardwareConflict", "LOW", "prop"))})


# --- shapes and scores ------------------------------------------------------------------------------


def shape_violations(spark, sf):
    return shapes.validate(quads(spark, sf), shapes.constraints(spark))


def shape_conformance(spark, sf):
    return shapes.conformance(quads(spark, sf), shapes.constraints(spark))


_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join("({})".format(", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row)) for row in shapes.CONSTRAINTS) + ") t(shape, target, path, severity, min_count, datatype, class, not_value))"
_SHAPES = (
    "WITH " + QUADS + ", " + _RULES + """,
k AS (SELECT q.graph, q.s AS focus, r.* FROM quads q JOIN r ON q.p = 'rdf:type' AND q.o = r.target),
j AS (SELECT k.*, v.o, v.o_kind, v.o_type, EXISTS (SELECT 1 FROM quads t WHERE t.graph = k.graph AND t.s = v.o AND t.p = 'rdf:type' AND t.o = k.class) AS of_class
      FROM k LEFT JOIN quads v ON v.graph = k.graph AND v.s = k.focus AND v.p = k.path),
t AS (SELECT graph, focus, shape, target, path, severity, min_count, datatype, class, not_value, count(o) AS n,
             coalesce(bool_or(o IS NOT NULL AND datatype IS NOT NULL AND NOT (o_kind = 'literal' AND coalesce(o_type = datatype, false))), false) AS bad_type,
             coalesce(bool_or(o IS NOT NULL AND class IS NOT NULL AND NOT of_class), false) AS bad_class, coalesce(bool_or(o IS NOT NULL AND o = not_value), false) AS bad_value
      FROM j GROUP BY ALL),
f AS (SELECT graph, focus, shape, path, severity, 'min_count' AS problem FROM t WHERE n < min_count UNION ALL SELECT graph, focus, shape, path, severity, 'datatype' FROM t WHERE bad_type
      UNION ALL SELECT graph, focus, shape, path, severity, 'class' FROM t WHERE bad_class UNION ALL SELECT graph, focus, shape, path, severity, 'not_value' FROM t WHERE bad_value)
"""
)


def _grades(spark, sf):
    return scoring.grade(quads(spark, sf))


def score_criteria(spark, sf):
    return _grades(spark, sf).select("graph", "dimension", "criterion", "level", F.bround("points", 2).alias("points"))


def score_dimensions(spark, sf):
    return scoring.dimensions(_grades(spark, sf))


def score_total(spark, sf):
    return scoring.totals(_grades(spark, sf))


def score_tiers(spark, sf):
    return scoring.totals(_grades(spark, sf)).groupBy("tier").agg(F.count("*").alias("n"))


def recommendations_ranked(spark, sf):
    return scoring.recommendations(_grades(spark, sf))


#: (present, full) as SQL conditions on a quad, in the order of the rubric; written apart from the Column form.
_ASKS = [
    ("p = 'identifier'", ["p = 'identifier' AND (lower(o) LIKE '%doi.org%' OR lower(o) LIKE '%handle.net%' OR lower(o) LIKE '%zenodo%' OR lower(o) LIKE '%w3id.org%' OR o LIKE '%10.%')"]),
    ("p = 'title'", []), ("p = 'datasetLandingPage'", []), ("p = 'identifier' AND o LIKE 'http%'", []), ("p = 'dataLicense'", []),
    ("p = 'accessLevel'", ["p = 'accessLevel' AND o IN ('open', 'public', 'restricted', 'embargoed', 'closed')"]),
    ("p = 'usedMethod'", []), ("p = 'workflowLanguage'", []), ("p IN ('citesDataset', 'derivedFrom', 'generatesPublication')", []),
    ("p = 'softwareLicense'", ["p = 'softwareLicense' AND o NOT IN ('LicenseRef-Custom', '')"]), ("p = 'commitHash'", []), ("p = 'dataFormat'", []),
    ("(p = 'rdf:type' AND o = 'EnvironmentSpec') OR p = 'softwareDependency'", ["p = 'imageDigest' AND o <> ''"]),
    ("(p = 'rdf:type' AND o = 'RandomSeed') OR p IN ('hasParameter', 'usedMethod')", ["p = 'rdf:type' AND o = 'RandomSeed'", "p = 'usedMethod'"]),
    ("(p = 'rdf:type' AND o = 'EvaluationResult') OR p IN ('generatesDataset', 'usedDataset')", ["p = 'rdf:type' AND o = 'EvaluationResult'"]),
]
#: The most points of each, in 24ths: whole numbers, whose sums don't depend on the order.
_MOST = [120, 120, 120, 135, 135, 90, 160, 160, 160, 180, 120, 180, 288, 216, 216]
_GRADES = "WITH " + QUADS + ", g AS (" + " UNION ALL ".join(
    f"SELECT graph, {i} AS position, '{c.dimension}' AS dimension, '{c.name}' AS criterion, '{c.priority}' AS priority, CASE WHEN NOT bool_or({_ASKS[i][0]}) THEN 0 "
    + " ".join(f"WHEN NOT bool_or({f}) THEN 1" for f in _ASKS[i][1]) + f" ELSE 2 END AS level, {_MOST[i]}::BIGINT AS most FROM quads GROUP BY graph"
    for i, (c, _) in enumerate(scoring.weights())
) + "), grades AS (SELECT *, most * level AS units, 2 * most AS max_units, most * level / 48.0::DOUBLE AS points FROM g) "

QUERIES = {f.__name__: f for f in (
    quads_from_tables, triple_counts, entity_type_counts, distinct_graphs, fetch_graph, graph_exists, ask_batch, graph_merge_distinct, graph_replace, graph_delete, bgp_optional_deps, construct_links,
    version_conflicts, digest_conflicts, seed_conflicts, hardware_conflicts, conflict_construct, conflict_counts, shape_violations, shape_conformance,
    score_criteria, score_dimensions, score_total, score_tiers, recommendations_ranked,
)}
_Q = "WITH " + QUADS
_VT = "SELECT 'conflict/' || md5('VersionConflict|' || pair || '|' || name || '|' || original_value || '|' || reproduction_value) AS s, original_value AS o, reproduction_value AS r FROM vc"
_TIER = "CASE WHEN raw >= 85 THEN 'excellent' WHEN raw >= 70 THEN 'good' WHEN raw >= 50 THEN 'fair' ELSE 'poor' END"
ORACLES = {
    "quads_from_tables": _Q + "SELECT * FROM quads",
    "triple_counts": _Q + "SELECT graph, count(*) AS n_triples FROM quads GROUP BY graph",
    "entity_type_counts": _Q + "SELECT o AS entity_type, count(*) AS n FROM quads WHERE p = 'rdf:type' GROUP BY o",
    "distinct_graphs": _Q + "SELECT DISTINCT graph FROM quads",
    "fetch_graph": _Q + "SELECT * FROM quads WHERE graph = 'study/7'",
    "graph_exists": _Q + "SELECT graph FROM (SELECT 'study/' || (n_nationkey * 2) AS graph FROM nation) n WHERE graph IN (SELECT graph FROM quads)",
    "ask_batch": _Q + """SELECT graph, bool_or(p = 'rdf:type' AND o = 'ResearchActivity') AS has_activity, bool_or(p = 'segment' AND o = 'BUILDING') AS has_building,
      bool_or(p = 'identifier' AND contains(o, 'doi.org')) AS has_doi, bool_or(p = 'accessLevel' AND o = 'open') AS has_open_data, bool_or(p = 'usedMethod') AS has_method FROM quads GROUP BY graph""",
    "graph_merge_distinct": _Q + "SELECT graph, count(*) AS n_triples FROM quads WHERE s LIKE 'activity/%' OR s LIKE 'software/%' GROUP BY graph",
    "graph_replace": _Q + """SELECT graph, count(*) AS n_triples FROM (SELECT graph, s FROM quads WHERE graph NOT IN ('study/0', 'study/1', 'study/2', 'study/3', 'study/4')
      UNION ALL SELECT 'study/' || n_nationkey, unnest(['type', 'title']) FROM nation WHERE n_nationkey < 5) x GROUP BY graph""",
    "graph_delete": _Q + "SELECT graph, count(*) AS n_triples FROM quads WHERE graph NOT IN (SELECT 'study/' || n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY graph",
    "bgp_optional_deps": """SELECT 'study/' || c_nationkey AS graph, 'activity/' || c_custkey AS s, c_name AS title, c_mktsegment AS segment, CASE WHEN c_acctbal > 9000 THEN 'https://doi.org/10.1/' || c_custkey END AS identifier,
      CASE WHEN c_custkey % 3 = 0 THEN 'dataset/' || c_custkey END AS dataset FROM customer""",
    "construct_links": """SELECT 'dataset/' || c_custkey AS s, unnest(['wasGeneratedBy', 'inGraph']) AS p, unnest(['activity/' || c_custkey, 'study/' || c_nationkey]) AS o FROM customer WHERE c_custkey % 3 = 0""",
    "version_conflicts": "WITH " + VERSION + "SELECT * FROM vc",
    "digest_conflicts": """SELECT DISTINCT a.pair, a.digest AS original_value, coalesce(b.digest, 'absent') AS reproduction_value
      FROM (SELECT o_custkey AS pair, md5(o_orderpriority) AS digest FROM orders WHERE o_orderkey % 7 <> 0) a
      LEFT JOIN (SELECT c_custkey AS pair, md5((c_custkey % 5 + 1) || '-URGENT') AS digest FROM customer WHERE c_custkey % 2 = 0) b ON a.pair = b.pair WHERE b.digest IS NULL OR a.digest <> b.digest""",
    "seed_conflicts": """WITH s AS (SELECT user_id, event_type AS name, day(ts) AS day, max((props->>'$.k')::INT)::VARCHAR AS value FROM events GROUP BY 1, 2, 3)
      SELECT a.user_id || ':' || a.day AS pair, a.name, a.value AS original_value, coalesce(b.value, 'absent') AS reproduction_value
      FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND a.name = b.name AND b.day = a.day + 1 WHERE b.value IS NULL OR a.value <> b.value""",
    "hardware_conflicts": "WITH " + HARDWARE + "SELECT * FROM hc",
    "conflict_construct": "WITH " + VERSION + f", t AS ({_VT}) " + """SELECT DISTINCT s, unnest(['rdf:type', 'conflictType', 'originalValue', 'reproductionValue', 'severity', 'message']) AS p,
      unnest(['VersionConflict', 'VersionConflict', o, r, 'HIGH', 'VersionConflict: ' || o || ' -> ' || r]) AS o FROM t""",
    "conflict_counts": "WITH " + VERSION + ", " + HARDWARE + f", t AS ({_VT}) " + """SELECT 'version' AS kind, (SELECT count(*) FROM vc) AS n_rows, count(DISTINCT s) AS n_conflicts, 6 * count(DISTINCT s) AS n_triples FROM t
      UNION ALL SELECT 'hardware', count(*), count(*), 6 * count(*) FROM hc""",
    "shape_violations": _SHAPES + "SELECT * FROM f",
    "shape_conformance": _SHAPES + """, c AS (SELECT graph, count(*) FILTER (severity = 'Violation') AS violations, count(*) FILTER (severity = 'Warning') AS warnings FROM f GROUP BY graph)
      SELECT g.graph, coalesce(violations, 0) AS violations, coalesce(warnings, 0) AS warnings, coalesce(violations, 0) = 0 AS conforms FROM (SELECT DISTINCT graph FROM quads) g LEFT JOIN c ON c.graph = g.graph""",
    "score_criteria": _GRADES + "SELECT graph, dimension, criterion, level, round_even(points, 2) AS points FROM grades",
    "score_dimensions": _GRADES + "SELECT graph, dimension, round_even(sum(units)::DOUBLE / 48, 2) AS score, round_even(sum(max_units)::DOUBLE / 48, 2) AS max_score FROM grades GROUP BY graph, dimension",
    "score_total": _GRADES + f"SELECT graph, round_even(raw, 2) AS total_score, round_even(100 * units::DOUBLE / max_units, 1) AS percent, {_TIER} AS tier FROM (SELECT graph, sum(units)::DOUBLE / 48 AS raw, sum(units) AS units, sum(max_units) AS max_units FROM grades GROUP BY graph) x",
    "score_tiers": _GRADES + f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM (SELECT graph, sum(units)::DOUBLE / 48 AS raw FROM grades GROUP BY graph) x) y GROUP BY tier",
    "recommendations_ranked": _GRADES + """SELECT graph, dimension, criterion, priority, level, points_available,
      row_number() OVER (PARTITION BY graph ORDER BY CASE priority WHEN 'essential' THEN 0 WHEN 'important' THEN 1 ELSE 2 END, points_available DESC, position) AS place
      FROM (SELECT *, round_even((max_units - units) / 48.0::DOUBLE, 2) AS points_available FROM grades WHERE level < 2) x""",
}
del W

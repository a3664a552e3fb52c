"""Queries over the driver tables taken as studies, configurations, runs and extractions; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprolens.functions import text as tx
from reprolens.functions import values as vx
from reprolens.operators import corpus, evaluation, extraction, outcomes, parsing, stats
from reprolens.sources.tables import table

C, L = F.col, F.lit


def s(x):
    return x.cast("string")


# --- strings ----------------------------------------------------------------------------------------


def _said(e):
    return F.when(e % 6 == 0, L("N/A")).when(e % 6 == 1, L("  none ")).when(e % 6 == 2, C("event_type")).when(e % 6 == 3, L("Not Specified")).when(e % 6 == 4, C("props"))


_SAID = "CASE event_id % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN '  none ' WHEN 2 THEN event_type WHEN 3 THEN 'Not Specified' WHEN 4 THEN props END"


def nullish_clean(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.clean(_said(C("event_id"))).alias("cleaned"))


def _named(spark, sf):
    p = table(spark, sf, "part")
    k = C("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.initcap("p_name"), L(" ("), F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", L(" "), L(2)), 1, 1))), L(")"))).when(k % 4 == 1, F.replace("p_name", L(" "), L("-"))).when(k % 4 == 2, F.concat(L("The "), C("p_name"), L(" "), C("p_type"))).otherwise(F.concat(C("p_brand"), L(" "), C("p_name")))
    return p.select("p_partkey", "p_size", name.alias("name"))


_NAMED = """n AS (SELECT p_partkey, p_size, CASE p_partkey % 4
  WHEN 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' (' || upper(p_name[1] || split_part(p_name, ' ', 2)[1]) || ')'
  WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN 'The ' || p_name || ' ' || p_type ELSE p_brand || ' ' || p_name END AS name FROM part)"""


def q_norm(x):
    return rf"trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def q_words(x):
    return f"list_filter(string_split({q_norm(x)}, ' '), lambda t: len(t) > 1 AND t NOT IN ({_STOP}))"


def q_initials(x):
    return f"CASE WHEN len({q_words(x)}) >= 2 THEN array_to_string(list_transform({q_words(x)}, lambda t: t[1]), '') END"


def q_acronyms(x):
    return rf"list_filter(list_append(list_transform(regexp_extract_all(coalesce({x}, ''), '\(([A-Za-z0-9-]{{2,}})\)', 1), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), {q_initials(x)}), lambda t: t IS NOT NULL)"


def q_facts(source, key, name):
    """Normal form (with and without spaces), tokens, acronyms and lower case without spaces of each name, as columns to compare."""
    return f"SELECT {key}, {name}, {q_norm(name)} AS nf, replace({q_norm(name)}, ' ', '') AS sq, list_distinct({q_words(name)}) AS tk, {q_acronyms(name)} AS ac, replace(lower(trim(coalesce({name}, ''))), ' ', '') AS pl FROM {source}"


def q_holds(a, b, least):
    """The shorter string, if long enough, occurs in the longer one."""
    return f"(least(len({a}), len({b})) >= {least} AND (CASE WHEN len({a}) <= len({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END))"


def q_match(a, b):
    both = f"len(list_intersect({a}.tk, {b}.tk))"
    return f"""({a}.nf <> '' AND {b}.nf <> '' AND ({a}.nf = {b}.nf OR list_contains({a}.ac, {b}.sq) OR list_contains({b}.ac, {a}.sq) OR len(list_intersect({a}.ac, {b}.ac)) > 0
      OR (len({a}.tk) > 0 AND len({b}.tk) > 0 AND {both}::DOUBLE / (len({a}.tk) + len({b}.tk) - {both}) >= 0.5) OR {q_holds(f'{a}.sq', f'{b}.sq', 4)}))"""


def q_metric(a, b):
    return f"({q_match(a, b)} OR {q_holds(f'{a}.pl', f'{b}.pl', 3)})"


def norm_names(spark, sf):
    return _named(spark, sf).select("p_partkey", tx.norm(C("name")).alias("normal"), F.size(tx.tokens(C("name"))).cast("long").alias("n_tokens"))


def acronym_initials(spark, sf):
    return _named(spark, sf).select("p_partkey", tx.initials(C("name")).alias("initials"), F.size(tx.acronyms(C("name"))).cast("long").alias("n_acronyms"))


def names_match_pairs(spark, sf):
    a = _named(spark, sf)
    b = a.select((C("p_partkey") - 3).alias("k"), C("name").alias("other"))
    return a.join(b, C("p_partkey") == C("k")).select("p_partkey", tx.names_match(C("name"), C("other")).alias("match"))


def token_jaccard(spark, sf):
    a = _named(spark, sf)
    b = a.select((C("p_partkey") - 1).alias("k"), C("name").alias("other"))
    return a.join(b, C("p_partkey") == C("k")).select("p_partkey", F.round(tx.jaccard(tx.tokens(C("name")), tx.tokens(C("other"))), 4).alias("similarity"))


def slugify(spark, sf):
    return _named(spark, sf).select("p_partkey", tx.slug(F.when(C("p_partkey") % 9 != 0, F.concat(L("--"), C("name"), L("//v2.")))).alias("slug"))


def url_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.repo_key(C("url")).alias("repo"))


def arxiv_id(spark, sf):
    k = C("o_orderkey")
    raw = F.when(k % 3 == 0, F.format_string("%04d.%05dv%d", (k % 2500).cast("int"), (k % 99999).cast("int"), (k % 9).cast("int"))).when(k % 3 == 1, F.format_string("%04d.%05d", (k % 2500).cast("int"), (k % 99999).cast("int"))).otherwise(L("none"))
    return table(spark, sf, "orders").select("o_orderkey", tx.arxiv_id(raw).alias("arxiv"), tx.pdf_url(F.concat(L("http://arxiv.org/abs/"), raw)).alias("pdf"))


def canon_value(spark, sf):
    v = C("l_quantity")
    raw = F.when(C("l_linenumber") % 3 == 0, F.concat(s(v), L("%"))).when(C("l_linenumber") % 3 == 1, F.concat(L("1,"), F.lpad(s(v.cast("int")), 3, "0"))).when(C("l_linenumber") % 3 == 2, F.concat(s(v.cast("int")), L("d")))
    return table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", F.round(vx.number(raw), 6).alias("number")).groupBy("l_linenumber", "number").agg(F.count("*").alias("n"))


# --- configuration files ----------------------------------------------------------------------------


def license_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parsing.licence(C("text")).alias("licence"))


_LICENCE = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(t, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in parsing.LICENCES) + " ELSE 'LicenseRef-Custom' END"


def seed_keyword(spark, sf):
    said = F.concat(C("text"), F.when(C("turn") % 4 == 0, L(" set_seed(1)")).when(C("turn") % 4 == 1, L(" Reproducible")).otherwise(L("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", parsing.mentions_seed(said).alias("has_seed"))


def _line(k):
    return F.when(k % 7 == 0, L("# comment")).when(k % 7 == 1, F.concat(F.replace(C("p_brand"), L("#"), L("-")), L("=="), s(C("p_size")), L(".0"))).when(k % 7 == 2, F.concat(F.replace(C("p_name"), L(" "), L("_")), L("[extra] >= "), s(C("p_size")), L(", <99  # note"))).when(k % 7 == 3, L("-r other.txt")).when(k % 7 == 4, F.concat(F.replace(C("p_name"), L(" "), L("-")), L("; python_version < '3.9'"))).when(k % 7 == 5, F.concat(C("p_type"), L(" @ https://x.org/a.whl"))).otherwise(L("  "))


def requirement_parse(spark, sf):
    return table(spark, sf, "part").select("p_partkey", parsing.requirement(_line(C("p_partkey"))).alias("r")).filter("r is not null").select("p_partkey", "r.name", "r.version", "r.kind")


def conda_parse(spark, sf):
    k = C("p_partkey")
    entry = F.when(k % 5 == 0, F.concat(L("conda-forge::"), F.replace(C("p_name"), L(" "), L("-")), L("=1."), s(C("p_size")), L("=py"), s(k % 9))).when(k % 5 == 1, F.concat(C("p_type"), L("=="), s(C("p_size")))).when(k % 5 == 2, F.concat(C("p_type"), L(">="), s(C("p_size")), L(",<60"))).when(k % 5 == 3, F.concat(F.replace(C("p_name"), L(" "), L("_")), L("=2."), s(C("p_size")))).otherwise(F.replace(C("p_name"), L(" "), L(".")))
    d = parsing.conda_dependency(entry)
    return table(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.channel", "d.name", "d.version", "d.build")


def dockerfile_parse(spark, sf):
    k = C("s_suppkey")
    text = F.concat(L("FROM ubuntu:20.04 AS base\nENV LANG=C\n"), F.when(k % 3 == 0, F.concat(L("ENV CUDA_VERSION=11."), s(k % 9), L("\n"))).otherwise(L("")), L("FROM org/image:"), F.when(k % 2 == 0, F.concat(L("2."), s(k % 5), L("-cuda12."), s(k % 4), L("-cudnn8"))).otherwise(F.concat(L("py3."), s(k % 12), L("@sha256:"), F.md5("s_name"))), L("\nRUN pip install x\n"))
    d = parsing.dockerfile(text)
    return table(spark, sf, "supplier").select("s_suppkey", d.alias("d")).select("s_suppkey", "d.image", "d.digest", C("d.n_env").cast("long").alias("n_env"), "d.cuda", "d.python")


def version_nearest(spark, sf):
    return table(spark, sf, "part").select("p_partkey", parsing.nearest_version(F.concat(L("3."), s(C("p_size") % 16), L(".1"))).alias("version"))


def specifier_max(spark, sf):
    k = C("p_size")
    spec = F.when(k % 4 == 0, F.concat(L(">=3."), s(k % 14))).when(k % 4 == 1, F.concat(L(">=3."), s(k % 10), L(", <3."), s(k % 7 + 8))).when(k % 4 == 2, F.concat(L("==3."), s(k % 14))).otherwise(F.concat(L("<=3."), s(k % 14), L(",!=3.9")))
    return table(spark, sf, "part").select("p_partkey", parsing.highest_version(spec).alias("version"))


def _files(spark, sf):
    k = C("p_partkey")
    name = F.when(k % 6 == 0, "Dockerfile").when(k % 6 == 1, "requirements.txt").when(k % 6 == 2, "requirements-dev.txt").when(k % 6 == 3, "environment.yml").when(k % 6 == 4, "setup.py").otherwise("notes.md")
    folder = F.when(k % 5 == 0, "").when(k % 5 == 1, "src/").when(k % 5 == 2, "docs/").when(k % 5 == 3, "a/b/").otherwise("node_modules/x/")
    return table(spark, sf, "part").select(C("p_size").alias("repo"), F.concat(folder, name).alias("path")).distinct()


def artifact_rank(spark, sf):
    return parsing.artifacts(_files(spark, sf)).withColumn("depth", C("depth").cast("long")).withColumn("place", C("place").cast("long"))


def artifact_primary(spark, sf):
    return parsing.primary(parsing.artifacts(_files(spark, sf)))


_FILES = """f AS (SELECT DISTINCT p_size AS repo, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'a/b/' ELSE 'node_modules/x/' END
  || CASE p_partkey % 6 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'requirements-dev.txt' WHEN 3 THEN 'environment.yml' WHEN 4 THEN 'setup.py' ELSE 'notes.md' END AS path FROM part),
r AS (SELECT repo, path, CASE WHEN path LIKE '%Dockerfile' THEN 'docker' WHEN path LIKE '%environment.yml' THEN 'conda' WHEN path LIKE '%.txt' THEN 'pip' WHEN path LIKE '%setup.py' THEN 'setup' END AS type, len(path) - len(replace(path, '/', '')) AS depth FROM f WHERE path NOT LIKE 'node_modules%'),
a AS (SELECT repo, type, path, depth, row_number() OVER (PARTITION BY repo, type ORDER BY depth, CASE WHEN path LIKE '%requirements-dev.txt' THEN 1 ELSE 0 END, CASE WHEN path LIKE 'docs/%' THEN 1 ELSE 0 END, path) AS place FROM r WHERE type IS NOT NULL)"""


# --- runs -------------------------------------------------------------------------------------------


def _pairs(spark, sf):
    x = C("l_quantity")
    claimed = F.when(C("l_linenumber") == 3, F.concat(s(x), L("%"))).when(C("l_linenumber") == 4, L("Best")).otherwise(s(x))
    got = F.when(C("l_linenumber") == 3, s(F.round(x / 100 + C("l_tax") / 2, 4))).when(C("l_linenumber") == 4, F.when(C("l_discount") > 0.05, L(" best")).otherwise(L("worst"))).otherwise(s(F.round(x * (1 + C("l_discount")), 3)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", claimed.alias("claimed"), got.alias("obtained"))


def classify_pairs(spark, sf):
    return _pairs(spark, sf).withColumn("result", vx.classify_pair(C("claimed"), C("obtained"))).groupBy("l_linenumber", "l_returnflag", "result").agg(F.count("*").alias("n"))


_PAIRS = """p AS (SELECT l_linenumber, l_returnflag,
  CASE l_linenumber WHEN 3 THEN l_quantity / 100 WHEN 4 THEN NULL ELSE l_quantity END AS c, CASE l_linenumber WHEN 3 THEN round(l_quantity / 100 + l_tax / 2, 4) WHEN 4 THEN NULL ELSE round(l_quantity * (1 + l_discount), 3) END AS o, l_discount FROM lineitem),
k AS (SELECT *, CASE WHEN l_linenumber = 4 THEN l_discount > 0.05 ELSE abs(c - o) <= 0.01 OR abs(c - o) / CASE WHEN abs(c) <= 1e-9 THEN 1.0 ELSE abs(c) END <= 0.05 END AS ok FROM p)"""


def compare_entry_status(spark, sf):
    """Customers as studies: each order claims its priority's metric, and gives a result for it."""
    o = table(spark, sf, "orders")
    claims = o.select(C("o_custkey").alias("study"), C("o_orderkey").alias("pos"), F.concat(L("Top-1 "), C("o_orderpriority")).alias("metric"), s(F.round(C("o_totalprice") / 1000, 1)).alias("value"), F.when(C("o_orderkey") % 2 == 0, L("test")).alias("split"))
    got = o.select(C("o_custkey").alias("study"), C("o_orderkey").alias("pos"), C("o_orderpriority").alias("metric"), s(F.round(C("o_totalprice") / 990, 1)).alias("value"), L(None).cast("string").alias("split"))
    return outcomes.status(outcomes.compare(claims, got))


_LOGS = ("MuJoCo is missing", "sh: unzip: not found", "HTTP 404 Not Found", "error 500 from host", "403 while download", "403 forbidden", "CUDA out of memory", "Host key verification failed", "Permission denied (publickey)", "No module named 'torch.nn'", "failed to build editable wheel", "Invalid pyproject.toml", "No such file or directory", "killed", "mujoco No module named 'x'")


def _log(e):
    out = None
    for i, text in enumerate(_LOGS):
        out = F.when(e % len(_LOGS) == i, text) if out is None else out.when(e % len(_LOGS) == i, text)
    return F.concat(L("run "), s(C("user_id")), L(": "), out)


def failure_taxonomy(spark, sf):
    return table(spark, sf, "events").select(outcomes.classify_failure(_log(C("event_id"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_REASON_OF = ("missing_system_dep:mujoco", "missing_tool:unzip", "dead_download:404", "dead_download:500", "gated_download:403", "run_error:other", "gpu_oom", "auth_ssh", "auth_ssh", "missing_dependency:torch.nn", "install_build_error", "install_build_error", "missing_file_or_data", "run_error:other", "missing_system_dep:mujoco")
_REASONS = "CASE event_id % 15 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASON_OF)) + " END"
_GIVEN = ("skip: repo mismatch", "Skipped: beyond one GPU", "skip no claimed metric", "skip: processing time", "skip production A/B", "skip needs device", "skip", "no_recipe", "placeholder_recipe", "missing_dependency:x", "missing_tool:unzip", "dead_download:404", "install_build_error", "gpu_oom", "auth_ssh", "missing_file_or_data", "no_metric_in_log", "run_error:other", "something", "")
_FAMILY_OF = ("repo/paper mismatch", "out of compute scale", "no numeric claim", "hardware-bound metric", "production/online metric", "external device/API", "skipped (other)", "no documented recipe", "placeholder recipe", "missing python dependency", "missing system dependency", "dead/gated download (link rot)", "broken install/build", "GPU out of memory", "auth/SSH clone", "missing data/file", "ran, metric not parsed", "run error (other)", "something", "-")


def blocker_family(spark, sf):
    reason = F.element_at(F.array(*map(L, _GIVEN)), (C("event_id") % len(_GIVEN) + 1).cast("int"))
    return table(spark, sf, "events").select("user_id", outcomes.family(reason).alias("family")).groupBy("user_id", "family").agg(F.count("*").alias("n"))


def placeholder_commands(spark, sf):
    k = C("o_orderkey")
    command = F.concat(L("python run.py --data "), F.when(k % 4 == 0, "/path/to/data").when(k % 4 == 1, "$CHECKPOINT").when(k % 4 == 2, "/data/x").otherwise("pathology"))
    return table(spark, sf, "orders").select("o_orderkey", outcomes.is_placeholder(command).alias("placeholder"))


def last_number_near_token(spark, sf):
    log = F.concat(L("epoch 1 "), C("event_type"), L(" rate: "), s(C("value")), L("\nfinal "), F.upper("event_type"), L(" = "), s(C("value") + 1), L("% done"))
    return table(spark, sf, "events").select("event_id", outcomes.last_number_near(log, F.when(C("event_id") % 7 == 0, L("(none)")).otherwise(F.initcap("event_type"))).alias("found"))


def status_counts(spark, sf):
    return outcomes.tally(table(spark, sf, "orders"), "o_orderpriority").withColumn("place", C("place").cast("long"))


def funnel(spark, sf):
    return outcomes.funnel(table(spark, sf, "orders"), {"attempted": C("o_orderstatus") != "P", "resolved": C("o_totalprice") > 100000, "built": C("o_orderpriority").startswith("1") | C("o_orderpriority").startswith("2"), "reproduced": C("o_custkey") % 5 == 0})


def rate_summary(spark, sf):
    r = table(spark, sf, "lineitem")
    return r.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(C("l_returnflag") == "R").alias("n_returned"), F.round(100.0 * F.count_if(C("l_returnflag") == "R") / F.count("*"), 1).alias("percent"))


# --- evaluation -------------------------------------------------------------------------------------


def _confusion(spark, sf):
    """A crude rule against the labels: a document is good if it has no bars, shouts or stars."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    said = ~C("text").rlike(r"[|!*]")
    field = F.element_at(F.array(*map(L, ("methods", "datasets", "software", "environment", "random_seeds"))), (C("doc_id") % 5 + 1).cast("int"))
    hit = lambda t: t.cast("long")
    return d.select("doc_id", "lang", "source", field.alias("field"), hit(said & (C("quality") == 1)).alias("tp"), hit(said & (C("quality") == 0)).alias("fp"), hit(~said & (C("quality") == 1)).alias("fn"))


_CONF = """d AS (SELECT doc_id, lang, source, ['methods', 'datasets', 'software', 'environment', 'random_seeds'][(doc_id % 5 + 1)::INT] AS field, NOT regexp_matches(text, '[|!*]') AS said, quality FROM documents JOIN labels USING (doc_id)),
c AS (SELECT doc_id, lang, source, field, (said AND quality = 1)::BIGINT AS tp, (said AND quality = 0)::BIGINT AS fp, (NOT said AND quality = 1)::BIGINT AS fn FROM d)"""


def q_prf(source, *key):
    k = "".join(f"{x}, " for x in key)
    by = f" GROUP BY {', '.join(key)}" if key else ""
    return f"""SELECT {k}tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + fn)::BIGINT AS support, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0::DOUBLE END AS r FROM (SELECT {k}sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {source}{by}) x) y"""


def prf_micro(spark, sf):
    return evaluation.prf(_confusion(spark, sf), "lang")


def prf_macro(spark, sf):
    return evaluation.macro_f1(_confusion(spark, sf), "source", "lang")


def prf_groups(spark, sf):
    return evaluation.by_group(_confusion(spark, sf))


def _entities(spark, sf, side: int):
    n = _named(spark, sf).filter(C("p_partkey") % 2 == side)
    return n.select(C("p_size").alias("study"), F.when(C("p_partkey") % 5 == 0, L("methods")).otherwise(L("datasets")).alias("field"), C("p_partkey").cast("int").alias("pos"), F.when(C("p_partkey") % 11 != 0, C("name")).alias("name"))


def greedy_match(spark, sf):
    return evaluation.greedy_match(_entities(spark, sf, 0), _entities(spark, sf, 1))


def greedy_match_exact(spark, sf):
    """One-to-one by equal normal forms: the least of both counts for each form, whatever the order."""
    return evaluation.greedy_match(_entities(spark, sf, 0), _entities(spark, sf, 1), fuzzy=False)


def recipe_f1(spark, sf):
    g, p = (_entities(spark, sf, side).filter("name is not null").select("study", "name") for side in (0, 1))
    return evaluation.set_f1(g, p, "study", "name")


def step_jaccard(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(evaluation.step_jaccard(F.concat(L("pip install "), C("p_name")), F.when(C("p_partkey") % 6 != 0, F.concat(L("pip  install "), C("p_type"), L(" "), F.split_part("p_name", L(" "), L(1))))), 4).alias("similarity"))


def ground_tokens(spark, sf):
    """All benchmark items, with their whole texts as names, against all documents."""
    b = table(spark, sf, "benchmark")
    g = evaluation.grounding(b, table(spark, sf, "documents"), "item_id", "text", "doc_id", "text").groupBy("item_id").agg(F.count("*").alias("n"))
    return b.select("item_id").join(g, "item_id", "left").select("item_id", F.coalesce("n", L(0)).alias("n_grounded"))


def value_grounded(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", evaluation.value_grounded(F.concat(s(C("user_id")), L(" of "), s(C("value"))), F.concat(C("props"), s(C("event_id")))).alias("grounded"))


# --- extraction -------------------------------------------------------------------------------------


def chunk_words(spark, sf):
    c = extraction.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", C("pos").cast("long").alias("pos"), C("n_words").cast("long").alias("n_words"), F.md5("chunk").alias("chunk_md5"))


_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i AS pos, list_slice(w, i * 175 + 1, i * 175 + 200) AS c FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 175)) AS i FROM w WHERE len(w) > 0) x)"""


def chunk_stats(spark, sf):
    c = extraction.chunks(table(spark, sf, "documents"), "doc_id", "text", 400, 50)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_words").cast("long").alias("n_words"))


def section_isolation(spark, sf):
    k = C("doc_id")
    text = F.concat(F.when(k % 3 == 0, L("Intro\n2. Experimental Setup\n")).otherwise(L("Intro\n")), C("text"), F.when(k % 2 == 0, L("\n3. Results\nx")).otherwise(L("")))
    return table(spark, sf, "documents").select("doc_id", extraction.section(text).alias("x")).select("doc_id", C("x.first").cast("long").alias("first_line"), C("x.last").cast("long").alias("last_line"), C("x.found").alias("found"))


def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return extraction.top_k(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3).withColumn("place", C("place").cast("long"))


def passage_dedup(spark, sf):
    return extraction.distinct_passages(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def merge_first_wins(spark, sf):
    e = table(spark, sf, "events")
    return extraction.first_wins(e, "user_id", tx.clean(F.when(C("event_id") % 9 == 0, L("null")).otherwise(C("event_type"))), s(C("value")), "event_id")


def first_nonnull(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return extraction.first_known(e, "user_id", {"gpu": F.when(C("event_type") == "error", C("k")), "cuda": F.when(C("k") > 90, C("value")), "cpu": F.when(C("k") > 1000, C("k"))}, "event_id")


def seeds_union(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("seeds"))


def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def json_repair(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(C("event_id") % 4 == 0, F.concat(L("```json\n"), C("props"), L("\n```"))).when(C("event_id") % 4 == 1, F.concat(L("Sure: "), C("props"), L(" done"))).when(C("event_id") % 4 == 2, F.concat(L('{"k": ['), F.get_json_object("props", "$.k"))).otherwise(L("no object"))
    return e.select("event_id", extraction.repaired(raw).alias("json"))


def recipe_normalise(spark, sf):
    k = C("p_partkey")
    raw = F.concat(L('{"run_command": '), F.when(k % 3 == 0, L('" None "')).otherwise(F.concat(L('"python '), C("p_type"), L('.py"'))), L(', "setup_steps": '), F.when(k % 2 == 0, L('"make"')).otherwise(L('["a", "b"]')), F.when(k % 5 == 0, L(', "confidence": "HIGH"')).otherwise(L("")), L(', "requires_dataset": [{"name": "d", "download": "wget"}]}'))
    r = extraction.normalise_recipe(raw)
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.run_command", F.array_join("r.setup_steps", "; ").alias("steps"), F.size("r.requires_dataset").cast("long").alias("n_data"), F.size("r.produces_metric").cast("long").alias("n_metrics"), "r.confidence")


def joined_documents(spark, sf, most=16_000):
    c = table(spark, sf, "conversations").withColumn("rank", F.when(C("role") == "system", 0).when(C("role") == "user", 1).otherwise(2)).withColumn("name", F.format_string("%03d", C("turn")))
    return extraction.joined_documents(c, "conv_id", "name", "rank", "text", most).select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def python_resolver(spark, sf):
    k = C("p_partkey")
    r = parsing.resolve_python(F.when(k % 7 == 0, F.concat(L("python=3."), s(k % 5 + 7))), F.when(k % 5 == 0, F.concat(L("python:3."), s(k % 4 + 8), L("-slim"))), F.when(k % 3 == 0, F.concat(L(">=3."), s(k % 15))), F.when(k % 2 == 0, L(">=3.7,<3.10")), F.when(k % 11 == 0, L("python-3.10.4")))
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.version", "r.source")


def docker_inspect(spark, sf):
    k = C("s_suppkey")
    raw = F.concat(L('[{"Id": "sha256:'), F.md5("s_name"), L('", "RepoDigests": ['), F.when(k % 2 == 0, F.concat(L('"org/x@sha256:'), F.md5("s_name"), L('"'))).otherwise(L("")), L('], "Os": "linux", "Config": {"Env": ["PATH=/bin"'), F.when(k % 3 == 0, F.concat(L(', "CUDA_VERSION=11.'), s(k % 9), L('"'))).when(k % 3 == 1, L(', "NV_CUDA_LIB_VERSION=12.1"')).otherwise(L("")), L('], "Labels": {"a": "b"}}}]'))
    d = parsing.docker_inspect(raw)
    return table(spark, sf, "supplier").select("s_suppkey", d.alias("d")).select("s_suppkey", "d.*")


def study_model_grid(spark, sf):
    """Studies and models that have no marker yet."""
    models = F.broadcast(table(spark, sf, "region").select(C("r_name").alias("model")))
    done = table(spark, sf, "nation").select(C("n_nationkey").alias("study"), F.concat(L("REGION_"), s(C("n_regionkey"))).alias("model"))
    every = table(spark, sf, "nation").select(C("n_nationkey").alias("study")).join(models)
    return corpus.remaining(every, done.withColumn("model", F.upper("model")), "study", "model").select("study", F.length("model").cast("long").alias("n"))


def reference_present(spark, sf):
    """Reference entries with their band, scored if their graph is there, else skipped."""
    wanted = table(spark, sf, "customer").select(C("c_custkey").alias("study"), F.when(C("c_acctbal") > 0, "high").otherwise("low").alias("band"))
    have = table(spark, sf, "orders").select(C("o_custkey").alias("study"))
    status = evaluation.pair_up(wanted, have, "study")
    return wanted.join(status, "study").groupBy("band", "status").agg(F.count("*").alias("n"))


def common_fields(spark, sf):
    """Predicted metadata as long rows, counted by field."""
    e = table(spark, sf, "events")
    name = F.when(C("event_id") % 10 == 0, L("Modern GPUs")).otherwise(C("event_type"))
    one = lambda *fields: F.array(F.struct(*fields))
    meta = F.struct(one(name.alias("name"), L("1").alias("version")).alias("dependencies"), one(name.alias("name")).alias("datasets"), one(C("event_type").alias("name")).alias("methods"), one(name.alias("name"), s(C("value")).alias("value")).alias("hyperparameters"), one(name.alias("metric"), L("n/a").alias("split"), s(C("value")).alias("value")).alias("evaluation_results"), F.array(F.get_json_object("props", "$.k").cast("long")).alias("random_seeds"), F.struct(F.when(C("event_type") == "error", L("A100")).otherwise(L(" none ")).alias("gpu_model"), s(C("user_id")).alias("cuda_version")).alias("hardware"))
    rows = evaluation.predicted_fields(e.select(s(C("event_id")).alias("study_id"), meta.alias("metadata")))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"), F.count("value").alias("n_value"))


# --- statistics and corpus --------------------------------------------------------------------------


def summary_stats(spark, sf):
    return stats.summary(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


def _banded(spark, sf):
    return table(spark, sf, "supplier").withColumn("band", F.when(C("s_nationkey") % 3 == 0, "high").when(C("s_nationkey") % 3 == 1, "medium").otherwise("low"))


def band_stats(spark, sf):
    return stats.summary(_banded(spark, sf), "band", "s_acctbal")


def separation(spark, sf):
    return stats.separation(_banded(spark, sf), "band", "s_acctbal", "high", "low")


def concordance(spark, sf):
    return stats.concordance(table(spark, sf, "supplier").withColumn("band", C("s_nationkey") % 3), "band", "s_acctbal")


def spearman(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_linestatus")


def mannwhitney_u(spark, sf):
    return stats.mann_whitney(table(spark, sf, "orders"), C("o_orderstatus") == "F", "o_totalprice")


def logit_fit(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("toxic", (C("lang") == "en").cast("double").alias("english"), F.log1p("n_chars").alias("length"))
    return stats.logit(d, "toxic", ["english", "length"])


def dedup_two_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("body"), F.concat_ws(":", "lang", s(C("n_chars"))).alias("size_key"))
    return corpus.keep_first_two_keys(d, "body", "size_key", "doc_id").select("doc_id", "body", "size_key")


def dedup_exact(spark, sf):
    return corpus.keep_first(table(spark, sf, "documents"), F.lower(F.trim("text")), "doc_id").select("doc_id")


def drop_reasons(spark, sf):
    d = table(spark, sf, "documents")
    return corpus.reasons(d, {"too_short": C("n_chars") >= 300, "language": C("lang").isin("en", "de"), "symbols": ~C("text").rlike(r"[|%]"), "source": ~C("source").isin("src3", "src7")})


def _scored(spark, sf):
    p = C("p_partkey")
    points = corpus.score(docker=(p % 3 == 0, 3), conda=(p % 4 == 0, 2), pip=(p % 2 == 0, 1), setup=(C("p_size") > 40, 1), seed=(C("p_type") == "SMALL", 2), stars=(C("p_retailprice") > 950, 1))
    return table(spark, sf, "part").select("p_partkey", points.cast("long").alias("b_score"))


def additive_score(spark, sf):
    return _scored(spark, sf).withColumn("tier", corpus.tier(C("b_score")))


def quota_fill(spark, sf):
    return corpus.quota(_scored(spark, sf), "b_score", "p_partkey")


def key_format(spark, sf):
    return corpus.keys(table(spark, sf, "nation").select("n_name", "n_regionkey"), "study%03d", "n_regionkey", "n_name")


def seeded_shuffle(spark, sf):
    return table(spark, sf, "part").select("p_partkey", corpus.seeded_order(C("p_partkey")).alias("o")).orderBy("o", "p_partkey").limit(50).select("p_partkey")


def left_join_attrs(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "c_mktsegment", "n_orders")


def tier_coalesce(spark, sf):
    first = table(spark, sf, "labels").filter("doc_id % 2 = 0").select("doc_id", F.when(C("toxic") == 0, C("quality")).alias("claim"))
    second = table(spark, sf, "labels").select("doc_id", C("toxic").alias("claim"))
    return corpus.by_tier(table(spark, sf, "documents").select("doc_id"), first, second, "doc_id", "claim")


def anti_resume(spark, sf):
    return corpus.remaining(table(spark, sf, "customer").select(C("c_custkey").alias("k")), table(spark, sf, "orders").select(C("o_custkey").alias("k")), "k")


_SCORED = "sc AS (SELECT p_partkey, ((p_partkey % 3 = 0)::INT * 3 + (p_partkey % 4 = 0)::INT * 2 + (p_partkey % 2 = 0)::INT + (p_size > 40)::INT + (p_type = 'SMALL')::INT * 2 + (p_retailprice > 950)::INT)::BIGINT AS b_score FROM part)"
_BANDED = "bd AS (SELECT *, CASE s_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band FROM supplier)"


def q_summary(source, key, value):
    return f"SELECT {key}, count({value}) AS n, round(avg({value}), 4) AS mean, round(median({value}), 4) AS median, min({value}) AS least, max({value}) AS most FROM {source} GROUP BY {key}"


def q_rank(v, by):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


QUERIES = {f.__name__: f for f in (
    nullish_clean, norm_names, acronym_initials, names_match_pairs, token_jaccard, slugify, url_clean, arxiv_id, canon_value, license_detect, seed_keyword, requirement_parse, conda_parse, dockerfile_parse,
    version_nearest, specifier_max, artifact_rank, artifact_primary, classify_pairs, compare_entry_status, failure_taxonomy, blocker_family, placeholder_commands, last_number_near_token, status_counts, funnel, rate_summary,
    prf_micro, prf_macro, prf_groups, greedy_match, greedy_match_exact, recipe_f1, step_jaccard, ground_tokens, value_grounded, chunk_words, chunk_stats, section_isolation, vector_topk, passage_dedup, merge_first_wins, first_nonnull,
    seeds_union, json_fields, json_repair, summary_stats, band_stats, separation, concordance, spearman, mannwhitney_u, logit_fit, dedup_two_keys, dedup_exact, drop_reasons, additive_score, quota_fill, key_format, seeded_shuffle,
    left_join_attrs, tier_coalesce, anti_resume, recipe_normalise, joined_documents, python_resolver, docker_inspect, study_model_grid, reference_present, common_fields,
)}

ORACLES = {
    "nullish_clean": f"SELECT event_id, CASE WHEN lower(trim(x)) IN ({', '.join(repr(v) for v in tx.NULLISH_EXTRACTION)}) THEN NULL ELSE x END AS cleaned FROM (SELECT event_id, {_SAID} AS x FROM events) t",
    "norm_names": f"WITH {_NAMED} SELECT p_partkey, {q_norm('name')} AS normal, len(list_distinct({q_words('name')})) AS n_tokens FROM n",
    "acronym_initials": f"WITH {_NAMED} SELECT p_partkey, {q_initials('name')} AS initials, len(list_distinct({q_acronyms('name')})) AS n_acronyms FROM n",
    "names_match_pairs": f"WITH {_NAMED}, x AS ({q_facts('n', 'p_partkey', 'name')}) SELECT a.p_partkey, {q_match('a', 'b')} AS match FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 3",
    "token_jaccard": f"WITH {_NAMED}, x AS ({q_facts('n', 'p_partkey', 'name')}) SELECT a.p_partkey, round(len(list_intersect(a.tk, b.tk))::DOUBLE / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))), 4) AS similarity FROM x a JOIN x b ON b.p_partkey = a.p_partkey + 1",
    "slugify": f"WITH {_NAMED} SELECT p_partkey, coalesce(trim(regexp_replace(lower(CASE WHEN p_partkey % 9 <> 0 THEN '--' || name || '//v2.' END), '[^a-z0-9]+', '-', 'g'), '-'), 'default') AS slug FROM n",
    "url_clean": r"""SELECT page_id, CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] || '/' || regexp_replace(p[3], '\.git$', '') END AS repo
      FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages) t""",
    "arxiv_id": r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN base END AS arxiv, CASE WHEN o_orderkey % 3 < 2 THEN 'https://arxiv.org/pdf/' || base || '.pdf' ELSE 'http://arxiv.org/abs/none' END AS pdf
      FROM (SELECT o_orderkey, printf('%04d.%05d', o_orderkey % 2500, o_orderkey % 99999) AS base FROM orders) t""",
    "canon_value": "SELECT l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 100 WHEN 1 THEN 1000 + l_quantity::INT END, 6) AS number, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "license_detect": f"SELECT doc_id, {_LICENCE} AS licence FROM (SELECT doc_id, lower(substr(text, 1, 4000)) AS t FROM documents) x",
    "seed_keyword": "SELECT conv_id, turn, (" + " OR ".join(f"contains(t, '{p}')" for p in parsing.SEED_PHRASES) + ") AS has_seed FROM (SELECT conv_id, turn, lower(text || CASE turn % 4 WHEN 0 THEN ' set_seed(1)' WHEN 1 THEN ' Reproducible' ELSE '' END) AS t FROM conversations) x",
    "requirement_parse": """SELECT p_partkey, lower(replace(CASE p_partkey % 7 WHEN 1 THEN replace(p_brand, '#', '-') WHEN 5 THEN p_type ELSE replace(p_name, ' ', '_') END, '-', '_')) AS name,
      CASE p_partkey % 7 WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_size::VARCHAR ELSE 'unspecified' END AS version, CASE p_partkey % 7 WHEN 1 THEN 'pinned' WHEN 2 THEN 'bounded' WHEN 4 THEN 'free' ELSE 'url' END AS kind FROM part WHERE p_partkey % 7 IN (1, 2, 4, 5)""",
    "conda_parse": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'conda-forge' END AS channel, lower(CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 3 THEN replace(p_name, ' ', '_') WHEN 4 THEN replace(p_name, ' ', '.') ELSE p_type END) AS name,
      CASE p_partkey % 5 WHEN 0 THEN '1.' || p_size WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN '2.' || p_size ELSE 'unspecified' END AS version, CASE WHEN p_partkey % 5 = 0 THEN 'py' || (p_partkey % 9) END AS build FROM part""",
    "dockerfile_parse": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'org/image:2.' || (s_suppkey % 5) || '-cuda12.' || (s_suppkey % 4) || '-cudnn8' ELSE 'org/image:py3.' || (s_suppkey % 12) || '@sha256:' || md5(s_name) END AS image,
      CASE WHEN s_suppkey % 2 = 1 THEN 'sha256:' || md5(s_name) END AS digest, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_env,
      CASE WHEN s_suppkey % 3 = 0 THEN '11.' || (s_suppkey % 9) WHEN s_suppkey % 2 = 0 THEN '12.' || (s_suppkey % 4) END AS cuda, CASE WHEN s_suppkey % 2 = 1 THEN '3.' || (s_suppkey % 12) END AS python FROM supplier""",
    "version_nearest": "SELECT p_partkey, '3.' || greatest(8, least(12, p_size % 16)) AS version FROM part",
    "specifier_max": """SELECT p_partkey, '3.' || (SELECT max(v) FROM (SELECT unnest([8, 9, 10, 11, 12]) AS v) l WHERE CASE p_size % 4 WHEN 0 THEN v >= p_size % 14 WHEN 1 THEN v >= p_size % 10 AND v < p_size % 7 + 8 WHEN 2 THEN v = p_size % 14 ELSE v <= p_size % 14 AND v <> 9 END) AS version FROM part""",
    "artifact_rank": f"WITH {_FILES} SELECT * FROM a",
    "artifact_primary": f"WITH {_FILES} SELECT repo, type, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE type WHEN 'docker' THEN 1 WHEN 'conda' THEN 2 WHEN 'pip' THEN 3 ELSE 4 END) AS n FROM a WHERE place = 1) x WHERE n = 1",
    "classify_pairs": f"WITH {_PAIRS} SELECT l_linenumber, l_returnflag, CASE WHEN ok THEN 'reproduced' ELSE 'mismatch' END AS result, count(*) AS n FROM k GROUP BY ALL",
    "compare_entry_status": f"""WITH k AS (SELECT DISTINCT o_orderpriority AS b, 'Top-1 ' || o_orderpriority AS a FROM orders), x AS ({q_facts('k', 'b', 'a')}), y AS ({q_facts('k', 'a', 'b')}),
      m AS (SELECT x.b AS claimed_as, y.b AS found_as FROM x CROSS JOIN y WHERE {q_metric('x', 'y')}),
      p AS (SELECT c.o_custkey AS study, c.o_orderkey, round(c.o_totalprice / 1000, 1) AS claimed, arg_min(round(g.o_totalprice / 990, 1), g.o_orderkey) AS obtained
        FROM orders c LEFT JOIN (SELECT claimed_as, o.* FROM orders o JOIN m ON m.found_as = o.o_orderpriority) g ON g.o_custkey = c.o_custkey AND g.claimed_as = c.o_orderpriority GROUP BY c.o_custkey, c.o_orderkey, c.o_totalprice),
      r AS (SELECT study, CASE WHEN obtained IS NULL THEN 'missing' WHEN abs(claimed - obtained) <= 0.01 OR abs(claimed - obtained) / CASE WHEN abs(claimed) <= 1e-9 THEN 1.0 ELSE abs(claimed) END <= 0.05 THEN 'reproduced' ELSE 'mismatch' END AS result FROM p)
      SELECT study, count(*) AS n_claims, count(*) FILTER (result = 'reproduced') AS n_reproduced, CASE WHEN count(*) FILTER (result <> 'missing') = 0 THEN 'run_failed' WHEN count(*) FILTER (result = 'reproduced') = count(*) THEN 'reproduced' WHEN count(*) FILTER (result = 'reproduced') > 0 THEN 'partial' ELSE 'mismatch' END AS status FROM r GROUP BY study""",
    "failure_taxonomy": f"SELECT {_REASONS} AS reason, count(*) AS n FROM events GROUP BY 1",
    "blocker_family": f"SELECT user_id, CASE event_id % {len(_FAMILY_OF)} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAMILY_OF)) + " END AS family, count(*) AS n FROM events GROUP BY 1, 2",
    "placeholder_commands": "SELECT o_orderkey, o_orderkey % 4 < 2 AS placeholder FROM orders",
    "last_number_near_token": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (value + 1)::VARCHAR END AS found FROM events",
    "status_counts": "SELECT o_orderpriority, n, round(100.0 * n / sum(n) OVER (), 1) AS percent, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) x",
    "funnel": """WITH f AS (SELECT o_orderstatus <> 'P' AS a, o_totalprice > 100000 AS b, o_orderpriority[1] IN ('1', '2') AS c, o_custkey % 5 = 0 AS d FROM orders),
      n AS (SELECT 0 AS position, 'attempted' AS stage, count(*) FILTER (a) AS n FROM f UNION ALL SELECT 1, 'resolved', count(*) FILTER (a AND b) FROM f UNION ALL SELECT 2, 'built', count(*) FILTER (a AND b AND c) FROM f UNION ALL SELECT 3, 'reproduced', count(*) FILTER (a AND b AND c AND d) FROM f)
      SELECT position, stage, n, round(100.0 * n / nullif(lag(n) OVER (ORDER BY position), 0), 1) AS percent FROM n""",
    "rate_summary": "SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 1) AS percent FROM lineitem GROUP BY 1",
    "prf_micro": f"WITH {_CONF} {q_prf('c', 'lang')}",
    "prf_macro": f"WITH {_CONF}, f AS ({q_prf('c', 'source', 'lang')}) SELECT lang, round(avg(f1), 3) AS macro_f1, count(*) AS n_units FROM f GROUP BY lang",
    "prf_groups": f"WITH {_CONF}, g AS (SELECT unnest(list_filter(['overall', CASE WHEN field IN ('methods', 'datasets', 'environment') THEN 'headline' END, CASE WHEN field IN ('software', 'random_seeds') THEN 'repository' END], lambda x: x IS NOT NULL)) AS \"group\", tp, fp, fn FROM c) " + q_prf("g", '"group"'),
    "greedy_match_exact": f"""WITH {_NAMED}, e AS (SELECT p_size AS study, CASE WHEN p_partkey % 5 = 0 THEN 'methods' ELSE 'datasets' END AS field, p_partkey % 2 AS side, lower(trim(name)) AS nf FROM n WHERE p_partkey % 11 <> 0),
      c AS (SELECT study, field, nf, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS p FROM e GROUP BY ALL)
      SELECT study, field, sum(least(g, p))::BIGINT AS tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM c GROUP BY ALL""",
    "recipe_f1": f"""WITH {_NAMED}, e AS (SELECT DISTINCT p_size AS study, p_partkey % 2 AS side, name FROM n WHERE p_partkey % 11 <> 0), x AS ({q_facts('e', 'study, side', 'name')}),
      t AS (SELECT a.study, a.side, a.name, EXISTS (SELECT 1 FROM x b WHERE b.study = a.study AND b.side <> a.side AND {q_match('a', 'b')}) AS hit FROM x a),
      c AS (SELECT study, count(*) FILTER (side = 0) AS n_gold, count(*) FILTER (side = 1) AS n_pred, count(*) FILTER (side = 0 AND hit) AS ha, count(*) FILTER (side = 1 AND hit) AS hb FROM t GROUP BY study),
      r AS (SELECT *, CASE WHEN n_pred > 0 THEN hb::DOUBLE / n_pred ELSE 0::DOUBLE END AS p, CASE WHEN n_gold > 0 THEN ha::DOUBLE / n_gold ELSE 0::DOUBLE END AS q FROM c)
      SELECT study, n_gold, n_pred, round(p, 3) AS precision, round(q, 3) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 3) AS f1 FROM r""",
    "step_jaccard": """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower('pip install ' || p_name), ' ')) AS a, CASE WHEN p_partkey % 6 <> 0 THEN list_distinct(string_split(lower('pip install ' || p_type || ' ' || split_part(p_name, ' ', 1)), ' ')) ELSE [] END AS b FROM part)
      SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 4) AS similarity FROM t""",
    "ground_tokens": rf"""WITH x AS ({q_facts('benchmark', 'item_id', 'text')}), d AS (SELECT doc_id, {q_norm('text')} AS nf FROM documents),
      w AS (SELECT doc_id, unnest(list_distinct(string_split(nf, ' '))) AS word FROM d),
      k AS (SELECT item_id, unnest(tk) AS word FROM x),
      g AS (SELECT k.item_id, w.doc_id FROM k JOIN w ON w.word = k.word JOIN x ON x.item_id = k.item_id GROUP BY k.item_id, w.doc_id HAVING count(*)::DOUBLE / any_value(len(x.tk)) >= 0.6
        UNION SELECT a.item_id, w.doc_id FROM (SELECT item_id, unnest(ac) AS word FROM x WHERE nf <> '') a JOIN w ON w.word = a.word
        UNION SELECT x.item_id, d.doc_id FROM x JOIN d ON x.nf <> '' AND contains(' ' || d.nf || ' ', ' ' || x.nf || ' '))
      SELECT x.item_id, count(g.doc_id) AS n_grounded FROM x LEFT JOIN g ON g.item_id = x.item_id GROUP BY x.item_id""",
    "value_grounded": r"""SELECT event_id, len(list_filter(list_filter(regexp_extract_all(user_id || ' of ' || value, '[0-9]+(?:\.[0-9]+)?'), lambda n: len(n) >= 2), lambda n: contains(props || event_id, n))) > 0 AS grounded FROM events""",
    "chunk_words": f"WITH {_CHUNKS} SELECT doc_id, pos, len(c) AS n_words, md5(array_to_string(c, ' ')) AS chunk_md5 FROM k WHERE len(c) >= 30",
    "chunk_stats": f"WITH {_CHUNKS.replace('175 + 200', '350 + 400').replace('175', '350')} SELECT doc_id, count(*) AS n_chunks, sum(len(c))::BIGINT AS n_words FROM k WHERE len(c) >= 30 GROUP BY doc_id",
    "section_isolation": r"""WITH t AS (SELECT doc_id, regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN 'Intro' || chr(10) || '2. Experimental Setup' || chr(10) ELSE 'Intro' || chr(10) END || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '3. Results' || chr(10) || 'x' ELSE '' END, '\r?\n') AS l FROM documents),
      m AS (SELECT doc_id, l, CASE WHEN doc_id % 3 = 0 THEN 1 END AS a, len(l) AS n FROM t),
      z AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN n - 2 ELSE least(a + 200, n) END AS e FROM m),
      g AS (SELECT *, a IS NOT NULL AND len(list_filter(regexp_split_to_array(array_to_string(l[a + 1:e], chr(10)), '\s+'), lambda w: w <> '')) > 100 AS found FROM z)
      SELECT doc_id, CASE WHEN found THEN a ELSE n // 4 END::BIGINT AS first_line, CASE WHEN found THEN e ELSE (n // 4) * 3 END::BIGINT AS last_line, found FROM g""",
    "vector_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM e),
      s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.x, v.x) / (q.n * v.n), 6) AS score FROM u v CROSS JOIN u q WHERE q.vec_id % 50 = 0)
      SELECT query, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s) t WHERE place <= 3""",
    "passage_dedup": "SELECT doc_id, len(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY doc_id) AS n FROM documents) t WHERE n = 1",
    "merge_first_wins": "SELECT user_id, event_type AS key, arg_min(value, event_id)::VARCHAR AS value FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2",
    "first_nonnull": "WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events) SELECT user_id, arg_min(k, event_id) FILTER (event_type = 'error') AS gpu, arg_min(value, event_id) FILTER (k > 90) AS cuda, arg_min(k, event_id) FILTER (k > 1000) AS cpu FROM e GROUP BY 1",
    "seeds_union": "SELECT user_id, array_to_string(list_sort(list_distinct(list((props->>'$.k')::BIGINT))), ',') AS seeds FROM events GROUP BY 1",
    "json_fields": "SELECT event_id, (props->>'$.k')::INT AS k, props->>'$.missing' AS missing FROM events",
    "json_repair": """SELECT event_id, CASE event_id % 4 WHEN 2 THEN '{"k": [' || (props->>'$.k') || ']}' WHEN 3 THEN '{}' ELSE '{"k": ' || (props->>'$.k') || '}' END AS json FROM events""",
    "summary_stats": q_summary("customer", "c_mktsegment", "c_acctbal"),
    "band_stats": f"WITH {_BANDED} " + q_summary("bd", "band", "s_acctbal"),
    "separation": f"WITH {_BANDED} SELECT round(min(s_acctbal) FILTER (band = 'high') - max(s_acctbal) FILTER (band = 'low'), 4) AS separation FROM bd",
    "concordance": """SELECT count(*) AS n_pairs, round(avg(CASE WHEN a.s_acctbal > b.s_acctbal THEN 1.0 WHEN a.s_acctbal = b.s_acctbal THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS concordance FROM supplier a JOIN supplier b ON a.s_nationkey % 3 > b.s_nationkey % 3""",
    "spearman": f"WITH r AS (SELECT l_linestatus, ({q_rank('l_quantity', 'l_linestatus')})::DOUBLE AS x, ({q_rank('l_discount', 'l_linestatus')})::DOUBLE AS y FROM lineitem) SELECT l_linestatus, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1",
    "mannwhitney_u": """WITH r AS (SELECT o_orderstatus = 'F' AS a, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0)::DOUBLE AS k, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders),
      s AS (SELECT count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(k) FILTER (a) AS r1, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM r)
      SELECT n1, n2, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u, round((r1 - n1::DOUBLE * (n1 + 1) / 2 - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM s""",
    # Newton's method on the likelihood, thirty rounds; the normal tail from the series of the error function.
    "logit_fit": """WITH RECURSIVE d AS (SELECT toxic::DOUBLE AS y, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS a, ln(1 + n_chars)::DOUBLE AS b FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
      w AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2
        UNION ALL
        SELECT i + 1, w0 + (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det, w1 + (g0 * (h02 * h12 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det,
               w2 + (g0 * (h01 * h12 - h02 * h11) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det, (h11 * h22 - h12 * h12) / det, (h00 * h22 - h02 * h02) / det, (h00 * h11 - h01 * h01) / det
        FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
          SELECT i, w0, w1, w2, sum(y - p) AS g0, sum(a * (y - p)) AS g1, sum(b * (y - p)) AS g2, sum(q) AS h00, sum(q * a) AS h01, sum(q * b) AS h02, sum(q * a * a) AS h11, sum(q * a * b) AS h12, sum(q * b * b) AS h22
          FROM (SELECT *, p * (1 - p) AS q FROM (SELECT w.*, d.*, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM w CROSS JOIN d WHERE i < 30) x) y GROUP BY i, w0, w1, w2) z) u),
      t AS (SELECT unnest(['intercept', 'english', 'length']) AS term, unnest([w0, w1, w2]) AS c, unnest([v0, v1, v2]) AS v FROM w WHERE i = 30),
      s AS (SELECT term, c, abs(c) / sqrt(v) / sqrt(2.0::DOUBLE) AS x FROM t)
      SELECT term, round(c, 6) AS coefficient, round(exp(c), 6) AS odds_ratio,
             round(greatest(0, 1 - CASE WHEN x > 8 THEN 1 ELSE 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(generate_series(0, 400), lambda n: exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2)))) END), 6) AS p_value FROM s""",
    "dedup_exact": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))",
    "drop_reasons": """SELECT CASE WHEN n_chars < 300 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN regexp_matches(text, '[|%]') THEN 'symbols' WHEN source IN ('src3', 'src7') THEN 'source' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "additive_score": f"WITH {_SCORED} SELECT *, CASE WHEN b_score >= 5 THEN 'full' ELSE 'build_only' END AS tier FROM sc",
    "quota_fill": f"""WITH {_SCORED}, f AS (SELECT *, row_number() OVER (PARTITION BY b_score >= 5 ORDER BY b_score DESC, p_partkey) AS n FROM sc), t AS (SELECT p_partkey, b_score, CASE WHEN b_score >= 5 AND n <= 30 THEN 'full' ELSE 'build_only' END AS final_tier FROM f)
      SELECT p_partkey, b_score, final_tier FROM (SELECT *, row_number() OVER (PARTITION BY final_tier ORDER BY b_score DESC, p_partkey) AS m FROM t) x WHERE m <= CASE final_tier WHEN 'full' THEN 30 ELSE 70 END""",
    "key_format": "SELECT n_name, n_regionkey, printf('study%03d', row_number() OVER (ORDER BY n_regionkey, n_name)) AS study_key FROM nation",
    "seeded_shuffle": "SELECT p_partkey FROM part ORDER BY md5(p_partkey || '|42'), p_partkey LIMIT 50",
    "left_join_attrs": "SELECT c_custkey, c_mktsegment, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c_custkey = o_custkey",
    "tier_coalesce": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 2 = 0 THEN CASE WHEN toxic = 0 THEN quality END ELSE toxic END AS claim, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN d.doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS source_tier FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "anti_resume": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "recipe_normalise": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'python ' || p_type || '.py' END AS run_command, CASE WHEN p_partkey % 2 = 0 THEN 'make' ELSE 'a; b' END AS steps, 1::BIGINT AS n_data, 0::BIGINT AS n_metrics, CASE WHEN p_partkey % 5 = 0 THEN 'high' ELSE 'low' END AS confidence FROM part""",
    "joined_documents": """SELECT conv_id, md5(t) AS text_md5, len(t) AS n_chars FROM (SELECT conv_id, substr(string_agg('## ' || printf('%03d', turn) || chr(10) || substr(text, 1, 16000), chr(10) || chr(10) ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn), 1, 16000) AS t FROM conversations GROUP BY conv_id) x""",
    "python_resolver": """SELECT p_partkey, CASE WHEN k % 7 = 0 THEN '3.' || (k % 5 + 7) WHEN k % 5 = 0 THEN '3.' || (k % 4 + 8) WHEN k % 3 = 0 AND k % 15 <= 12 THEN '3.12' WHEN k % 2 = 0 THEN '3.9' WHEN k % 11 = 0 THEN '3.10' END AS version,
      CASE WHEN k % 7 = 0 THEN 'conda' WHEN k % 5 = 0 THEN 'dockerfile' WHEN k % 3 = 0 AND k % 15 <= 12 THEN 'pyproject' WHEN k % 2 = 0 THEN 'python_requires' WHEN k % 11 = 0 THEN 'runtime' ELSE 'default' END AS source FROM (SELECT p_partkey, p_partkey AS k FROM part) x""",
    "docker_inspect": """SELECT s_suppkey, 'sha256:' || md5(s_name) AS image_id, CASE WHEN s_suppkey % 2 = 0 THEN 'sha256:' || md5(s_name) END AS digest, 'linux' AS os, CASE s_suppkey % 3 WHEN 0 THEN '11.' || (s_suppkey % 9) WHEN 1 THEN '12.1' END AS cuda, NULL::VARCHAR AS python, 1::BIGINT AS n_labels FROM supplier""",
    "study_model_grid": "SELECT n_nationkey AS study, len(r_name) AS n FROM nation CROSS JOIN region WHERE r_name <> upper('REGION_' || n_regionkey)",
    "reference_present": "SELECT CASE WHEN c_acctbal > 0 THEN 'high' ELSE 'low' END AS band, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'evaluated' ELSE 'skipped' END AS status, count(*) AS n FROM customer GROUP BY 1, 2",
    "common_fields": """WITH e AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS name, (props->>'$.k')::BIGINT AS k, event_type FROM events)
      SELECT unnest(['software', 'datasets', 'methods', 'parameters', 'evaluation_results', 'random_seeds', 'environment']) AS field,
             unnest([count(name), count(name), count(*), count(name), count(name), count(k), count(*) + count(*) FILTER (event_type = 'error')]) AS n,
             unnest([count(name), count(name), count(*), count(name), count(name), count(k), count(*) + count(*) FILTER (event_type = 'error')]) AS n_extra, unnest([count(name), 0, 0, count(name), count(name), 0, 0]) AS n_value FROM e""",
    "dedup_two_keys": """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, md5(lower(trim(text))) AS body, lang || ':' || n_chars AS size_key FROM documents),
      f AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::VARCHAR AS body, NULL::VARCHAR AS size_key, []::VARCHAR[] AS a, []::VARCHAR[] AS b, false AS kept
        UNION ALL SELECT n, doc_id, body, size_key, CASE WHEN ok THEN list_append(a, body) ELSE a END, CASE WHEN ok THEN list_append(b, size_key) ELSE b END, ok
        FROM (SELECT d.*, f.a, f.b, NOT list_contains(f.a, d.body) AND NOT list_contains(f.b, d.size_key) AS ok FROM f JOIN d ON d.n = f.n + 1) x)
      SELECT doc_id, body, size_key FROM f WHERE kept""",
    "greedy_match": f"""WITH RECURSIVE {_NAMED}, e AS (SELECT p_size AS study, CASE WHEN p_partkey % 5 = 0 THEN 'methods' ELSE 'datasets' END AS field, p_partkey % 2 AS side, p_partkey AS pos, name FROM n WHERE p_partkey % 11 <> 0),
      x AS ({q_facts('e', 'study, field, side, pos', 'name')}), m AS (SELECT a.study, a.field, a.pos AS g, list(b.pos ORDER BY b.pos) AS fits FROM x a JOIN x b ON b.study = a.study AND b.field = a.field WHERE a.side = 0 AND b.side = 1 AND {q_match('a', 'b')} GROUP BY 1, 2, 3),
      o AS (SELECT *, row_number() OVER (PARTITION BY study, field ORDER BY g) AS r FROM m),
      f AS (SELECT study, field, 0::BIGINT AS r, []::BIGINT[] AS used FROM (SELECT DISTINCT study, field FROM e) k
        UNION ALL SELECT study, field, r, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END FROM (SELECT o.study, o.field, o.r, f.used, list_filter(o.fits, lambda p: NOT list_contains(f.used, p)) AS free FROM f JOIN o ON o.study = f.study AND o.field = f.field AND o.r = f.r + 1) y),
      t AS (SELECT study, field, max(len(used)) AS tp FROM f GROUP BY 1, 2)
      SELECT t.study, t.field, max(tp) AS tp, count(*) FILTER (side = 1) - max(tp) AS fp, count(*) FILTER (side = 0) - max(tp) AS fn FROM t JOIN e ON e.study = t.study AND e.field = t.field GROUP BY 1, 2""",
}

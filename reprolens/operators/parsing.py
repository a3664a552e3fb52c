"""Configuration files as rows: dockerfiles, conda and pip requirements, Python versions, licences, artifact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A licence is the first whose phrases all occur in the lower-cased text.
LICENCES = (
    ("Apache-2.0", ("apache license", "version 2.0")),
    ("GPL-3.0", ("gnu general public license", "version 3")),
    ("GPL-2.0", ("gnu general public license", "version 2")),
    ("LGPL-3.0", ("gnu lesser general public license", "version 3")),
    ("MPL-2.0", ("mozilla public license", "version 2.0")),
    ("BSD-3-Clause", ("redistribution and use", "neither the name")),
    ("BSD-2-Clause", ("redistribution and use",)),
    ("MIT", ("permission is hereby granted, free of charge",)),
    ("ISC", ("isc license",)),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",)),
)
CUSTOM = "LicenseRef-Custom"
READ = 4000  # characters of a licence file that count
# Phrases that show that seeds are set.
SEED_PHRASES = ("random seed", "random_seed", "set_seed", "manual_seed", "--seed", "reproducib", "seed =")
# Supported interpreter versions, lowest first.
LADDER = ((3, 8), (3, 9), (3, 10), (3, 11), (3, 12))
# File names by type, names that are canonical, folders never entered, words that mark auxiliary files.
ARTIFACTS = (
    ("docker", r"^(Dockerfile|Dockerfile\..*|.*\.Dockerfile)$"),
    ("conda", r"^(environment\.ya?ml|conda\.ya?ml)$"),
    ("pip", r"^(requirements\.txt|requirements-.*\.txt)$"),
    ("setup", r"^(setup\.py|pyproject\.toml|setup\.cfg)$"),
    ("r", r"^(renv\.lock|DESCRIPTION)$"),
)
CANONICAL = ("dockerfile", "environment.yml", "environment.yaml", "requirements.txt", "pyproject.toml", "setup.py", "renv.lock")
SKIPPED = (".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "site-packages", ".mypy_cache", ".pytest_cache", "build", "dist", ".tox", ".idea")
AUXILIARY = ("doc", "docs", "documentation", "test", "tests", "example", "examples", "benchmark", "benchmarks", "tutorial", "tutorials", "sample", "samples")
DEEPEST = 4


def licence(text: Column) -> Column:
    """The licence's identifier; another text is a custom licence, no text none."""
    low = F.lower(F.substring(text, 1, READ))
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, phrases in LICENCES:
        test = F.lit(True)
        for phrase in phrases:
            test = test & low.contains(phrase)
        out = out.when(test, name)
    return out.otherwise(CUSTOM)


def mentions_seed(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in SEED_PHRASES:
        out = out | low.contains(phrase)
    return F.coalesce(out, F.lit(False))


def requirement(line: Column) -> Column:
    """(name, version, kind) of a requirements line, null for blanks, comments and options.

    The name is lower case with underscores; the version that of the first bound, "unspecified" without one.
    """
    bare = F.trim(F.regexp_replace(line, r"\s+#.*$", ""))
    spec = F.trim(F.split_part(bare, F.lit(";"), F.lit(1)))
    name = F.replace(F.lower(F.regexp_extract(spec, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), F.lit("-"), F.lit("_"))
    bound = F.regexp_extract(spec, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*(==|>=|<=|~=|!=|>|<)\s*([^,\s]+)", 2)
    url = spec.rlike(r"@\s*(https?|git)")
    kind = F.when(url, "url").when(spec.rlike("=="), "pinned").when(bound != "", "bounded").otherwise("free")
    skip = (bare == "") | bare.rlike("^[#-]") | (name == "")
    return F.when(~skip, F.struct(name.alias("name"), F.when(bound != "", bound).otherwise("unspecified").alias("version"), kind.alias("kind")))


def conda_dependency(entry: Column) -> Column:
    """(channel, name, version, build) of a conda entry such as channel::name=1.2=build, name==1.2 or name>=1.2."""
    bare = F.trim(entry)
    channel = F.when(bare.contains("::"), F.trim(F.split_part(bare, F.lit("::"), F.lit(1))))
    spec = F.when(bare.contains("::"), F.trim(F.split_part(bare, F.lit("::"), F.lit(2)))).otherwise(bare)
    name = F.lower(F.regexp_extract(spec, r"^([A-Za-z0-9._-]+)", 1))
    rest = F.trim(F.regexp_replace(spec, r"^[A-Za-z0-9._-]+", ""))
    version = F.regexp_extract(rest, r"^(?:==|>=|<=|!=|~=|=|>|<)?\s*([^=,\s<>!~]+)", 1)
    build = F.regexp_extract(rest, r"^=[^=,\s]+=([^=,\s]+)$", 1)
    return F.struct(channel.alias("channel"), name.alias("name"), F.when(version != "", version).otherwise("unspecified").alias("version"), F.when(build != "", build).alias("build"))


def pip_dependency(entry: Column) -> Column:
    """(name, version) of a pip entry in a conda file: the last part of a repository's address, or the name without extras and the first bound's version."""
    bare = F.trim(entry)
    url = bare.rlike("^(git[+]|https?://|-e)")
    last = F.split_part(F.split_part(F.try_element_at(F.split(bare, "/"), F.lit(-1)), F.lit(".git"), F.lit(1)), F.lit("@"), F.lit(1))
    clean = F.regexp_replace(bare, r"\[.*?\]", "")
    bound = r"^([A-Za-z0-9_.-]+)\s*[=<>!]+\s*([0-9.]+\w*)?"
    version = F.when(~url, F.nullif(F.regexp_extract(clean, bound, 2), F.lit("")))
    name = F.when(url, last).when(clean.rlike(bound), F.regexp_extract(clean, bound, 1)).otherwise(F.trim(clean))
    return F.struct(F.lower(name).alias("name"), F.coalesce(version, F.lit("unspecified")).alias("version"))


def conda_environment(text: Column) -> Column:
    """(name, channels, dependencies, pip) of an environment file: its lists as arrays of entries, the nested pip list apart.

    Reads the block form of such files (one entry a line); comments and quotes are dropped.
    """
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"(^|\s)#.*$", ""))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("section"), F.lit(-1).alias("pip"), empty.alias("channels"), empty.alias("dependencies"), empty.alias("pips"), F.lit(None).cast("string").alias("name"))

    def step(s: Column, x: Column) -> Column:
        key = F.regexp_extract(x, r"^([A-Za-z_]+):", 1)
        item = F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*-\s*(.*)$", 1)), "^[\"']|[\"']$", "")
        indent = F.length(F.regexp_extract(x, r"^(\s*)", 1))
        section = F.when(key != "", key).otherwise(s["section"])
        opens = (section == "dependencies") & item.rlike(r"^pip\s*:\s*$")
        nested = (s["pip"] >= 0) & (indent > s["pip"])
        pip = F.when(key != "", F.lit(-1)).when(opens, indent).when((item != "") & ~nested, F.lit(-1)).otherwise(s["pip"])
        value = F.regexp_replace(F.trim(F.regexp_extract(x, r"^name:\s*(.*)$", 1)), "^[\"']|[\"']$", "")
        add = lambda into, when: F.when(when & (item != ""), F.array_append(s[into], item)).otherwise(s[into])
        plain = key == ""
        return F.struct(
            section.alias("section"), pip.alias("pip"), add("channels", plain & (section == "channels")).alias("channels"), add("dependencies", plain & (section == "dependencies") & ~opens & ~nested).alias("dependencies"),
            add("pips", plain & (section == "dependencies") & nested).alias("pips"), F.coalesce(F.nullif(value, F.lit("")), s["name"]).alias("name"),
        )

    done = F.aggregate(lines, start, step)
    return F.when(text.isNotNull(), F.struct(F.coalesce(done["name"], F.lit("unknown")).alias("name"), done["channels"].alias("channels"), done["dependencies"].alias("dependencies"), done["pips"].alias("pip")))


def conda_dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (conda or pip), pos, name, version, build of all entries of environment files."""
    e = files.select(F.col(key), conda_environment(F.col(text)).alias("e"))
    c = e.select(key, F.posexplode("e.dependencies").alias("pos", "x")).withColumn("d", conda_dependency(F.col("x")))
    p = e.select(key, F.posexplode("e.pip").alias("pos", "x")).withColumn("d", pip_dependency(F.col("x")))
    return c.select(key, F.lit("conda").alias("kind"), "pos", "d.name", "d.version", "d.build").unionByName(p.select(key, F.lit("pip").alias("kind"), "pos", "d.name", "d.version", F.lit(None).cast("string").alias("build")))


def _last_wins(entries: Column) -> Column:
    """A map of entries (k, v); later entries replace earlier ones of the same key."""
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def _entry(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")


def dockerfile_variables(text: Column) -> Column:
    """(env, args, labels): maps of ENV (k=v ... or k v), ARG (a name without a default is empty) and LABEL entries; later ones win."""
    every = F.split(F.regexp_replace(text, r"\\\r?\n", " "), r"\r?\n")
    of = lambda word: F.transform(F.filter(every, lambda x: x.rlike(rf"(?i)^\s*{word}\s+\S")), lambda x: F.trim(F.regexp_replace(x, rf"(?i)^\s*{word}\s+", "")))
    before = lambda x: F.regexp_extract(x, "^([^=]*)=", 1)
    after = lambda x: F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)

    def env(rest: Column) -> Column:
        pairs = F.transform(F.filter(F.split(rest, r"\s+"), lambda p: p.contains("=")), lambda p: _entry(before(p), _unquoted(after(p))))
        name, value = F.regexp_extract(rest, r"^(\S+)\s", 1), F.regexp_extract(rest, r"(?s)^\S+\s+(.*)$", 1)
        return F.when(rest.contains("="), pairs).when(name != "", F.array(_entry(name, _unquoted(value)))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))

    arg = lambda rest: F.when(rest.contains("="), _entry(F.trim(before(rest)), F.trim(after(rest)))).otherwise(_entry(rest, F.lit("")))
    label = r"(\S+)=[\"']?([^\"']+)[\"']?"
    pairs = lambda rest: F.zip_with(F.regexp_extract_all(rest, F.lit(label), F.lit(1)), F.regexp_extract_all(rest, F.lit(label), F.lit(2)), _entry)
    return F.struct(_last_wins(F.flatten(F.transform(of("ENV"), env))).alias("env"), _last_wins(F.transform(of("ARG"), arg)).alias("args"), _last_wins(F.flatten(F.transform(of("LABEL"), pairs))).alias("labels"))


def dockerfile_versions(variables: Column, image: Column) -> Column:
    """(cuda, python, torch): from ENV, else ARG, by the names that are tried in order; cuda and python else from the image's tag."""
    found = lambda name: F.coalesce(variables["env"][name], variables["args"][name])
    first = lambda *names: F.coalesce(*[F.nullif(found(n), F.lit("")) for n in names])
    tag = lambda pattern: F.nullif(F.regexp_extract(image, pattern, 1), F.lit(""))
    return F.struct(
        F.coalesce(first("CUDA_VERSION", "CUDA_VER"), tag(r"(?i)cuda([0-9]+\.[0-9]+)")).alias("cuda"), F.coalesce(first("PYTHON_VERSION", "PYTHON_VER"), tag(r"(?i)py(?:thon)?:?([0-9]\.[0-9]+)")).alias("python"), first("PYTORCH_VERSION", "TORCH_VERSION").alias("torch"),
    )


def dockerfile(text: Column) -> Column:
    """(image, digest, env, cuda, python): the last FROM wins, later ENV entries win, hints come from ENV and then from the image's tag."""
    every = F.split(F.regexp_replace(text, r"\\\r?\n", " "), r"\r?\n")
    froms = F.filter(every, lambda x: x.rlike(r"(?i)^\s*FROM\s+\S"))
    last = F.regexp_extract(F.coalesce(F.try_element_at(froms, F.lit(-1)), F.lit("")), r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)", 1)
    digest = F.regexp_extract(last, r"@(sha256:\S+)", 1)
    env = F.filter(every, lambda x: x.rlike(r"(?i)^\s*ENV\s+\S"))

    def value(name: str) -> Column:
        hits = F.filter(F.transform(env, lambda x: F.regexp_extract(x, rf"(?i)^\s*ENV\s+(?:.*\s)?(?-i:{name})[=\s]\"?([^\s\"]+)", 1)), lambda v: v != "")
        return F.try_element_at(hits, F.lit(-1))

    tag = lambda pattern: F.nullif(F.regexp_extract(last, pattern, 1), F.lit(""))
    return F.struct(
        F.nullif(last, F.lit("")).alias("image"), F.nullif(digest, F.lit("")).alias("digest"), F.size(env).alias("n_env"),
        F.coalesce(value("CUDA_VERSION"), tag(r"(?i)cuda([0-9]+\.[0-9]+)")).alias("cuda"), F.coalesce(value("PYTHON_VERSION"), tag(r"(?i)py(?:thon)?:?([0-9]\.[0-9]+)")).alias("python"),
    )


def _version(major: Column, minor: Column) -> Column:
    return F.struct(major.cast("int").alias("major"), minor.cast("int").alias("minor"))


def _text(v: Column) -> Column:
    return F.concat_ws(".", v["major"], v["minor"])


def ladder() -> Column:
    return F.array(*[_version(F.lit(a), F.lit(b)) for a, b in LADDER])


def nearest_version(version: Column) -> Column:
    """The supported version nearest to x.y; of two the lower."""
    minor = F.regexp_extract(version, r"^3\.([0-9]+)", 1)
    best = F.array_min(F.transform(ladder(), lambda v: F.struct(F.abs(v["minor"] - minor.try_cast("int")).alias("gap"), v.alias("v"))))
    return F.when(minor != "", _text(best["v"]))


def highest_version(specifier: Column) -> Column:
    """The highest supported version that meets all bounds of a specifier such as ">=3.8,<3.11"; null if none does."""
    bounds = F.filter(F.split(F.regexp_replace(specifier, r"\s", ""), ","), lambda b: b != "")

    def meets(v: Column, b: Column) -> Column:
        op = F.regexp_extract(b, r"^(==|>=|<=|!=|~=|>|<)", 1)
        w = _version(F.regexp_extract(b, r"([0-9]+)(?:\.[0-9]+)?", 1).try_cast("int"), F.coalesce(F.regexp_extract(b, r"[0-9]+\.([0-9]+)", 1).try_cast("int"), F.lit(0)))
        return F.when(op == "==", v == w).when(op == ">=", v >= w).when(op == "<=", v <= w).when(op == "!=", v != w).when(op == "~=", (v >= w) & (v["major"] == w["major"])).when(op == ">", v > w).when(op == "<", v < w).otherwise(True)

    fit = F.filter(ladder(), lambda v: F.forall(bounds, lambda b: meets(v, b)))
    return F.when(F.size(fit) > 0, _text(F.array_max(fit)))


def artifacts(paths: DataFrame) -> DataFrame:
    """(repo, path) to repo, type, path, depth, place: files of a known type that lie in no skipped folder, ranked within repo and type."""
    parts = F.split("path", "/")
    name = F.try_element_at(parts, F.lit(-1))
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(ARTIFACTS):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    skipped = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED)))
    rows = paths.withColumn("type", kind).withColumn("depth", F.size(parts) - 1).filter(F.col("type").isNotNull() & ~F.coalesce(skipped, F.lit(False)) & (F.col("depth") <= DEEPEST))
    plain = (~F.lower(name).isin(*CANONICAL)).cast("int")
    aux = F.arrays_overlap(F.split(F.lower("path"), r"[/_.-]+"), F.array(*map(F.lit, AUXILIARY))).cast("int")
    place = F.row_number().over(W.partitionBy("repo", "type").orderBy("depth", plain, aux, "path"))
    return rows.select("repo", "type", "path", "depth", place.alias("place"))


def primary(ranked: DataFrame) -> DataFrame:
    """The best file of each repo: of its types docker, conda, pip and setup, in this order, the first that it has."""
    order = F.array_position(F.array(*map(F.lit, ("docker", "conda", "pip", "setup"))), F.col("type"))
    return ranked.filter((F.col("place") == 1) & (order > 0)).groupBy("repo").agg(F.min_by("type", order).alias("type"), F.min_by("path", order).alias("path"))


def resolve_python(conda: Column, docker: Column, pyproject: Column, setup: Column, runtime: Column) -> Column:
    """(version, source): the first of five declarations that names a version; a specifier gives the highest supported one that meets it.

    conda and docker hold an entry such as python=3.9 and an image such as python:3.8-slim; pyproject and
    setup hold specifiers; runtime a line such as python-3.10.4.
    """
    found = (
        (F.regexp_extract(conda, r"(?i)^python\s*[=~<>]*\s*([0-9]\.[0-9]+)", 1), "conda"),
        (F.regexp_extract(docker, r"(?i)python:?([0-9]\.[0-9]+)", 1), "dockerfile"),
        (highest_version(pyproject), "pyproject"),
        (highest_version(setup), "python_requires"),
        (F.regexp_extract(runtime, r"python-([0-9]\.[0-9]+)", 1), "runtime"),
    )
    out = None
    for value, source in found:
        known = F.coalesce(value, F.lit("")) != ""
        entry = F.struct(value.alias("version"), F.lit(source).alias("source"))
        out = F.when(known, entry) if out is None else out.when(known, entry)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("version"), F.lit("default").alias("source")))


def docker_inspect(text: Column) -> Column:
    """(image_id, digest, os, cuda, python, n_labels) of an inspection record: digests first, then environment variables."""
    schema = "array<struct<Id:string,RepoDigests:array<string>,Os:string,Config:struct<Env:array<string>,Labels:map<string,string>>>>"
    r = F.get(F.from_json(text, schema), F.lit(0))
    env = F.coalesce(r["Config"]["Env"], F.array().cast("array<string>"))

    def variable(*names: str) -> Column:
        hits = [F.try_element_at(F.filter(env, _starts(name + "=")), F.lit(-1)) for name in names]
        return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(h, F.lit("")), "=(.*)$", 1), F.lit("")) for h in hits])

    return F.struct(
        r["Id"].alias("image_id"), F.nullif(F.regexp_extract(F.coalesce(F.get(r["RepoDigests"], F.lit(0)), F.lit("")), r"@(sha256:\S+)", 1), F.lit("")).alias("digest"), r["Os"].alias("os"),
        variable("CUDA_VERSION", "NV_CUDA_LIB_VERSION").alias("cuda"), variable("PYTHON_VERSION").alias("python"), F.coalesce(F.size(r["Config"]["Labels"]), F.lit(0)).cast("long").alias("n_labels"),
    )


def _starts(prefix: str):
    return lambda e: e.startswith(prefix)

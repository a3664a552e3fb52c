"""Record sources and sinks: JSON documents, CSV, YAML lists, quads as text, folders of files, named graphs in parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.operators.graph import SCHEMA

RECIPE = "study_id string, repo_url string, run_command string, setup_steps array<string>, requires_dataset array<struct<name:string,download:string>>, requires_checkpoint string, produces_metric array<struct<metric:string,dataset:string>>, entry_point string, confidence string"
EXTRACTION = (
    "study_id string, backend string, model string, graph_uri string, extracted_at string, metadata struct<dependencies:array<struct<name:string,version:string>>,random_seeds:array<bigint>,"
    "hardware:struct<gpu_model:string,cuda_version:string,cpu_info:string>,hyperparameters:array<struct<name:string,value:string>>,datasets:array<struct<name:string,version:string>>,"
    "methods:array<struct<name:string,description:string>>,evaluation_results:array<struct<metric:string,value:string,split:string>>>"
)
RESULT = (
    "study_id string, repo_url string, status string, stage string, artifacts struct<by_type:map<string,string>,depth_note:string,n_found:int>, repo_meta struct<identifier:string,commit_hash:string,software_license:string>,"
    "lift struct<lifted:map<string,string>,triples:int,n_sources:int>, python struct<declared:string,source:string,used:string>, build struct<attempted:boolean,resolve_success:boolean,build_success:boolean,stage_failed:string,duration_s:double>,"
    "score struct<total_score:double,tier:string,dimension_scores:map<string,double>>, duration_s double"
)


def json_documents(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """One JSON document a file, with the file's name; unreadable files are left out, and of files with one key the first by path stays."""
    rows = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name")).withColumn("_path", F.col("_metadata.file_path")).filter("_bad is null").drop("_bad")
    if key:
        first = rows.groupBy(key).agg(F.min("_path").alias("_path"))
        rows = rows.join(first, [key, "_path"], "left_semi")
    return rows.drop("_path")


def key_and_slug(file_name: Column) -> tuple[Column, Column]:
    """The two parts of a name such as study001__model-a.json."""
    stem = F.regexp_replace(file_name, r"\.[A-Za-z]+$", "")
    return F.split_part(stem, F.lit("__"), F.lit(1)), F.nullif(F.split_part(stem, F.lit("__"), F.lit(2)), F.lit(""))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def list_rows(spark: SparkSession, sections: dict[str, list[dict]], schema: str) -> DataFrame:
    """Rows of parsed lists (of a manifest, of a reference set), with the section that each is from."""
    names = [f.split()[0] for f in schema.split(",")]
    data = [(section, *(row.get(n) for n in names)) for section, rows in sections.items() for row in rows]
    return spark.createDataFrame(data, "section string, " + schema)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """rel_path, depth, length of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.substring_index(F.col("path"), base + "/", -1)
    return rows.select(rel.alias("rel_path"), (F.size(F.split(rel, "/")) - 1).alias("depth"), "length")


def whole_text(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Each file as one text, cut to ``most`` characters."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.substring("value", 1, most).alias("text"))


def _escape(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def to_nquads(quads: DataFrame) -> DataFrame:
    """One line for each quad."""
    node = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    value = F.when(F.col("o_kind") == "iri", node("o")).otherwise(F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col("o_type"), F.lit(">")), F.lit(""))))
    return quads.select(F.concat_ws(" ", node("s"), node("p"), value, node("graph"), F.lit(".")).alias("value"))


def from_nquads(lines: DataFrame) -> DataFrame:
    pattern = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>)?) <([^>]*)> \.$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    text = part(4)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)" + a.replace("\\", "\\\\"), "$1" + b)
    text = F.replace(text, F.lit("\\\\"), F.lit("\\"))
    iri = F.col("value").rlike(r"^<[^>]*> <[^>]*> <")
    return lines.filter(F.col("value").rlike(pattern)).select(part(6).alias("graph"), part(1).alias("s"), part(2).alias("p"), F.when(iri, part(3)).otherwise(text).alias("o"), F.when(iri, "iri").otherwise("literal").alias("o_kind"), F.nullif(part(5), F.lit("")).alias("o_type"))


class GraphStore:
    """Named graphs as parquet, a folder for each graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates()

    def put(self, quads: DataFrame) -> None:
        """Replaces the graphs that the quads name, and no others."""
        rows = quads.dropDuplicates()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph").parquet(self.path)

    def append(self, quads: DataFrame) -> None:
        quads.dropDuplicates().write.mode("append").partitionBy("graph").parquet(self.path)

    def delete(self, graph: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/graph={graph.replace('/', '%2F').replace(':', '%3A')}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def flat(rows: DataFrame, separator: str = "; ") -> DataFrame:
    """Array cells as joined text, for CSV."""
    return rows.select(*[F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema])


def write_csv(rows: DataFrame, path: str) -> None:
    """A report: one file, so for small results."""
    flat(rows).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, key: str) -> None:
    rows.write.mode("overwrite").partitionBy(key).json(path)


def _create(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf).create(where, True)


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One text file, written through the session's file system, so that any path works that Spark reads."""
    out = _create(spark, path)
    try:
        for line in lines:
            out.write(bytearray(f"{line}\n".encode()))
    finally:
        out.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    out = _create(spark, path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_yaml(rows: DataFrame, path: str) -> None:
    """A list of maps, one row at a time; strings as JSON strings, which are YAML too."""

    def lines() -> Iterator[str]:
        for row in rows.toLocalIterator():
            for i, (name, value) in enumerate(row.asDict(recursive=True).items()):
                yield f"{'- ' if i == 0 else '  '}{name}: {json.dumps(value, ensure_ascii=False, default=str)}"

    write_lines(rows.sparkSession, path, lines())


def yaml_lists(spark: SparkSession, path: str, schema: str, *sections: str) -> DataFrame:
    """Rows of the lists in YAML files, with the section of the file that each list is from (null: the file is the list).

    A missing field is null; other types than the schema's are written as text.
    """
    import yaml

    texts = [r.value for r in spark.read.text(path, wholetext=True).select("value").collect()]  # manifests: a few small files
    names = [f.split()[0] for f in schema.split(", ")]
    rows = []
    for text in texts:
        loaded = yaml.safe_load(text) or []
        for section in sections or (None,):
            found = loaded if section is None else (loaded.get(section) or [])
            rows += [(section, *(json.dumps(v, ensure_ascii=False) if isinstance(v := row.get(n), (list, dict)) else None if v is None else str(v) for n in names)) for row in found]
    given = spark.createDataFrame(rows, "section string, " + ", ".join(f"`{n}` string" for n in names))
    kinds = [f.split(" ", 1) for f in schema.split(", ")]
    return given.select("section", *[(F.from_json(n, k) if k.startswith(("array", "map", "struct")) else F.col(n).try_cast(k)).alias(n) for n, k in kinds])


def write_text(rows: DataFrame, path: str, title: str) -> None:
    """A small result as aligned columns of text."""
    table = [rows.columns, *(["" if v is None else str(v) for v in r] for r in rows.toLocalIterator())]
    widths = [max(map(len, column)) for column in zip(*table, strict=True)]
    write_lines(rows.sparkSession, path, [title, "=" * len(title), *("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in table)])


def write_markdown(rows: DataFrame, path: str, title: str) -> None:
    """A table of a small result."""
    names = rows.columns
    body = ("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in rows.toLocalIterator())
    write_lines(rows.sparkSession, path, [f"# {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *body])


def write_latex(rows: DataFrame, path: str, caption: str) -> None:
    """A small result as a table of LaTeX; its special characters are escaped."""
    marks = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", **{c: "\\" + c for c in "&%$#_{}"}}
    safe = lambda v: "" if v is None else "".join(marks.get(c, c) for c in str(v))
    line = lambda r: " & ".join(map(safe, r)) + r" \\"
    head = [r"\begin{table}", rf"\caption{{{safe(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", r"\hline", line(rows.columns), r"\hline"]
    write_lines(rows.sparkSession, path, [*head, *map(line, rows.toLocalIterator()), r"\hline", r"\end{tabular}", r"\end{table}"])


def disk_usage(listed: DataFrame) -> DataFrame:
    """n_files and bytes of files as ``files`` lists them."""
    return listed.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def csv_head(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The first fields of a headed CSV, as text, by the names given; further fields aren't read."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=False)])


def write_index(chunks: DataFrame, path: str) -> None:
    """A stored index: chunks (key, pos, chunk, embedding) by key."""
    chunks.repartition(F.col(chunks.columns[0])).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def newer(content: bytes, known_checksum: str | None, version: str | None, known_version: str | None) -> bool:
    """Whether fetched content replaces a cached copy: there is none, its version is lower, or the bytes differ."""
    parts = lambda v: tuple(int(x) for x in v.split(".") if x.isdigit()) if v else ()
    return known_checksum is None or parts(version) > parts(known_version) or hashlib.sha256(content).hexdigest() != known_checksum


def refresh(spark: SparkSession, path: str, fetch: Callable[[], tuple[bytes, str | None]]) -> bool:
    """Keeps a cached copy of a remote file at ``path``, with its checksum and version beside; whether the copy was replaced.

    ``fetch`` returns content and version; if it fails, the copy stays as it is (and there must be one).
    """
    mark = f"{path}.json"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(mark)
    known = spark.read.schema("sha256 string, version string").json(mark).first() if where.getFileSystem(conf).exists(where) else None
    try:
        content, version = fetch()
    except OSError:
        if known is None:
            raise
        return False
    if not newer(content, known and known.sha256, version, known and known.version):
        return False
    write_bytes(spark, path, content)
    write_lines(spark, mark, [json.dumps({"sha256": hashlib.sha256(content).hexdigest(), "version": version})])
    return True


def flatten_results(rows: DataFrame) -> DataFrame:
    """Result documents (RESULT) as flat rows; a missing section reads as its default."""
    has = lambda kind: F.coalesce(F.map_contains_key("artifacts.by_type", F.lit(kind)), F.lit(False))
    return rows.select(
        "study_id", "status", F.coalesce("artifacts.n_found", F.lit(0)).alias("n_found"), F.coalesce("artifacts.depth_note", F.lit("n/a")).alias("depth_note"), has("docker").alias("has_docker"), has("conda").alias("has_conda"), has("pip").alias("has_pip"),
        F.col("repo_meta.software_license").isNotNull().alias("has_licence"), F.col("repo_meta.commit_hash").isNotNull().alias("has_commit"), F.coalesce("lift.triples", F.lit(0)).alias("triples"), F.col("python.declared").alias("python_declared"), F.col("python.used").alias("python_used"),
        F.coalesce("build.attempted", F.lit(False)).alias("attempted"), F.col("build.resolve_success").alias("resolved"), F.col("build.build_success").alias("built"), F.col("build.stage_failed").alias("stage_failed"), F.col("score.total_score").alias("total_score"), F.col("score.tier").alias("tier"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
    )


def predictors(flat_rows: DataFrame) -> DataFrame:
    """0/1 features (null where unknown) and log counts."""
    bit = lambda c: F.col(c).cast("int").alias(c)
    return flat_rows.select("study_id", *[bit(c) for c in ("has_docker", "has_conda", "has_pip", "has_licence", "has_commit", "resolved", "built")], F.col("python_declared").isNotNull().cast("int").alias("declares_python"), F.log1p("triples").alias("log_triples"), F.log1p("n_found").alias("log_files"), "total_score")

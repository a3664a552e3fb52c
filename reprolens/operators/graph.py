"""Named graphs as a table of quads: mapping rows to quads, patterns, existence, counts, construction.

Quads have set semantics. A graph is a column, so every operator works on all graphs at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "graph string, s string, p string, o string, o_kind string, o_type string"
TYPE = "rdf:type"


def mint(prefix: str, *keys: Column) -> Column:
    """A node name that depends on its keys only, so that mapping again gives the same node."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 10))


def to_quads(rows: DataFrame, graph: Column, subject: Column, kind: str | None, literals: dict[str, Column] | None = None, links: dict[str, Column] | None = None) -> DataFrame:
    """A type quad, a literal quad for each value and a link for each node; absent values give none."""

    def quad(p: str, o: Column, o_kind: str, o_type: str | None) -> Column:
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(o_kind).alias("o_kind"), F.lit(o_type).cast("string").alias("o_type"))

    quads = [quad(TYPE, F.lit(kind), "iri", None)] if kind else []
    quads += [quad(p, o, "literal", "xsd:string") for p, o in (literals or {}).items()]
    quads += [quad(p, o, "iri", None) for p, o in (links or {}).items()]
    out = rows.select(graph.alias("graph"), subject.alias("s"), F.inline(F.array(*quads)))
    return out.filter("o is not null").select("graph", "s", "p", "o", "o_kind", "o_type")


def merge(*graphs: DataFrame) -> DataFrame:
    """Union as a set."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def fetch(quads: DataFrame, graph: str) -> DataFrame:
    return quads.filter(F.col("graph") == graph)


def counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("graph").agg(F.count("*").alias("n_triples"))


def type_counts(quads: DataFrame) -> DataFrame:
    return quads.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("entity_type")).agg(F.count("*").alias("n"))


def ask(quads: DataFrame, questions: dict[str, Column]) -> DataFrame:
    """Many existence questions for every graph in one pass."""
    return quads.groupBy("graph").agg(*[F.bool_or(q).alias(name) for name, q in questions.items()])


def star(quads: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None, kind: str | None = None) -> DataFrame:
    """One row for each subject that has every required predicate, with optional ones null where absent.

    A star pattern is one aggregation, not a join for each predicate. Predicates are single-valued: of
    several values the smallest is taken.
    """
    wanted = required | (optional or {})
    rows = quads.filter(F.col("p").isin(*wanted, TYPE))
    values = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for p, name in wanted.items()]
    typed = [F.bool_or((F.col("p") == TYPE) & (F.col("o") == kind)).alias("_typed")] if kind else []
    out = rows.groupBy("graph", "s").agg(*values, *typed)
    for name in required.values():
        out = out.filter(F.col(name).isNotNull())
    return out.filter("_typed").drop("_typed") if kind else out


def construct(rows: DataFrame, triples: list[tuple[Column, str, Column]]) -> DataFrame:
    """Triples made from each row, as a set."""
    made = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")) for s, p, o in triples])
    return rows.select(F.inline(made)).filter("o is not null").dropDuplicates()


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Graphs that ``new`` names are taken from it alone."""
    return old.join(new.select("graph").distinct(), "graph", "left_anti").unionByName(new.dropDuplicates())


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new)


def delete(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    return quads.join(graphs.select("graph").distinct(), "graph", "left_anti")


def exists(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """Those of the given graphs that have a quad."""
    return graphs.join(quads.select("graph").distinct(), "graph", "left_semi")

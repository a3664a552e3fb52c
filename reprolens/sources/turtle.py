"""Turtle: text to triples and back. Prefixed names stay as they are written, so that graphs read like the tables here."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.operators.graph import SCHEMA, TYPE

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>(?:_|[A-Za-z][\w-]*)?:(?:\w(?:[\w.:%/-]*[\w/%-])?)?|[A-Za-z]+)|(?P<mark>[;,.\[\]()])""",
    re.S,
)
#: Namespaces whose names are kept with their prefix and written in full.
NAMESPACES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "sh": "http://www.w3.org/ns/shacl#"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
Triple = tuple[str, str, str, str, str | None]  # subject, predicate, object, kind (iri or literal), datatype


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]


def _plain(raw: str) -> str:
    quote = 3 if raw[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), raw[quote:-quote])


def short(name: str) -> str:
    """An address in one of the known namespaces as a prefixed name."""
    for prefix, space in NAMESPACES.items():
        if name.startswith(space):
            return f"{prefix}:{name[len(space) :]}"
    return name


class _Reader:
    def __init__(self, text: str, blank: str):
        self.tokens, self.at = [*_tokens(text), ("end", "")], 0
        self.blanks = (f"_:{blank}b{i}" for i in itertools.count())
        self.own, self.out = blank, []

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def expect(self, mark: str) -> None:
        kind, text = self.next()
        if text != mark:
            raise ValueError(f"{mark!r} expected, not {text!r}")

    def node(self) -> tuple[str, str, str | None]:
        kind, text = self.next()
        if kind == "iri":
            return short(text[1:-1]), "iri", None
        if kind == "name":
            if text in ("true", "false"):
                return text, "literal", "xsd:boolean"
            return (TYPE if text == "a" else f"_:{self.own}{text[2:]}" if text.startswith("_:") else text), "iri", None
        if kind == "number":
            return text, "literal", "xsd:double" if "e" in text.lower() else "xsd:decimal" if "." in text else "xsd:integer"
        if kind == "text":
            datatype = "xsd:string"
            if self.tokens[self.at][0] == "type":
                self.next()
                datatype = self.node()[0]
            elif self.tokens[self.at][0] == "lang":
                datatype = "rdf:langString" + self.next()[1]
            return _plain(text), "literal", datatype
        if text == "[":
            name = next(self.blanks)
            if self.peek() != "]":
                self.properties(name)
            self.expect("]")
            return name, "iri", None
        if text == "(":
            return self.items(), "iri", None
        raise ValueError(f"a node expected, not {text!r}")

    def items(self) -> str:
        if self.peek() == ")":
            self.next()
            return "rdf:nil"
        name = next(self.blanks)
        self.out.append((name, "rdf:first", *self.node()))
        self.out.append((name, "rdf:rest", self.items(), "iri", None))
        return name

    def properties(self, subject: str) -> None:
        while True:
            predicate = self.node()[0]
            while True:
                self.out.append((subject, predicate, *self.node()))
                if self.peek() != ",":
                    break
                self.next()
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.next()
            if self.peek() in (".", "]"):
                return

    def read(self) -> list[Triple]:
        while self.tokens[self.at][0] != "end":
            kind, text = self.tokens[self.at]
            if text.lower() in ("@prefix", "@base", "prefix", "base"):
                self.at += 3 if text.lower().endswith("prefix") else 2
                if text.startswith("@"):
                    self.expect(".")
                continue
            subject = self.node()[0]
            if self.peek() != ".":
                self.properties(subject)
            self.expect(".")
        return self.out


def triples(text: str, blank: str = "") -> list[Triple]:
    """The triples of one document; nodes without a name are called by ``blank`` and a number."""
    return _Reader(text, blank).read()


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """Quads (SCHEMA) of the Turtle files that match; the graph is that of the folder (graph=NAME), else the file's name without its ending."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["name"], frame["value"], strict=True):
                yield pd.DataFrame([(name, *t) for t in triples(text, f"{name}-")], columns=["graph", "s", "p", "o", "o_kind", "o_type"])

    texts = spark.read.text(pattern, wholetext=True)
    name = F.col("graph") if "graph" in texts.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z]+$", "")
    return texts.select(name.alias("name"), "value").mapInPandas(parse, SCHEMA)


def _node(c: str) -> Column:
    x = F.col(c)
    full = F.concat(F.lit("<"), x, F.lit(">"))
    for prefix, space in NAMESPACES.items():
        full = F.when(x.startswith(prefix + ":"), F.concat(F.lit("<" + space), F.substring_index(x, ":", -1), F.lit(">"))).otherwise(full)
    return F.when(x.startswith("_:"), x).otherwise(full)


def lines(quads: DataFrame) -> DataFrame:
    """graph, value: one statement of Turtle for each triple. Names of the known namespaces are written in full, others as (relative) addresses."""
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(F.col("o_type").startswith("rdf:langString@"), F.substring("o_type", 15, 100)).otherwise(F.coalesce(F.concat(F.lit("^^"), _node("o_type")), F.lit("")))
    value = F.when(F.col("o_kind") == "iri", _node("o")).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))
    return quads.select("graph", F.concat_ws(" ", _node("s"), _node("p"), value, F.lit(".")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    """A folder of Turtle text for each graph (graph=NAME)."""
    lines(quads).write.mode("overwrite").partitionBy("graph").text(path)

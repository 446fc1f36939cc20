"""Network files as text: BIF, dagitty and JSON; parsed to rows name, a, b, kind.

All take a DataFrame with columns name and text (a file each, as ``read.text(wholetext=True)`` gives).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """The name with an underscore for each character that is no ASCII letter, digit, underscore, point or hyphen."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def normal_names(raw: Column) -> Column:
    """Array of (raw, node) for an array of names, in order of the raw ones: safe names, of which no two are the same.

    Of names that would be the same, later ones get ``__2``, ``__3`` and so on, the first that is free. An
    empty name is an error.
    """
    kind = "array<struct<raw:string,node:string>>"

    def add(found: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(found) + 1), lambda k: F.when(k == 1, safe_name(name)).otherwise(F.concat(safe_name(name), F.lit("__"), k.cast("string"))))
        free = F.get(F.filter(tries, lambda t: ~F.exists(found, lambda f: f["node"] == t)), F.lit(0))
        node = F.when(name == "", F.raise_error(F.lit("empty node name"))).otherwise(free)
        return F.concat(found, F.array(F.struct(name.alias("raw"), node.alias("node"))))

    names = F.array_sort(F.array_distinct(raw))
    safe = F.transform(names, lambda n: F.when(n == "", F.raise_error(F.lit("empty node name"))).otherwise(safe_name(n)))
    plain = F.zip_with(names, safe, lambda n, s: F.struct(n.alias("raw"), s.alias("node"))).cast(kind)
    # Names whose safe ones differ never ask for a number, so nothing need be looked up among those before.
    return F.when(F.size(F.array_distinct(safe)) == F.size(safe), plain).otherwise(F.aggregate(names, F.array().cast(kind), add))


def normal_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, raw, node: normal_names() of the names (raw) of each key, a row a name, for keys of any number of names.

    A name and one with a number after it can ask for the same node only if they are alike without such numbers. Of these families, those with one
    safe name are numbered by their order; in the others each name looks from where the one before it with its safe name ended.
    """
    base = F.when(F.col("raw") == "", F.raise_error(F.lit("empty node name"))).otherwise(safe_name(F.col("raw")))
    family = Window.partitionBy(*keys, "_root")
    each = rows.select(*keys, "raw").filter("raw is not null").distinct().withColumn("_base", base).withColumn("_root", F.regexp_replace("_base", r"(?:__[0-9]+)+$", ""))
    told = each.withColumn("_mixed", F.min("_base").over(family) != F.max("_base").over(family))
    place = F.row_number().over(Window.partitionBy(*keys, "_root", "_base").orderBy("raw"))
    told = told.withColumn("_k", place)
    node = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("__"), F.col("_k").cast("string")))
    plain = told.filter("not _mixed").select(*keys, "raw", node.alias("node"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by family and name; only the family at hand is kept in memory.
        at, taken, free = None, set(), {}
        for batch in batches:
            nodes = []
            for *family, raw_base in zip(*[batch.column(c).to_pylist() for c in (*keys, "_root", "_base")], strict=True):
                if family != at:
                    at, taken, free = family, set(), {}
                k = free.get(raw_base, 1)
                while (name := raw_base if k == 1 else f"{raw_base}__{k}") in taken:
                    k += 1
                taken.add(name)
                free[raw_base] = k + 1
                nodes.append(name)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "raw")], pa.array(nodes, pa.string())], names=[*keys, "raw", "node"])

    mixed = told.filter("_mixed").select(*keys, "_root", "_base", "raw").repartition(*keys, "_root").sortWithinPartitions(*keys, "_root", "raw")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return plain.union(mixed.mapInArrow(numbered, f"{types}, raw string, node string"))


def _built(files: DataFrame) -> DataFrame:
    """Edges (name, a, b, kind) of files (name; raw, an array of its nodes; edges, one of a, b, kind) with the normal names of their nodes; an
    edge to an undeclared node, or to itself, is an error. A file stays one row until its edges are named, so nothing is joined."""
    merged = lambda c: F.flatten(F.collect_list(c))
    whole = files.groupBy("name").agg(F.array_compact(merged("raw")).alias("raw"), F.array_distinct(merged("edges")).alias("edges"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, edges = batch.column("m").flatten(), batch.column("edges").flatten()
            own = pc.list_parent_indices(batch.column("edges"))
            of_file = lambda at, names: pc.binary_join_element_wise(at.cast(pa.string()), names, " ")
            known = of_file(pc.list_parent_indices(batch.column("m")), nodes.field("raw"))
            ends = [nodes.field("node").take(pc.index_in(of_file(own, edges.field(c)), value_set=known)) for c in "ab"]
            fine = pc.and_(pc.and_(ends[0].is_valid(), ends[1].is_valid()), pc.fill_null(pc.not_equal(edges.field("a"), edges.field("b")), False))
            if (wrong := pc.index(fine, False).as_py()) >= 0:
                raise ValueError(f"undeclared node or self-loop: {edges.field('a')[wrong]} {edges.field('b')[wrong]}")
            yield pa.RecordBatch.from_arrays([batch.column("name").take(own), *ends, edges.field("kind")], names=["name", "a", "b", "kind"])

    made = f"name {files.schema['name'].dataType.simpleString()}, a string, b string, kind string"
    return whole.select("name", normal_names(F.col("raw")).alias("m"), "edges").mapInArrow(named, made)


def parse_bif(files: DataFrame) -> DataFrame:
    """Edges of BIF files: a probability block names a child and, after a bar, its parents. Comments don't count.

    Nodes are those with a variable block; a parent without one is an error, and so is a file without any, or with
    two of a name.
    """
    bare = files.select("name", F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ").alias("text"))
    plain = lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))
    variables = F.transform(F.regexp_extract_all("text", F.lit(r"variable\s+(\"[^\"]+\"|[^\s{]+)\s*\{"), F.lit(1)), plain)
    sound = (F.size("vars") > 0) & (F.size(F.array_distinct("vars")) == F.size("vars"))
    told = F.raise_error(F.concat(F.lit("no variable block, or two of one name: "), F.col("name")))
    bare = bare.withColumn("vars", variables)
    blocks = F.filter(F.regexp_extract_all("text", F.lit(r"probability\s*\(([^)]*)\)"), F.lit(1)), lambda block: F.contains(block, F.lit("|")))
    parents = lambda block: F.split(F.substring_index(block, "|", -1), ",")
    edge = lambda block, a: F.struct(plain(a).alias("a"), plain(F.substring_index(block, "|", 1)).alias("b"), F.lit("->").alias("kind"))
    edges = F.flatten(F.transform(blocks, lambda block: F.transform(parents(block), lambda a: edge(block, a))))
    return _built(bare.select("name", F.when(sound, F.col("vars")).otherwise(told).alias("raw"), edges.alias("edges")))


#: A name is quoted, or has no blank.
_NAME = r"(?:\"[^\"]+\"|[^\s\"\[\]{}=;]+)"


def parse_dagitty(files: DataFrame) -> DataFrame:
    """Edges of dagitty files, a line each: ->, <- (turned), <-> and --.

    A file begins with the line that opens the graph and ends with a brace; lines declare a node, an
    attribute or one edge. Anything else is an error, as a line that is skipped would be a missing edge.
    """
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.rtrim(F.regexp_replace(x, r"[\s;]+$", "")))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    listed = files.select("name", trimmed.alias("lines"))
    framed = F.coalesce(F.get("lines", F.lit(0)).rlike(r"^(dag|graph|digraph|pdag|mag|pag)\b.*\{$"), F.lit(False)) & (F.element_at("lines", -1) == "}")
    body = F.when(framed, F.slice("lines", F.lit(2), F.size("lines") - 2)).otherwise(F.raise_error(F.concat(F.lit("not a dagitty graph: "), F.col("name"))))
    edge = rf"^({_NAME})\s*(->|<->|<-|--)\s*({_NAME})\s*(?:\[.*\])?$"
    known = lambda line: line.rlike(edge) | line.rlike(rf"^{_NAME}\s*(\[.*\])?$") | line.rlike(r"^\w+\s*=.*$")
    read = lambda line: F.when(known(line), line).otherwise(F.raise_error(F.concat(F.lit("unrecognised line: "), line)))
    part = lambda line, i: F.replace(F.regexp_extract(line, edge, i), F.lit('"'), F.lit(""))
    parts = F.transform(body, lambda line: F.struct(part(read(line), 1).alias("l"), part(line, 2).alias("kind"), part(line, 3).alias("r")))
    found = listed.select("name", parts.alias("parts")).select("name", F.filter("parts", lambda e: e["kind"] != "").alias("parts"))

    def ahead(e: Column) -> Column:
        turned = e["kind"] == "<-"
        return F.struct(F.when(turned, e["r"]).otherwise(e["l"]).alias("a"), F.when(turned, e["l"]).otherwise(e["r"]).alias("b"), F.when(turned, "->").otherwise(e["kind"]).alias("kind"))

    ends = F.flatten(F.transform("parts", lambda e: F.array(e["l"], e["r"])))
    return _built(found.select("name", ends.alias("raw"), F.transform("parts", ahead).alias("edges")))


def parse_json(files: DataFrame) -> DataFrame:
    """Edges of JSON files {"nodes": [...], "arcs": [[parent, child], ...]}; an arc to an undeclared node is an error, and so is a text
    that is no such object, or an arc of other than two nodes."""
    read = files.select("name", F.from_json("text", "nodes array<string>, arcs array<array<string>>").alias("p"))
    sound = F.col("p.nodes").isNotNull() & F.col("p.arcs").isNotNull() & F.coalesce(F.forall("p.arcs", lambda a: F.size(a) == 2), F.lit(False))
    parsed = read.select("name", F.when(sound, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a JSON network: "), F.col("name")))).alias("p"))
    edge = lambda arc: F.struct(F.get(arc, F.lit(0)).alias("a"), F.get(arc, F.lit(1)).alias("b"), F.lit("->").alias("kind"))
    return _built(parsed.select("name", F.col("p.nodes").alias("raw"), F.transform("p.arcs", edge).alias("edges")))


def digest(column: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(column, 256), 1, 16)


def seed(*parts: Column) -> Column:
    """A stable 64-bit seed from the parts, as a decimal."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")

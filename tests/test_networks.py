import random
import time

import pytest

from meridian.sources import networks as N

SCHEMA = "name string, text string"


def edges(parser, spark, text):
    return sorted((r.a, r.kind, r.b) for r in parser(spark.createDataFrame([("f", text)], SCHEMA)).collect())


def names(spark, *raw):
    got = spark.createDataFrame([(list(raw),)], "raw array<string>").select(N.normal_names("raw").alias("m")).first().m
    return {r.raw: r.node for r in got}


def test_names_stay_apart(spark):
    assert names(spark, "a.b", "a-b", "a b", "a_b", "é", "a  b") == {"a.b": "a.b", "a-b": "a-b", "a b": "a_b", "a_b": "a_b__2", "é": "_", "a  b": "a__b"}
    assert names(spark, "x y", "x_y", "x_y__2") == {"x y": "x_y", "x_y": "x_y__2", "x_y__2": "x_y__2__2"}
    with pytest.raises(Exception, match="empty node name"):
        names(spark, "a", "")


def test_names_of_large_keys(spark):
    """As many names as a fold over an array would need minutes for, and the same as its result on names that clash in every way."""
    rnd = random.Random(3)
    tricky = [rnd.choice("ab") + "".join(rnd.choice(["__2", "__3", " ", "_", "#", "__2__2", "é"]) for _ in range(rnd.randint(0, 3))) for _ in range(90)]
    rows = [("t", n) for n in tricky] + [("p", f"w {i // 2}{' #'[i % 2]}x") for i in range(40000)] + [(None, "a b"), (None, "a_b"), ("t", None)]
    began = time.time()
    found = {(r.k, r.raw): r.node for r in N.normal_rows(spark.createDataFrame(rows, "k string, raw string"), ["k"]).collect()}
    assert time.time() - began < 60
    assert {n: found["t", n] for n in tricky} == names(spark, *tricky)
    assert len(found) == len({(k, n) for k, n in rows if n}) and len({(k, n) for (k, _), n in found.items()}) == len(found)
    assert (found["p", "w 7 x"], found["p", "w 7#x"]) == ("w_7_x", "w_7_x__2")
    assert found[None, "a_b"] == "a_b__2"


def test_dagitty(spark):
    text = 'dag {\nbb="0,0,1,1"\n"my node" [exposure,pos="0,1"]\nC\n"my node" -> B\nB <- D\nB <-> E;\n# no edge\nC -- E [beta=1]\n}\n'
    assert edges(N.parse_dagitty, spark, text) == [("B", "<->", "E"), ("C", "--", "E"), ("D", "->", "B"), ("my_node", "->", "B")]
    for bad in ("A -> B", "dag {\nA -> B", "dag {\nA -> B -> C\n}", "dag {\nA -> {D E}\n}", "dag {\nA -> A\n}"):
        with pytest.raises(Exception, match="not a dagitty graph|unrecognised line|self-loop"):
            edges(N.parse_dagitty, spark, bad)


def test_bif(spark):
    block = lambda x: f"variable {x} {{ type discrete [ 2 ] {{ yes, no }}; }}\n"
    asia = [("asia", "tub"), ("smoke", "lung"), ("smoke", "bronc"), ("tub", "either"), ("lung", "either"), ("either", "xray"), ("bronc", "dysp"), ("either", "dysp")]
    nodes = sorted({v for e in asia for v in e})
    parents = {v: [a for a, b in asia if b == v] for v in nodes}
    text = "network unknown { }\n// variable none { }\n/* probability ( tub | none ) */\n" + "".join(map(block, nodes))
    text += "".join(f"probability ( {v}{' | ' + ', '.join(p) if p else ''} ) {{ table 0.5, 0.5; }}\n" for v, p in parents.items())
    assert len(nodes) == 8 and edges(N.parse_bif, spark, text) == sorted((a, "->", b) for a, b in asia)
    with pytest.raises(Exception, match="undeclared node"):
        edges(N.parse_bif, spark, block("a") + "probability ( a | b ) { }")


def test_json(spark):
    assert edges(N.parse_json, spark, '{"nodes": ["a", "b c"], "arcs": [["a", "b c"]]}') == [("a", "->", "b_c")]
    with pytest.raises(Exception, match="undeclared node"):
        edges(N.parse_json, spark, '{"nodes": ["a"], "arcs": [["a", "b"]]}')


@pytest.mark.parametrize("text", ['{"nodes": ["a"', "plain text", "{}", '{"nodes": ["a"]}', '{"nodes": ["a", "b"], "arcs": [["a"]]}'])
def test_broken_json_is_an_error(spark, text):
    with pytest.raises(Exception, match="not a JSON network"):
        edges(N.parse_json, spark, text)


@pytest.mark.parametrize("text", ["network unknown { }", "", "variable a { }\nvariable a { }\nprobability ( a ) { }"])
def test_broken_bif_is_an_error(spark, text):
    with pytest.raises(Exception, match="no variable block"):
        edges(N.parse_bif, spark, text)


def test_graphs_too_large_for_masks_are_an_error(spark):
    from meridian.sources.population import pack

    edges_ = spark.range(69).selectExpr("1L as gid", "cast(id as int) as a", "cast(id + 1 as int) as b", "'d' as kind")
    nodes = spark.range(70).selectExpr("1L as gid", "cast(id as int) as v")
    with pytest.raises(Exception, match="70 nodes"):
        pack(edges_, nodes).collect()
    assert len(pack(edges_.filter("b < 62"), nodes.filter("v < 62")).first().labels) == 62

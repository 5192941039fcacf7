"""Lines of triples, plain and odd, against the regular expressions that say what a triple is."""

import re

from palimpsest.operators import triples as T

R = [f"<http://x.org/ns/{x}>" for x in ("m.1", "performance.film", "a/ns/b", "", "é.2")] + ["<x/ns/a", "m.1>", "<a>b/ns/c>", "", "<x/ns/y/ns/>", "<no>"]
O = [*R, '"text"', '"text"@en', '"texte"@fr', '""', '"', '"@en', '"a"b"@en', '"a\rb"', '"a b"@en', '"a\tb"@en', '"a"@en"', '"é 中"@en', '"<x/ns/y>"']


def plain(line):
    subject, predicate = (re.search(p + T._RESOURCE, line) for p in ("^", "^[^\t]*\t"))
    found = re.search(T._OBJECT.replace(".*", "[^\n\r\u0085  ]*"), line)
    out = tuple(m[1] if m else "" for m in (subject, predicate)) + ((found[1] or found[2] or "") if found else "",)
    return out if all(out) else None


def test_every_line_is_read_as_by_the_expressions(spark):
    lines = [f"{s}\t{p}\t{o}{end}" for s in R for p in R for o in O for end in ("\t.", "\t. ", ".", "\t.\t.")] + ["", "\t\t\t.", R[0], "a\t" * 9]
    got = [tuple(r) for r in T.parsed(spark.createDataFrame([(x,) for x in lines], "value string").repartition(4)).collect()]
    assert sorted(got) == sorted(filter(None, map(plain, lines))) and len(got) > 100
    films = [tuple(r) for r in T.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), "value", T.FILM).collect()]
    assert sorted(films) == sorted(t for t in got if t[1] == T.FILM) and films


def test_each_expression_is_evaluated_once_a_line(spark):
    lines = spark.createDataFrame([("x",)], "value string")
    plan = T.parsed(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") == 4


def test_names_meet_every_performance_and_none_is_only_counted(spark):
    def line(subject, predicate, obj):
        return f"<http://x.org/ns/{subject}>\t<http://x.org/ns/{predicate}>\t{obj}\t."

    def ref(name):
        return f"<http://x.org/ns/{name}>"

    played = [("p.1", "m.1", "a.1"), ("p.2", "m.1", "a.1"), ("p.3", "m.1", "a.2"), ("p.4", "m.2", "a.1"), ("p.5", "m.1", "a.3"), ("p.6", "m.1", None)]
    lines = [line(p, T.FILM, ref(f)) for p, f, _ in played] + [line(p, T.ACTOR, ref(a)) for p, _, a in played if a] + [line("p.1", T.CHARACTER, '"X"@en')]
    # Film 2 and actor 3 have no English name.
    lines += [line("m.1", T.NAME, '"One"@en'), line("m.1", T.NAME, '"Un"@fr'), line("m.2", T.NAME, '"Deux"@fr'), line("a.1", T.NAME, '"Ann"@en'), line("a.2", T.NAME, '"Bo"@en')]
    got = [tuple(r) for r in T.named(T.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()]
    want = [("p.1", "m.1", "One", "a.1", "Ann", "X"), ("p.2", "m.1", "One", "a.1", "Ann", None), ("p.3", "m.1", "One", "a.2", "Bo", None)]
    assert sorted(got, key=str) == want


def test_the_query_of_names_gives_the_joined_rows(spark, sf_dir):
    from palimpsest.plans.catalog import QUERIES

    rows = QUERIES["join_rdf_names"](spark, sf_dir)
    assert rows.columns == ["performance", "film", "title", "actor", "name", "role"]
    assert rows.count() == rows.select("performance").distinct().count() == QUERIES["rdf_load"](spark, sf_dir).count()

"""Places in prose against the SQL of the rule, and its patterns against plain alternatives."""

import re

import duckdb

from tessera.functions import geography as G
from tessera.plans import places
from tessera.plans.registry import ORACLE_SQL

ODD = [
    "x, Kenya", "Nairobi , Kenya. ", "Nairobi, Kenya .", "Nairobi, Kenya\n", "a b, Mali, Chad", "ab, foo, Lyon, France", "CÔTE D'IVOIRE", "Abidjan, CÔTE D'IVOIRE", "guinea-bissau guinea", "nigerKenya kenya",
    "the gambia", "Berlin,Germany)", "united states of americas united states", "Köln,\n\nGermany;", "A" * 50 + ", Peru", "a" * 10 + " " * 50 + "x, Peru", None, "", "Oz, " + "q" * 70 + " Kenya",
    "Lima , Peru (x) and", "b, Kenya, Kenya", "bb, Kenya, Kenya", "Rio,Kenya" + "." * 70, "Rio,Kenya" + " " * 80 + "x", "équipe de Köln, Chad",
]


def test_odd_places_against_sql(spark, tmp_path):
    rows = [(4 * i + 3, t) for i, t in enumerate(ODD)]  # these keep their texts
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r[c] for c in ("key", "country", "code", "city")) for r in places.country_infer(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(f"select key, country, code, city from ({ORACLE_SQL['country_infer']})").fetchall())


def test_patterns_of_places_are_the_plain_ones():
    names = sorted(G.COUNTRY_CODES, key=len, reverse=True)
    plain, trie = re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, names))})(?![a-z])"), re.compile(rf"(?<![a-z]){G._NAME}(?![a-z])")
    text = " ".join(f"{a}{sep}{b}" for a in names for b, sep in ((names[-1], "s "), ("guinea", "-"), (a[:-1], ". ")))
    assert plain.findall(text) == trie.findall(text) and len(plain.findall(text)) > len(names)
    cities = [re.compile(p) for p in (G.CITY_COUNTRY, G._CITY_FIRST)]
    for t in [*filter(None, ODD), " ".join(filter(None, ODD))]:
        assert cities[0].findall(t) == cities[1].findall(t)

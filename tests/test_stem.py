"""English stems: published words, and the same rules said as SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from tessera.functions.stem import SPECIAL, stem, stems, stems_sql

#: A part of the published sample vocabulary of the rules, word and stem.
PUBLISHED = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
MORE = "generously generate communities arsenal hopping hoped fizzed falling disabled hissing bled luxuriated ties tied gas this gaps kiwis cries dying skies early only happy say by cry relational sensational digitizer operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate angularities homologous effective bowdlerize probate rate cease controll roll youth boyish syzygy analogies geology apologi fully lessli bias inning proceeded exceeds yes yy yyy ayy 4th b2b x as".split()


def test_published_words():
    assert [(w, stem(w)) for w in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert all(stem(w) == s for w, s in SPECIAL.items())
    assert [stem(w) for w in ("the", "4th", "x", "b2b", "hoping", "hopping", "generously", "communities", "ties", "tied", "gas", "gaps")] == ["the", "4th", "x", "b2b", "hope", "hop", "generous", "communiti", "tie", "tie", "gas", "gap"]


def test_sql_says_the_same():
    rng = random.Random(0)
    ends = ["s", "es", "ed", "ing", "ly", "ation", "ational", "iveness", "fulness", "ies", "eed", "eedly", "ingly", "ment", "ement", "able", "ative", "icate", "ism", "ogi", "li", "ll", "e", "y", "ous", "ion", "al"]
    made = {"".join(rng.choice("aeiouybcdlnrstvz") for _ in range(rng.randrange(1, 9))) + rng.choice(ends) + rng.choice(["", *ends]) for _ in range(20_000)}
    words = sorted(made | set(PUBLISHED) | set(MORE) | set(SPECIAL))
    con = duckdb.connect()
    con.execute("CREATE TABLE voc AS SELECT unnest(?) AS x", [words])
    found = dict(con.sql(f"WITH {stems_sql('voc')} SELECT x, s FROM stemmed").fetchall())
    assert {w: (stem(w), found[w]) for w in words if stem(w) != found[w]} == {}


def test_column(spark):
    df = spark.createDataFrame([(w,) for w in [*MORE, *MORE]], "w string").select("w", stems(F.col("w")).alias("s"))
    assert all(r.s == stem(r.w) for r in df.collect())

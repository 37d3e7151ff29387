from pyspark.sql import functions as F

from websift.operators import querylog as Q

# search string: what differs from an empty search
CASES = {
    "python tutorial": {"terms": ["python", "tutorial"]},
    '"machine learning" "" x': {"exact_phrase": ["machine learning", ""], "terms": ["x"]},
    '"open': {"terms": ['"open']},
    "python -java": {"terms": ["python"], "exclude": ["java"]},
    "machine-learning": {"terms": ["machine"], "exclude": ["learning"]},
    "site:my-site.com": {"site": "my.com", "exclude": ["site"]},
    "site:a.b site:c x": {"site": "a.b", "terms": ["x"]},
    "filetype:pdf filetype:doc the": {"filetype": "pdf", "terms": ["the"]},
    "intitle:été intitle:b_1 inurl:c": {"intitle": ["été", "b_1"], "inurl": ["c"]},
    "　a\x1cb\xa0c ": {"terms": ["a", "b", "c"]},
    '-"x y"': {"exact_phrase": ["x y"], "terms": ["-"]},
    "site: x": {"terms": ["site:", "x"]},
    "+++": {"terms": ["+++"]},
}
EMPTY = {"exact_phrase": [], "exclude": [], "site": None, "filetype": None, "intitle": [], "inurl": [],
         "before": None, "after": None, "terms": []}


def test_conditions(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(CASES)], "i int, q string")
    rows = Q.with_conditions(df).orderBy("i").drop("i").collect()
    for row, (q, want) in zip(rows, CASES.items()):
        assert row.asDict() == {"q": q, **EMPTY, **want}, q


def test_phrases(spark):
    df = spark.createDataFrame([('"Of The" don\'t intitle:x_y +++',)], "q string")
    got = Q.with_conditions(df).select(F.to_json(Q.phrases())).first()[0]
    assert got == ('[{"title_only":false,"tokens":["of","the"]},{"title_only":false,"tokens":["don","t"]},'
                   '{"title_only":false,"tokens":[]},{"title_only":true,"tokens":["x","y"]}]')


def test_empty_searches_are_left_out(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "q string")
    assert [r.q for r in Q.searchable(df).collect()] == ["a"]

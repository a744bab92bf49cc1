import random

import pytest

from heartlake.functions.packed import explode_packed

CASES = {
    "a, b;c|d": ["a", "b", "c", "d"],
    " x ;; y ,": ["x", "y"],
    '"a, b" ; c': ["a, b", "c"],
    '"so-called ""notched"" QRS"': ['so-called "notched" QRS'],
    "{'NORM': 100.0, 'A b':None}": ["NORM", "A b"],
    '{"x": 1}': ["x"],
    "{\"patient's own\": 1, 'y': 2}": ["patient's own", "y"],
    "['p, q'; 'r']": ["p, q", "r"],
    "[\"patient's own\", 'r']": ["patient's own", "r"],
    "('one')": ["one"],
    "early beats (atrial)": ["early beats (atrial)"],
    "(a) b, c (d)": ["(a) b", "c (d)"],
    "71 72\t73": ["71", "72", "73"],
    "71 72 x": ["71 72 x"],
    '"71 72"': ["71 72"],
    "PR: long, q.r-s": ["PR: long", "q.r-s"],
    "patient's own, y": ["patient's own", "y"],
    "a、b，c；d · e + f & g/h": list("abcdefgh"),
    "a\r\nb\nc": ["a", "b", "c"],
    "x, x": ["x", "x"],
    "{'a', 'b'}": ["a", "b"],
    '""': [],
    "[]": [], "{}": [], "": [], "  ": [], ",,": [], "None": [], "nan": [], "null": [], "[ ]": [],
    None: [],
    "\u0001\u0002": [],
    '"open': ["open"],
}


def unpacked(spark, fields):
    df = spark.createDataFrame(list(enumerate(fields)), "index_id bigint, raw_labels string")
    out = {i: [] for i in range(len(fields))}
    for r in explode_packed(df, ["index_id"], "raw_labels").orderBy("index_id", "code_pos").collect():
        out[r.index_id].append((r.code_pos, r.code))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in out.values())
    return [[c for _, c in out[i]] for i in range(len(fields))]


def test_cases(spark):
    assert dict(zip(CASES, unpacked(spark, list(CASES)))) == CASES


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip_of_quoted_lists(spark, seed):
    r = random.Random(seed)
    alphabet = "ab ,;|/&+·:'\"(){}[]-.1"
    lists = [[("x" + "".join(r.choice(alphabet) for _ in range(r.randint(0, 8))) + "y") for _ in range(r.randint(1, 5))] for _ in range(300)]
    fields = [r.choice([", ", ";", " | ", "\t", ",,"]).join('"' + v.replace('"', '""') + '"' for v in values) for values in lists]
    assert unpacked(spark, fields) == lists


def test_empty_table_long_field_and_extra_columns(spark):
    assert unpacked(spark, []) == []
    assert len(unpacked(spark, [", ".join(["code"] * 20_000)])[0]) == 20_000
    df = spark.createDataFrame([(1, "a,b", 5, 6)], "index_id bigint, raw_labels string, code int, __t int")
    assert explode_packed(df, ["index_id"], "raw_labels").count() == 2


def test_literals_of_every_kind(spark):
    from heartlake.functions.packed import explode_literals

    rows = [(1, "{'A': 1.0, 'B': None}"), (2, "['A', 'B']"), (3, "('A',)"), (4, "{'A', 'B'}"), (5, "{\"it's\": 1}"), (6, "set()"), (7, "[]"), (8, None), (9, " "), (10, "[1, 2]")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "id int, raw string, code int")
    got = {}
    for r in explode_literals(df, ["id"], "raw").orderBy("id", "code_pos").collect():
        got.setdefault(r.id, []).append(r.code)
    assert got == {1: ["A", "B"], 2: ["A", "B"], 3: ["A"], 4: ["A", "B"], 5: ["it's"], 10: ["1", "2"]}
    with pytest.raises(Exception, match="not a literal"):
        explode_literals(spark.createDataFrame([(1, "A,B")], "id int, raw string"), ["id"], "raw").collect()

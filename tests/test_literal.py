"""Answers in list notation against the standard literal parser."""

import ast
import json
import random

from pyspark.sql import functions as F

from savora.functions import literal, response

PIECES = ["taco", "soup's", 'the "best"', "a, b", "[x]", "(1)", "back\\slash", "é", "日本 😀", "new\nline", "tab\t", "", " ", "None", "0.5", "don't", "\x07", "\u2028", "'", "a: b"]


def written(rng, value):
    """A value in one of the ways Python may write it."""
    if isinstance(value, (list, tuple)):
        inner = [written(rng, v) for v in value]
        comma = "," if inner and rng.random() < 0.2 else ""
        if isinstance(value, tuple):
            return "(" + ", ".join(inner) + ("," if len(inner) == 1 else comma) + ")"
        return "[" + rng.choice([",", ", ", " ,\n "]).join(inner) + comma + rng.choice(["", " "]) + "]"
    if isinstance(value, str):
        way = rng.randrange(4)
        if way == 0:
            return repr(value)
        if way == 1:
            return json.dumps(value, ensure_ascii=False) if not set(value) & set("\x07\u2028") else repr(value)
        quote = rng.choice("'\"")
        out = ""
        for c in value:
            if c in (quote, "\\", "\n") or ord(c) < 32 or rng.random() < 0.1:
                point = ord(c)
                out += rng.choice([f"\\U{point:08x}"] + [f"\\u{point:04X}"] * (point < 65536) + [f"\\x{point:02x}"] * (point < 256) + [f"\\{point:03o}"] * (point < 256))
            else:
                out += c
        return quote + out + quote
    return repr(value)


def flat(value):
    """As the reader gives it: texts, numbers as written, nulls."""
    if isinstance(value, (list, tuple)):
        return [flat(v) for v in value]
    if value is None or isinstance(value, bool):
        return value
    return value if isinstance(value, str) else float(value)


def same(found, expected):
    if isinstance(expected, list):
        return isinstance(found, list) and len(found) == len(expected) and all(map(same, found, expected))
    return float(found) == expected if isinstance(expected, float) else found == expected and type(found) is type(expected)


def test_literals_of_any_notation(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            inner = [value(depth - 1) for _ in range(rng.randint(0, 4))]
            return tuple(inner) if rng.random() < 0.4 else inner
        return rng.choice([None, True, False, rng.randint(-50, 50), round(rng.uniform(-2, 2), 3), 1e-7, 1e22, "".join(rng.choices(PIECES, k=2)), rng.choice(PIECES)])

    texts = [written(rng, [value(2) for _ in range(rng.randint(0, 4))]) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", literal.literal_to_json(F.col("t")).alias("j")).collect():
        expected = flat(ast.literal_eval(r.t))
        assert same(json.loads(r.j, strict=False), expected), (r.t, r.j)


def pairs(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    found = response.explode_meals(response.parse_response(rows))
    kept = {i: [] for i in range(len(texts))}
    for r in found.collect():
        kept[r.i].append((r.status, r.meal_name, r.sentiment))
    return [kept[i] for i in range(len(texts))]


def test_pairs_and_bad_neighbours(spark):
    found = pairs(
        spark,
        "[('taco', 0.9), (\"Anna's soup\", .5)]",
        "[['Anna\\'s taco', 1], ['Bob's soup', 0.25],]",
        "[['taco', 0.9], [soup, 0.5], ['x'], ['a', 'b', 1], 'ham', ['pie', None], ['cake', 1_0.5e0]]",
        "(('taco', 0.9),)",
        "[['taco', 0.9], ['soup' 0.5 ok]",
        "No Meals in Review",
        "taco, 0.9",
        "[]",
        None,
        "[[\"a\", \"0.25\"], [\"\\u00e9\\n\", 5.]]",
    )
    gone = ("ok", "", 0.5)
    assert found[0] == [("ok", "taco", 0.9), ("ok", "Anna's soup", 0.5)]
    assert found[1] == [("ok", "Anna's taco", 1.0), ("ok", "Bob's soup", 0.25)]
    assert found[2] == [("ok", "taco", 0.9), gone, gone, gone, gone, ("ok", "pie", None), ("ok", "cake", 10.5)]
    assert found[3] == [("ok", "taco", 0.9)]
    assert [f[0][0] for f in found[4:7]] == ["bad_format", "no_meals", "bad_format"]
    assert found[7] == [("ok", "", 0.5)] and found[8] == [("bad_format", "", 0.5)]
    assert found[9] == [("ok", "a", 0.25), ("ok", "é\n", 5.0)]

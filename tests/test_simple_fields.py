"""Fields read by patterns against fields that are parsed."""

import json
import random
import re

import pytest

from driftlens.functions.fields import payload, select, simple
from driftlens.operators.fields import _parsed, observed

LINES = [
    '{"k":1}', '{"k":1,"k":2}', '{"a":1,"k":"x","b":[1,2]}', '{"k":{"s":1}}', '{"k":{"s":1,"s":2}}', '{"k":[1]}', '{"K":1}', '{"k":1', '{"k":1}}', ' {"k":1}', '{ "k" : 1 , "z" : null }', '{"k":1,}', '{,"k":1}', '{"k":01}', '{"k":-0}',
    '{"k":1e5}', '{"k":1.50}', '{"k":"a\\"b"}', '{"k":"é界"}', '{"k":"\t"}', '{"k":true,"j":{"x":1,"y":[]}}', '{"k":tru}', "plain", "", '{"log":"{\\"k\\":1}\\n","stream":"stdout"}', '{"log":"x","stream":"stdout","k":3}',
    '{"k":123456789012345678901234567890}', '{"k":1.}', '{"k":.5}', '{"k":1}\r', '{"k":1} ', '{"k":"","z":{}}', '{"z":{"k":5},"k":6}', '{"z":{"a":{"k":5}},"k":6}', '{"k" :1}', '{"\\u006b":1,"k":2}', '{"k":NaN}', '[{"k":1}]',
    '2024-01-15T10:23:45Z {"k":1}', '{"k":{"s":"v"},"g":"h"}', '{"g":"h","k":{"t":1,"s":null}}', '{"k":{"s":{"d":1}}}', '{"a":[1,,2],"k":1}', '{"a":[1,],"k":1}', '{"a":{"b":1,},"k":1}', '{"a" "b","k":1}', '{"k":12345678901234567}',
]


@pytest.mark.parametrize("fields, by", [(("/k",), ()), (("/k/s",), ()), (("/k", "/g"), ()), (("/k",), ("/g",)), (("/k/s",), ("/g",)), (("/k/s/t",), ()), (("/a.b",), ()), (("/k",), ("/k",))])
def test_patterns_give_what_parsing_gives(spark, fields, by):
    r = random.Random(len(fields))
    names = ["k", "g", "s", "a.b", "axb"]

    def value(depth):
        x = r.random()
        if x < 0.5 or depth > 2:
            return r.choice([1, -7, 2.5, "v", "", None, True, "é", 'q"', "a\\b", 10**20])
        return {r.choice(names): value(depth + 1) for _ in range(r.randrange(3))} if x < 0.85 else [value(depth + 1) for _ in range(r.randrange(3))]

    rows = LINES + [json.dumps({n: value(0) for n in r.sample(names, r.randrange(1, 5))}, ensure_ascii=r.random() < 0.3, separators=r.choice([(",", ":"), (", ", ": ")])) for _ in range(600)]
    rows += ['{"pad":"' + "x" * 5000 + '","k":1,"g":2}', "{" + ",".join(f'"n{i}":{i}' for i in range(400)) + ',"k":1,"g":3}']
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "run_idx int, line_no long, raw string")
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, observed(df, fields, by).collect()), key=key) == sorted(map(tuple, _parsed(df, fields, by).collect()), key=key)


def test_a_pattern_proves_json():
    """What the pattern takes, a strict parser takes, and catches the same."""
    p = re.compile(simple(["k"]).replace(r"\z", r"\Z"))
    r = random.Random(3)
    bits = ["{", "}", "[", "]", ",", ":", '"k"', '"a"', '"', "1", "-", "0", ".", " ", "true", "null", '"k":1', '"a":2', '{"k":1}', '"k":"v"', "\\", "e5"]
    taken = 0
    for _ in range(60_000):
        line = "{" + "".join(r.choice(bits) for _ in range(r.randrange(0, 9))) + "}"
        if m := p.match(line):
            taken += 1
            why, value = payload(line)
            assert why == "ok" and select(value, ["k"]) == ("ok", m[1]), line
    assert taken > 100

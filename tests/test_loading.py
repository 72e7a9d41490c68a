import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spotlake.operators.raw_load import LAYOUTS, loaded, rejected, structured

RAW = "row_id bigint, file_kind string, line_text string, reason string"


def parse(text):
    """The fields of a record, or None if its quoting is broken, by reading character by character."""
    fields, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return None
                if text[i] == '"':
                    if i + 1 < n and text[i + 1] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            if i < n and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            value, i = text[i:j], j
            if '"' in value:
                return None
        fields.append(value)
        if i >= n:
            return fields
        i += 1


def test_structure_equals_a_character_parser(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice('a,"\n \x01b') for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    layout = (LAYOUTS[0],)
    rows = [(i, "references", t, "x") for i, t in enumerate(texts)]
    got = {r.row_id: r for r in structured(spark.createDataFrame(rows, RAW), layout).collect()}
    for i, t in enumerate(texts):
        fields = parse(t)
        want = "quoting" if fields is None else "column_count" if len(fields) != 11 else None
        assert got[i].structure == want, repr(t)
    wide = [",".join('"' + "".join(rng.choice('a,\n\x01b') for _ in range(3)) + '""x"' if rng.random() < 0.5 else rng.choice(["", "u", " v"]) for _ in range(11)) for _ in range(300)]
    got = {r.row_id: r.fields for r in structured(spark.createDataFrame([(i, "references", t, "") for i, t in enumerate(wide)], RAW), layout).collect()}
    assert all(got[i] == parse(t) for i, t in enumerate(wide))


@settings(max_examples=200, deadline=None)
@given(st.text('a,"\n', max_size=12))
def test_quote_positions_decide(text):
    parts = text.split('"')
    ok = len(parts) % 2 == 1 and all(
        i % 2 or ((i == 0 or p == "" or p.startswith(",")) and (i == len(parts) - 1 or p == "" or p.endswith(","))) for i, p in enumerate(parts)
    )
    assert ok == (parse(text) is not None)


def _ref(x="1", y="2", label="confirmed_point", rmse=""):
    return f"r,{x},{y},{label},dic,registered,{rmse},s,t,,1.0"


def _ann(x="1", y="2", label="scratch", conf=""):
    return f"i,w,c,{x},{y},,,{label},rv,{conf},,s,1.0"


def test_values_are_judged(spark):
    good = [_ref(), _ref(" +1.5e3\t", "-0"), _ref(".5", "5."), _ref(label=" Possible_Point "), _ref(rmse=" 0.0 "), _ref(rmse='"  "'), _ref('"1"')]
    bad = [_ref("-1"), _ref("1e999"), _ref("nan"), _ref("0x1"), _ref(""), _ref("1 2"), _ref("１"), _ref("."), _ref("1e"), _ref(label="scratch"), _ref(label=""), _ref(rmse="-1"), _ref(rmse="?"), _ref("1d"), _ref("1f")]
    good_a = [_ann(), _ann("", " "), _ann(conf="1"), _ann(conf="0.0"), _ann(label="UNCERTAIN")]
    bad_a = [_ann("-2"), _ann(conf="1.01"), _ann(conf="high"), _ann(label="point"), _ann(y="x")]
    lines = [("references", t) for t in good] + [("annotations", t) for t in good_a]
    n = len(lines)
    lines += [("references", t) for t in bad] + [("annotations", t) for t in bad_a]
    lines += [("references", None), ("annotations", ""), ("unknown", _ref()), (None, _ref()), ("references", 'r,"'), ("references", "a" * 200_000), ("references", '""' * 50_000)]
    df = structured(spark.createDataFrame([(i, k, t, "clash") for i, (k, t) in enumerate(lines)], RAW))
    for dictionary in (0, 1000):
        out = rejected(df, max_dictionary=dictionary)
        got = {r.row_id: r.reason for r in out.collect()}
        assert set(got) == set(range(n, len(lines)))
        assert all(got[i] == "invalid_value" for i in range(n, n + len(bad) + len(bad_a)))
        assert [got[i] for i in range(n + len(bad) + len(bad_a), len(lines))] == ["column_count"] * 4 + ["quoting"] + ["column_count"] * 2
    refs = loaded(df, out.select("row_id"), LAYOUTS[0]).collect()
    assert len(refs) == len(good) and {r.x_px for r in refs} == {1.0, 1500.0, 0.5}
    assert loaded(df, out.select("row_id"), LAYOUTS[1]).count() == len(good_a)


def test_faults_and_empty(spark):
    df = structured(spark.createDataFrame([(1, "references", _ref("-1", "x"), "")] * 3 + [(None, "references", _ref("?"), "")], RAW))
    got = {r.row_id: r.faults for r in rejected(df).collect()}
    assert got == {1: ["x_px: below 0", "y_px: not a number"], None: ["x_px: not a number"]}
    assert rejected(structured(spark.createDataFrame([], RAW))).count() == 0

"""Key styles (P10-P14, A6): the reference's inline cases, corrected per SURVEY §1.5."""
import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import keys as K

CASES = [
    ("camelCase", ["user_name", "first_name_last", "user-name", "user name", "User_Name", "API-Key"],
     ["userName", "firstNameLast", "userName", "userName", "userName", "apiKey"]),
    ("snake_case", ["userName", "apiKeyValue", "user-name", "user name", "USER_NAME"],
     ["user_name", "api_key_value", "user_name", "user_name", "user_name"]),
    ("lowercase", ["userName", "USER_NAME", "User Name", "user-name"], ["user_name"] * 4),
    ("uppercase", ["userName", "user_name", "User Name", "user-name"], ["USER_NAME"] * 4),
    ("snake_case", ["user1Name"], ["user1_name"]),      # D16 follows the test
    ("camelCase", ["user_1_name"], ["user1Name"]),
    ("camelCase", ["UserName", "HTMLParser"], ["username", "htmlparser"]),  # D17
]


@pytest.mark.parametrize("style,keys,expected", CASES)
def test_transform_key(style, keys, expected):
    assert [N.transform_key(k, style) for k in keys] == expected


@pytest.mark.parametrize("style,keys,expected", CASES)
def test_transform_key_column_matches_python(spark, style, keys, expected):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(N.transform_key_col(F.col("k"), style)).collect()]
    assert got == expected


def test_detect_style_lowercase_keys():
    # A key without underscore and capitals is lowercase
    res = K.detect_key_style(["username", "firstname", "apikey"])
    assert res["detected_style"] == "lowercase" and res["confidence"] == 1.0


def test_detect_style_mixed_and_ties():
    assert K.detect_key_style(["userName", "user_name"])["detected_style"] == "camelCase"  # tie -> camel
    assert K.detect_key_style(["a-b", "C d", "userName"])["detected_style"] == "unknown"  # D19: mixed majority
    assert K.detect_key_style(["userName", "user_name", "ID", "a-b"])["detected_style"] == "mixed"  # below 50 %
    assert K.detect_key_style([])["detected_style"] == "unknown"


def test_simple_variant():
    assert N.transform_key_simple("user_name_x", "camelCase") == "userNameX"
    assert N.transform_key_simple("userName", "snake_case") == "user_name"
    assert N.transform_key_simple("UserName", "snake_case") == "_user_name"


def test_key_style_dataframe_nested(spark):
    df = spark.createDataFrame([(1, (2, [(3,)]))], "user_id int, user_info struct<home_city:int, past_items:array<struct<item_id:int>>>")
    out = K.key_style(df, "camelCase")
    assert out.columns == ["userId", "userInfo"]
    assert out.select(F.to_json("userInfo")).first()[0] == '{"homeCity":2,"pastItems":[{"itemId":3}]}'


def test_key_style_collision(spark):
    df = spark.createDataFrame([(1, 2)], "user_name int, userName int")
    with pytest.raises(ValueError):
        K.key_style(df, "camelCase")
    assert K.key_style(df, "camelCase", on_collision="last").columns == ["userName"]


def test_census_and_suggestions(spark):
    keys = spark.createDataFrame([(k,) for k in ["userName", "user_name", "user name", "ID", "id"]], "key string")
    census = {r["style"]: r["key_count"] for r in K.key_style_census(keys).collect()}
    assert census == {"camelCase": 1, "snake_case": 1, "lowercase": 1, "uppercase": 1, "mixed": 1}
    sugg = {r["key"]: r for r in K.key_suggestions(keys, style="snake_case").collect()}
    assert sugg["user name"]["issues"] == ["Contains spaces"]
    assert sugg["user name"]["transformed"] == "user_name"


def test_xml_name_sanitise():
    assert N.sanitize_xml_name("1 bad name") == "_1_bad_name"
    assert N.sanitize_xml_name("xmlData") == "field_xmlData"


def test_python_and_column_styles_agree_on_random_keys(spark):
    """Property check: the driver-side name functions and the Column expressions agree."""
    from hypothesis import given, settings, strategies as st

    alphabet = st.sampled_from(list("abcXYZ019_- .$"))
    keys = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet=alphabet, min_size=1, max_size=12))
    def collect(k):
        keys.append(k)
    collect()
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    exprs = [N.transform_key_col(F.col("k"), s).alias(s) for s in N.STYLES]
    exprs += [N.classify_key_col(F.col("k")).alias("cls")]
    exprs += [N.transform_key_simple_col(F.col("k"), s).alias("simple_" + s) for s in N.STYLES]
    for r in df.select("k", *exprs).collect():
        for s in N.STYLES:
            assert r[s] == N.transform_key(r.k, s), (r.k, s, r[s])
            assert r["simple_" + s] == N.transform_key_simple(r.k, s), (r.k, s)
        assert r.cls == N.classify_key(r.k), r.k

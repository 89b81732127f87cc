import hashlib
import re

import pytest
from pyspark.sql import functions as F

from postlake.functions import marks as M, periods as P, register, text as X
from postlake.operators import shards as D


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or ("x",)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names, row))
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("Check this out https://example.com it's great!", "Check this out it's great!"),
        ("Hello @user how are you?", "Hello how are you?"),
        ("Love #Python programming #coding", "Love programming"),
        ("Hello    world   test", "Hello world test"),
        ("", ""),
        ("mail a@b.com now", "mail a.com now"),
        ("prehttp://x.y z", "pre z"),
        ("httpwww.x a", "a"),
        ("wwwhttp://x a", "a"),
        ("a www", "a www"),
        (" a b\x1cc　", "a b c"),
        ("@é_1 ü #日本 x", "ü x"),
    ],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, X.clean_text("t"), t=raw) == cleaned
    by_python = re.sub(r"http\S+|www\S+|https\S+", "", raw)
    assert " ".join(re.sub(r"#\w+", "", re.sub(r"@\w+", "", by_python)).split()) == cleaned


def test_clean_null(spark):
    assert one(spark, X.clean_text("t"), t=None) is None


@pytest.mark.parametrize(
    "raw, name",
    [("bitcoin price analysis", "bitcoin_price_analysis"), ("gold/silver & crypto!", "gold_silver___crypto_"), ("a" * 50, "a" * 30), ("né-日", "né_日")],
)
def test_safe_name(spark, raw, name):
    assert one(spark, X.safe_name("t"), t=raw) == name


def test_matches(spark):
    raw = "See http://a.b/c?d=1#top and https://x.y/{z} #One#two @me_2 plain"
    assert one(spark, X.urls("t"), t=raw) == ["http://a.b/c?d=1", "https://x.y/"]
    assert one(spark, X.hashtags("t"), t=raw) == re.findall(r"#\w+", raw)
    assert one(spark, X.mentions("t"), t=raw) == ["@me_2"]


def test_metadata_keeps_repeats(spark):
    got = one(spark, X.metadata_entries("t"), t="#a #a @b")
    assert [(r["metadata_type"], r["value"]) for r in got] == [("hashtag", "#a"), ("hashtag", "#a"), ("mention", "@b")]


@pytest.mark.parametrize(
    "statement, kind",
    [("  select 1", "SELECT"), ("\nInsert into t", "INSERT"), ("update t", "UPDATE"), ("DELETE", "DELETE"), ("with x", "OTHER"), ("", "OTHER")],
)
def test_query_type(spark, statement, kind):
    assert one(spark, X.query_type("t"), t=statement) == kind


@pytest.mark.parametrize(
    "text, term, hit",
    [("Gold Rush", "gOLD", True), ("50% off", "0%o", True), ("É", "é", False), ("a\\b", "\\b", True), ("abc", "a_c", True)],
)
def test_like_any_case(spark, text, term, hit):
    assert one(spark, X.like_any_case("t", term), t=text) is hit


@pytest.mark.parametrize(
    "raw, hit",
    [
        ("2024-03-15T10:30:00", "2024-03-15 10:30:00"), ("2024-03-15T10:30:00Z", "2024-03-15 10:30:00"),
        ("2024-03-15T10:30:00+09:00", "2024-03-15 01:30:00"), ("2024-03-15", "2024-03-15 00:00:00"),
        ("2024-13-01", None), ("2024-02-30T00:00:00", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_parse_iso(spark, raw, hit):
    assert one(spark, F.date_format(P.parse_iso("t"), "yyyy-MM-dd HH:mm:ss"), t=raw) == hit


@pytest.mark.parametrize(
    "created, per_year, key",
    [
        ("2024-03-15T10:30:00", 4, "2024_Q1"), ("2024-06-20T15:45:00", 4, "2024_Q2"), ("2024-11-10T08:15:00", 4, "2024_Q4"),
        ("2024-03-31T23:59:59+09:00", 4, "2024_Q1"), ("2024-04-01T00:30:00+09:00", 4, "2024_Q2"),
        ("2024-12-31", 12, "2024_12"), ("2024-01-01", 12, "2024_01"), ("2024-12-31", 6, "2024_S06"), ("2024-03-01", 6, "2024_S02"),
        ("2024-12-31", 24, "2024_S23"),
    ],
)
def test_shard_key(spark, created, per_year, key):
    assert one(spark, P.shard_key("c", "i", per_year), c=created, i="7") == key


@pytest.mark.parametrize("modulus", [2, 3, 4, 6, 7, 12, 24, 1 << 30])
def test_md5_slot(spark, modulus):
    ids = [str(i * 7919) for i in range(200)] + ["", "é"]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", P.md5_slot("i", modulus).alias("m")).collect()
    assert {r["i"]: r["m"] for r in got} == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % modulus for i in ids}


def test_fallback(spark):
    slot = int(hashlib.md5(b"9").hexdigest(), 16) % 4 + 1
    assert one(spark, P.shard_key("c", "i", 4), c="soon", i="9") == f"fallback_S{slot:02d}"


@pytest.mark.parametrize(
    "start, end, per_year, keys",
    [
        ("2024-01-31", "2024-03-01", 12, ["2024_01", "2024_02", "2024_03"]),
        ("2024-02-15", "2024-07-01", 4, ["2024_Q1", "2024_Q2", "2024_Q3"]),
        ("2023-12-31", "2024-01-01", 4, ["2023_Q4", "2024_Q1"]),
        ("2024-05-31", "2024-06-01", 6, ["2024_S03"]),
        ("2024-05-02", "2024-05-01", 4, []),
    ],
)
def test_shards_in_range(spark, start, end, per_year, keys):
    assert one(spark, P.shards_in_range("a", "b", per_year), a=start, b=end) == keys
    assert D.shard_names(start, end, per_year) == keys


@pytest.mark.parametrize("value, label", [(0.05, "positive"), (-0.05, "negative"), (0.0499, "neutral"), (0.0, "neutral")])
def test_label_compound(spark, value, label):
    assert one(spark, M.label_from_compound("v"), v=value) == label


@pytest.mark.parametrize("value, band", [(90.0, "degraded"), (90.1, "unhealthy"), (80.0, "healthy"), (80.5, "degraded")])
def test_band(spark, value, band):
    assert one(spark, M.threshold_band("v"), v=value) == band


def test_ttl(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' c, explode(array(0, null, 60, 9999)) t")
    got = rows.select(F.unix_timestamp(M.expires_at("c", "t", 1800, 3600)) - F.unix_timestamp("c")).collect()
    assert [r[0] for r in got] == [1800, 1800, 60, 3600]
    edge = rows.limit(1).select(M.alive(F.col("c"), "c"), M.alive(F.col("c"), "c", inclusive=False)).first()
    assert tuple(edge) == (True, False)


def test_sql_functions(spark):
    names = register.register(spark)
    assert "post_clean" in names
    got = spark.sql(
        "select post_clean('Hi @u  http://x #t'), post_hashtags('#a b'), post_safe_name('a/b'), label_compound(0.05D), "
        "threshold_band(85D), post_urls('see https://a.b/c'), size_mb(1572864D), post_mentions('@a'), label_polarity(-1D)"
    ).first()
    assert list(got) == ["Hi", ["#a"], "a_b", "positive", "degraded", ["https://a.b/c"], 1.5, ["@a"], "negative"]


def test_every_function_has_its_sql_name(spark):
    """By name and as a column: the same values, over texts, dates and numbers with holes."""
    from postlake.functions import register as R

    assert len(R.register(spark)) == len(R.SQL_FUNCTIONS) > 20
    texts = ["Read www.a.b #tag @me https://x.y/z it's 'here' \\ \"q\"", "  insert into t", "2024-05-06T07:08:09", "not a date", "", None, "I love it", "a_b%"]
    rows = [(t, texts[(i + 3) % 8], "2024-01-15", "2024-07-01" if i else "2023-01-01", v, None if i == 2 else i * 0.5, i * 600 or None) for i, (t, v) in enumerate(zip(texts, [0.05, -0.05, 0.0, None, 85.0, 95.0, 1e9, -3.0]))]
    df = spark.createDataFrame(rows, "t string, id string, d string, e string, v double, w double, n int").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.coalesce("n", F.lit(0))))
    fit = {"STRING": ["t", "id", "id"], "DOUBLE": ["v", "w"], "INT": ["n", "n"], "TIMESTAMP": ["at", "at"]}
    for name, (params, make) in R.SQL_FUNCTIONS.items():
        own = [p.split(" ") for p in params.split(", ")]
        pools = {k: iter(v) for k, v in fit.items()}
        given = [next(pools[kind]) for _, kind in own]
        if name == "shards_in_range":
            given = ["d", "e"]
        args = df.select(*[F.col(g).alias(p) for (p, _), g in zip(own, given)])
        want = [r[0] for r in args.select(make()).collect()]
        got = [r[0] for r in df.selectExpr(f"{name}({', '.join(given)})").collect()]
        assert got == want, name

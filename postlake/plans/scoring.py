"""Scoring queries. The prose of the tables is invented, so frequent function words carry fixed valences."""

from pyspark.sql import functions as F

from postlake.functions.text import SPACES
from postlake.operators import lexicon as L, scoring as N
from postlake.plans.registry import query
from postlake.plans.text import CLEAN_SQL
from postlake.session import scratch_path, spread

#: Fixed values for the scale queries.
VALENCES = {"the": 0.1, "is": 0.3, "was": -0.4, "that": 0.2, "of": -0.1, "with": 0.5}
FIXTURE = L.ValenceLexicon(VALENCES, {"are": L.BOOST}, ("at",))
POLARITIES = {"the": (0.1, 0.2), "is": (0.3, 0.5), "was": (-0.4, 0.6), "with": (0.5, 0.9)}
FIXTURE_POLARITY = L.PolarityLexicon(POLARITIES, {"are": 1.3, "and": 0.7}, ("at",))

_PUNCT = N.ASCII_PUNCTUATION.replace("'", "''")
_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tokens(source: str, text: str) -> str:
    return f"""base AS MATERIALIZED (SELECT id, coalesce({text}, '') AS body, list_filter(list_transform(
        regexp_split_to_array(coalesce({text}, ''), '{SPACES}'), lambda t: trim(t, '{_PUNCT}')), lambda t: t <> '') AS toks FROM {source}),
      tok AS (SELECT id, generate_subscripts(toks, 1) AS i, unnest(toks) AS raw FROM base),
      folded AS (SELECT *, {_FOLD.format(c='raw')} AS f FROM tok)"""


def _upper(c: str) -> str:
    return f"(regexp_matches({c}, '\\p{{Lu}}') AND NOT regexp_matches({c}, '\\p{{Ll}}'))"


def _fixed(value: str, digits: int) -> str:
    return f"round(CAST({value} AS DECIMAL(20,12)), {digits})::DOUBLE"


def valence_sql(source: str, text: str) -> str:
    lex = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in VALENCES.items())
    near = ", ".join(
        f"lag(v, {d}) OVER w AS v{d}, lag(step, {d}) OVER w AS s{d}, lag(neg, {d}) OVER w AS n{d}" for d in (1, 2, 3)
    )
    boost = " + ".join(
        f"CASE WHEN v{d} IS NULL AND s{d} IS NOT NULL THEN s{d} * sign(v) * {k}::DOUBLE ELSE 0 END"
        for d, k in zip((1, 2, 3), N.STEP_BACK)
    )
    return f"""{_tokens(source, text)},
      lex(token, v) AS (VALUES {lex}),
      cells AS (SELECT id, i, raw, f, v, CASE WHEN f = 'are' THEN 0.293::DOUBLE END AS step, f = 'at' AS neg
        FROM folded LEFT JOIN lex ON f = token),
      near AS (SELECT *, {near}, bool_or(NOT {_upper('raw')}) OVER (PARTITION BY id) AS mixed,
        min(CASE WHEN f = 'but' THEN i END) OVER (PARTITION BY id) AS but_at FROM cells WINDOW w AS (PARTITION BY id ORDER BY i)),
      v1 AS (SELECT id, i, but_at, CASE WHEN n1 OR n2 OR n3 THEN -0.74::DOUBLE ELSE 1 END *
        (v + CASE WHEN mixed AND {_upper('raw')} THEN 0.733::DOUBLE * sign(v) ELSE 0 END + {boost}) AS x
        FROM near WHERE v IS NOT NULL AND v <> 0),
      v2 AS (SELECT id, CASE WHEN but_at IS NULL OR i = but_at THEN x WHEN i < but_at THEN x * 0.5 ELSE x * 1.5 END AS x FROM v1),
      sums AS (SELECT id, sum(x) AS s0, sum(CASE WHEN x > 0 THEN x + 1 ELSE 0 END) AS p0, sum(CASE WHEN x < 0 THEN 1 - x ELSE 0 END) AS n0,
        count(*) FILTER (x <> 0) AS used FROM v2 GROUP BY id),
      marks AS (SELECT id, len(toks) AS n_tok, length(body) - length(replace(body, '!', '')) AS bangs,
        length(body) - length(replace(body, '?', '')) AS asks FROM base),
      parts AS (SELECT id, coalesce(s0, 0) AS s0, coalesce(p0, 0) AS p0, coalesce(n0, 0) AS n0, n_tok - coalesce(used, 0) AS z,
        least(bangs, 4) * 0.292::DOUBLE + CASE WHEN asks < 2 THEN 0 WHEN asks < 4 THEN asks * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS e
        FROM marks LEFT JOIN sums USING (id)),
      fin AS (SELECT id, s0 + e * sign(round(s0, 9)) AS s, p0 + CASE WHEN round(p0 - n0, 9) > 0 THEN e ELSE 0 END AS p,
        n0 + CASE WHEN round(n0 - p0, 9) > 0 THEN e ELSE 0 END AS n, z FROM parts),
      shares AS (SELECT id, {_fixed('s / sqrt(s * s + 15)', 4)} AS compound, {_fixed('coalesce(p / nullif(p + n + z, 0), 0)', 3)} AS positive,
        {_fixed('coalesce(n / nullif(p + n + z, 0), 0)', 3)} AS negative, {_fixed('coalesce(z / nullif(p + n + z, 0), 0)', 3)} AS neutral FROM fin),
      valence AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
        FROM shares)"""


def polarity_sql(source: str, text: str) -> str:
    lex = ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, (p, s) in POLARITIES.items())
    return f"""{_tokens(source, text)},
      lex(token, p, s) AS (VALUES {lex}),
      cells AS (SELECT id, i, p, s, CASE f WHEN 'are' THEN 1.3::DOUBLE WHEN 'and' THEN 0.7::DOUBLE END AS m, f = 'at' AS neg
        FROM folded LEFT JOIN lex ON f = token),
      near AS (SELECT *, coalesce(lag(m) OVER w, 1) AS k, coalesce(lag(neg) OVER w, false) OR coalesce(lag(neg, 2) OVER w, false) AS no
        FROM cells WINDOW w AS (PARTITION BY id ORDER BY i)),
      vals AS (SELECT id, greatest(-1, least(1, p * k)) * CASE WHEN no THEN -0.5::DOUBLE ELSE 1 END AS p,
        greatest(0, least(1, s * k)) AS s FROM near WHERE p IS NOT NULL),
      means AS (SELECT id, avg(p) AS p, avg(s) AS s FROM vals GROUP BY id),
      fixed AS (SELECT id, {_fixed('coalesce(p, 0)', 6)} AS polarity, {_fixed('coalesce(s, 0)', 6)} AS subjectivity
        FROM base LEFT JOIN means USING (id)),
      polar AS (SELECT *, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END AS label FROM fixed)"""


@query("score_valence", "tw", ", " + valence_sql("tw", "text") + " SELECT * FROM valence")
def _(t):
    scored = N.score(t.texts().select("id", "text"), "vader", lexicon=FIXTURE, prefix="")
    return scored.select("id", *N.SCORE_FIELDS["vader"])


@query("score_valence_table", "tw", ", " + valence_sql("tw", "text") + " SELECT * FROM valence")
def _(t):
    """The same rule through a join, for a lexicon of any size; here the words come from the texts."""
    seen = t.texts().select(F.explode(N.tokens("text")).alias("token"))
    words = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token")
    valence = F.lit(None).cast("double")
    for w, v in VALENCES.items():
        valence = F.when(F.col("token") == w, v).otherwise(valence)
    table = words.select(
        "token", valence.alias("valence"), F.when(F.col("token") == "are", L.BOOST).alias("step"),
        F.when(F.col("token") == "at", True).alias("negation"),
    ).filter(F.coalesce(F.col("valence").isNotNull() | F.col("step").isNotNull() | F.col("negation"), F.lit(False)))
    return N.score_with_table(t.texts().select("id", "text"), table, "id")


@query("score_polarity", "tw", ", " + polarity_sql("tw", "text") + " SELECT * FROM polar")
def _(t):
    scored = N.score(t.texts().select("id", "text"), "textblob", lexicon=FIXTURE_POLARITY, prefix="")
    return scored.select("id", *N.SCORE_FIELDS["textblob"])


_BLANKS = "(SELECT id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN repeat(' ', 3) ELSE text END AS text FROM tw)"


@query("score_blank_guard", "tw", ", " + valence_sql(_BLANKS, "text") + " SELECT id, compound, label FROM valence")
def _(t):
    n = F.col("id").cast("bigint") % 3
    holes = F.when(n == 1, "   ").when(n == 2, F.col("text"))
    scored = N.score(t.texts().select("id", holes.alias("text")), "vader", lexicon=FIXTURE, prefix="")
    return scored.select("id", "compound", "label")


@query(
    "score_batch_clean", "tw",
    f", cleaned AS (SELECT id, {CLEAN_SQL} AS text FROM tw), " + valence_sql("cleaned", "text")
    + " SELECT id, compound AS sentiment_compound, label AS sentiment_label FROM valence",
)
def _(t):
    scored = N.enrich(t.texts().select("id", "text"), lexicon=FIXTURE)
    return scored.select("id", "sentiment_compound", "sentiment_label")


@query(
    "score_by_method", "tw",
    f", v AS (WITH {valence_sql('tw', 'text')} SELECT id, 'vader' AS method, label, compound AS score FROM valence)"
    f", p AS (WITH {polarity_sql('tw', 'text')} SELECT id, 'textblob' AS method, label, polarity AS score FROM polar)"
    " SELECT * FROM v UNION ALL SELECT * FROM p",
)
def _(t):
    posts = t.texts().select("id", "text")
    parts = []
    for method, lexicon, field in (("vader", FIXTURE, "compound"), ("textblob", FIXTURE_POLARITY, "polarity")):
        s = N.score(posts, method, lexicon=lexicon, prefix="")
        parts.append(s.select("id", "method", "label", F.col(field).alias("score")))
    return parts[0].unionByName(parts[1])


@query(
    "memo_score_distinct", "",
    ", d AS (SELECT doc_id::VARCHAR AS id, text FROM documents), " + valence_sql("d", "text")
    + " SELECT id, compound AS sentiment_compound, label AS sentiment_label FROM valence",
)
def _(t):
    docs = spread(t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    return N.score_distinct(docs, lexicon=FIXTURE).select("id", "sentiment_compound", "sentiment_label")


@query(
    "memo_score_stored", "",
    ", d AS (SELECT doc_id::VARCHAR AS id, text FROM documents), " + valence_sql("d", "text")
    + " SELECT id, compound AS sentiment_compound, label AS sentiment_label FROM valence",
)
def _(t):
    """Two runs over a stored memo: documents of even ids first, then all of them, which scores the others only."""
    docs = spread(t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    memo = N.ScoreMemo(t.spark, scratch_path(t.spark, "score-memo"), lexicon=FIXTURE)
    memo.score(docs.filter(F.col("id").cast("bigint") % 2 == 0))
    return memo.score(docs).select("id", "sentiment_compound", "sentiment_label")


ENRICH_COLUMNS = (
    "id", "username", "lang", "text", "cleaned_text", "sentiment_label", "sentiment_compound", "sentiment_positive",
    "sentiment_negative", "sentiment_neutral", "sentiment_method",
)


@query(
    "enrich_posts", "tw",
    f", cleaned AS (SELECT id, username, lang, {CLEAN_SQL} AS text FROM tw), " + valence_sql("cleaned", "text")
    + """ SELECT id, username, lang, text, 1 AS cleaned_text, label AS sentiment_label, compound AS sentiment_compound,
      positive AS sentiment_positive, negative AS sentiment_negative, neutral AS sentiment_neutral, 'vader' AS sentiment_method
      FROM cleaned JOIN valence USING (id)""",
)
def _(t):
    return N.enrich(t.texts(), lexicon=FIXTURE).select(*ENRICH_COLUMNS)

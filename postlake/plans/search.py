"""Search predicates over posts."""

from postlake.functions.text import HASHTAG, MENTION, WORD_CHARS
from postlake.operators import search as Q
from postlake.plans.registry import query

_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _FOLD.format(c="text")
_EDGE = f"[^{WORD_CHARS}]"


def _word(term):
    return f"regexp_matches({_TEXT}, '(?:^|{_EDGE}){term}(?:{_EDGE}|$)')"


# ISO text with an optional +09:00, as the fixture has it.
_TS = """(try_cast(substr(CASE WHEN regexp_matches(created_at, '^\\d{4}-') THEN created_at END, 1, 19) AS TIMESTAMP)
  - CASE WHEN created_at LIKE '%+09:00' THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END)"""


@query("match_keywords", "tw", f"SELECT id FROM tw WHERE {_word('the')} AND {_word('with')}")
def _(t):
    return t.posts().filter(Q.keywords("The", "WITH")).select("id")


@query("match_phrase", "tw", f"SELECT id FROM tw WHERE contains({_TEXT}, 'of the')")
def _(t):
    return t.posts().filter(Q.phrase("of THE")).select("id")


@query("match_from", "tw", "SELECT id, username FROM tw WHERE username = 'user_17'")
def _(t):
    return t.posts().filter(Q.from_user("USER_17")).select("id", "username")


@query(
    "match_mention", "tw",
    f"SELECT id FROM tw WHERE list_contains(regexp_extract_all({_TEXT}, '{MENTION}'), '@src4')",
)
def _(t):
    return t.posts().filter(Q.mentions_user("Src4")).select("id")


@query("match_hashtag", "tw", f"SELECT id FROM tw WHERE list_contains(regexp_extract_all({_TEXT}, '{HASHTAG}'), '#fr')")
def _(t):
    return t.posts().filter(Q.has_hashtag("FR")).select("id")


@query(
    "match_since_until", "tw",
    f"SELECT id, created_at FROM tw WHERE {_TS} >= TIMESTAMP '2024-03-01' AND {_TS} < TIMESTAMP '2024-08-01'",
)
def _(t):
    return t.posts().filter(Q.since("2024-03-01") & Q.until("2024-08-01")).select("id", "created_at")


@query("match_any", "tw", f"SELECT id FROM tw WHERE {_word('und')} OR {_word('les')}")
def _(t):
    return t.posts().filter(Q.any_of("und", "les")).select("id")


@query("match_lang", "tw", "SELECT id, lang FROM tw WHERE lang = 'es'")
def _(t):
    return t.posts().filter(Q.language("es")).select("id", "lang")


@query("match_exclude", "tw", f"SELECT id FROM tw WHERE NOT {_word('the')}")
def _(t):
    return t.posts().filter(Q.exclude("the")).select("id")


@query(
    "match_combined", "tw",
    f"""SELECT id, lang FROM tw WHERE ({_word('the')} OR {_word('and')}) AND lang = 'en'
      AND {_TS} >= TIMESTAMP '2024-02-01' AND {_TS} < TIMESTAMP '2024-12-01'""",
)
def _(t):
    # The cheap comparisons come first, the patterns last.
    hit = Q.language("en") & Q.since("2024-02-01") & Q.until("2024-12-01") & Q.any_of("the", "and")
    return t.posts().filter(hit).select("id", "lang")


@query("fn_parse_iso", "tw", f"SELECT id, strftime({_TS}, '%Y-%m-%d %H:%M:%S') AS created FROM tw")
def _(t):
    from postlake.functions.periods import parse_iso
    from postlake.plans.fixtures import iso

    return t.posts().select("id", iso(parse_iso("created_at")).alias("created"))



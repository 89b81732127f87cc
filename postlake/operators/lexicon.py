"""Word lists for scoring, and their look-up inside a column expression."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the scoring rule.
BOOST, CAPS, NEGATE = 0.293, 0.733, -0.74
#: Rows of a word list that may become part of a plan.
MOST_WORDS = 200_000


@dataclass(frozen=True)
class ValenceLexicon:
    valences: dict[str, float]
    boosters: dict[str, float] = field(default_factory=dict)
    negations: tuple[str, ...] = ()

    def entries(self) -> dict[str, tuple]:
        """Every word the rule looks at; ``but`` is always one of them."""
        words = {*self.valences, *self.boosters, *self.negations, "but"}
        return {
            w: (self.valences.get(w), self.boosters.get(w), True if w in self.negations else None, w == "but")
            for w in sorted(words)
        }

    def all_words_have_letter_pairs(self) -> bool:
        return all(re.search("[a-z]{2}", w) for w in self.valences)

    fields = (("v", "double"), ("b", "double"), ("neg", "boolean"), ("but", "boolean"))


@dataclass(frozen=True)
class PolarityLexicon:
    words: dict[str, tuple[float, float]]
    modifiers: dict[str, float] = field(default_factory=dict)
    negations: tuple[str, ...] = ()

    def entries(self) -> dict[str, tuple]:
        words = {*self.words, *self.modifiers, *self.negations}
        return {
            w: (*self.words.get(w, (None, None)), self.modifiers.get(w), True if w in self.negations else None)
            for w in sorted(words)
        }

    fields = (("p", "double"), ("s", "double"), ("m", "double"), ("neg", "boolean"))


def lookup(lexicon: ValenceLexicon | PolarityLexicon):
    """A function token -> struct of the word's properties (null for other words).

    The words are spread over as many small maps as there are words, so a look-up compares one or
    two strings. All maps are one JSON constant, folded once when the query is planned: the plan has
    the same few nodes for ten words and for a million, and needs neither a join nor a shuffle.
    """
    entries = lexicon.entries()
    shape = "struct<" + ",".join(f"{n}:{t}" for n, t in lexicon.fields) + ">"
    n = max(len(entries), 1)
    groups: list[dict[str, dict]] = [{} for _ in range(n)]
    for word, properties in entries.items():
        cell = {f: p for p, (f, _) in zip(properties, lexicon.fields, strict=True) if p is not None}
        groups[zlib.crc32(word.encode("utf-8")) % n][word] = cell
    text = json.dumps({"groups": groups}, ensure_ascii=False)
    table = F.from_json(F.lit(text), f"struct<groups:array<map<string,{shape}>>>", {"mode": "FAILFAST"})["groups"]

    def find(token: Column) -> Column:
        group = F.pmod(F.crc32(token.cast("binary")), F.lit(n).cast("bigint")).cast("int")
        return F.element_at(F.get(table, group), token)

    return find


def from_table(df: DataFrame) -> ValenceLexicon:
    """Read a (token, valence, step, negation) word list of at most ``MOST_WORDS`` rows into the plan.

    For lists made by people; longer ones, and words that are derived from data, stay a table (``score_with_table``).
    """
    rows = df.select("token", "valence", "step", "negation").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words: use score_with_table")
    return ValenceLexicon(
        {r.token: r.valence for r in rows if r.valence is not None},
        {r.token: r.step for r in rows if r.step is not None},
        tuple(r.token for r in rows if r.negation),
    )


NEGATIONS = (
    "not", "no", "never", "none", "neither", "nor", "nothing", "nowhere", "cannot", "can't", "don't", "doesn't",
    "didn't", "isn't", "wasn't", "aren't", "weren't", "won't", "wouldn't", "shouldn't", "couldn't", "without",
)

#: A small list of everyday words with strengths chosen for this engine.
ENGLISH = ValenceLexicon(
    valences={
        "love": 3.0, "amazing": 2.8, "great": 3.0, "excellent": 2.9, "good": 1.9, "nice": 1.8, "happy": 2.6,
        "best": 3.1, "recommend": 1.5, "wonderful": 2.7, "fantastic": 2.6, "enjoy": 2.2, "perfect": 2.7,
        "helpful": 1.8, "exceeded": 1.2, "win": 2.7, "beautiful": 2.8, "thanks": 1.9, "improved": 1.6,
        "hate": -2.9, "terrible": -2.4, "worst": -3.1, "bad": -2.5, "awful": -2.3, "poor": -2.0, "horrible": -2.5,
        "disappointed": -2.0, "regret": -1.7, "waste": -1.8, "sad": -2.1, "angry": -2.3, "broken": -1.6,
        "fail": -2.4, "useless": -1.8, "ugly": -2.2, "problem": -1.6, "wrong": -2.1, "lose": -1.7, "fear": -2.2,
    },
    boosters={
        "very": BOOST, "really": BOOST, "absolutely": BOOST, "extremely": BOOST, "so": BOOST, "totally": BOOST,
        "most": BOOST, "especially": BOOST, "slightly": -BOOST, "somewhat": -BOOST, "barely": -BOOST, "hardly": -BOOST,
    },
    negations=NEGATIONS,
)

ENGLISH_POLARITY = PolarityLexicon(
    words={
        "love": (0.5, 0.6), "amazing": (0.6, 0.9), "great": (0.8, 0.75), "excellent": (1.0, 1.0), "good": (0.7, 0.6),
        "nice": (0.6, 1.0), "happy": (0.8, 1.0), "best": (1.0, 0.3), "wonderful": (1.0, 1.0), "perfect": (1.0, 1.0),
        "hate": (-0.8, 0.9), "terrible": (-1.0, 1.0), "worst": (-1.0, 1.0), "bad": (-0.7, 0.67), "awful": (-1.0, 1.0),
        "poor": (-0.4, 0.6), "horrible": (-1.0, 1.0), "disappointed": (-0.75, 0.75), "waste": (-0.2, 0.0),
        "useless": (-0.5, 0.2), "wrong": (-0.5, 0.9), "sad": (-0.5, 1.0), "ugly": (-0.7, 1.0), "special": (0.36, 0.57),
    },
    modifiers={"very": 1.3, "really": 1.3, "absolutely": 1.4, "extremely": 1.4, "slightly": 0.7, "somewhat": 0.8},
    negations=NEGATIONS,
)

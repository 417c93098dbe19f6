"""Resolving company mentions against a master table.

"Name contains mention" has no join key of its own. Each mention is keyed by
its rarest short substring (gram), each name by all of its grams, so the search
becomes an equality join followed by an exact check. Hot grams are salted.

Names are never broadcast: Spark knows the size of their files, not that of their grams or of compressed texts once
read. So joins with them ask for a shuffle.

"Mention contains name" is the other way round: many fixed names, looked for in many texts. The names go into
automata of bounded size (Aho-Corasick), and every distinct text passes each automaton once.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_entities, contains_ignore_case
from quarry.operators.ranking import top_n

GRAM_CHARS = 3
SALTS = 16
# Characters of names in one automaton, and of texts that one task runs through it.
NAME_CHARS = 2_000_000
TEXT_CHARS = 32_000_000


def _grams(text: Column, widths: Iterable[Column]) -> Column:
    """Distinct substrings of `text` with the given lengths."""

    def of_width(width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - width + 1)
        cut = F.transform(starts, lambda at: F.substring(text, at, width))
        return F.when(F.length(text) >= width, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of_width, widths)))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the master table."""
    return df.hint("merge")


def _all_grams(text: Column) -> Column:
    return _grams(text, [F.lit(w) for w in range(1, GRAM_CHARS + 1)])


def usable_mentions(calls: DataFrame) -> DataFrame:
    """Explode `(call_id, mentions array)` to cleaned `(call_id, mention)` rows."""
    return calls.select("call_id", F.explode(clean_entities(F.col("mentions"))).alias("mention"))


def _name_matches(mentions: DataFrame, master: DataFrame) -> DataFrame:
    """All `(call_id, mention, symbol)` where the name contains the mention."""
    folded = F.lower("mention")
    width = F.least(F.length(folded), F.lit(GRAM_CHARS))
    mention_grams = mentions.withColumn("gram", F.explode(_grams(folded, [width])))
    name_grams = master.select(
        "symbol",
        "organ_name",
        F.explode(_all_grams(F.lower("organ_name"))).alias("gram"),
        F.pmod(F.xxhash64("symbol"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    name_grams = name_grams.join(mention_grams.select("gram").distinct(), "gram", "left_semi")
    frequency = name_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    # Mentions without a common gram cannot match, so the inner join may drop them.
    rarest = (
        mention_grams.join(frequency, "gram")
        .groupBy("call_id", "mention")
        .agg(F.min(F.struct("names", "gram"))["gram"].alias("gram"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    return (
        _shuffled(name_grams).join(rarest, ["gram", "salt"])
        .filter(contains_ignore_case(F.col("organ_name"), F.col("mention")))
        .select("call_id", "mention", "symbol", "organ_name")
    )


def match_mentions(mentions: DataFrame, master: DataFrame) -> DataFrame:
    """Every `(call_id, mention, symbol, organ_name, exact)` that matches.

    A mention matches a symbol exactly (ignoring case) or as a part of the name.
    """
    names = master.select("symbol", F.coalesce("organ_name", F.lit("")).alias("organ_name"))
    exact = mentions.join(_shuffled(names), F.upper("mention") == F.upper("symbol")).select(
        "call_id", "mention", "symbol", "organ_name", F.lit(True).alias("exact")
    )
    return exact.unionByName(_name_matches(mentions, names).withColumn("exact", F.lit(False)))


def resolve_entities(
    mentions: DataFrame, master: DataFrame, profile: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """Companies per call; with `most` the first of them, exact ones first, then by symbol.

    What is among the best of a call is also among the best of one of its
    mentions, so with `most` each mention is cut first, before anything is shuffled.
    """
    order = [F.col("exact").desc(), F.col("symbol")]
    matches = match_mentions(mentions, master)
    if most is not None:
        # A symbol can match one mention twice, exactly and by name.
        matches = top_n(matches, ["call_id", "mention"], order, 2 * most)
    best = matches.groupBy("call_id", "symbol", "organ_name").agg(F.max("exact").alias("exact"))
    if most is not None:
        best = top_n(best, ["call_id"], order, most)
    if profile is None:
        return best
    extra = [c for c in profile.columns if c != "symbol"]
    return best.join(_shuffled(profile), "symbol", "left").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in extra})


def _matched_mentions(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct `(call_id, mention)` that match at all.

    A mention as short as a substring of the index matches if any name has that substring,
    which takes no pairs; only longer ones are compared with names.
    """
    symbols = _shuffled(names.select(F.upper("symbol").alias("__symbol")).distinct())
    exact = mentions.join(symbols, F.upper("mention") == F.col("__symbol"), "left_semi")
    is_short = F.length(F.lower("mention")) <= GRAM_CHARS
    grams = names.select(F.explode(_all_grams(F.lower("organ_name"))).alias("__gram")).distinct()
    short = mentions.filter(is_short).join(grams, F.lower("mention") == F.col("__gram"), "left_semi")
    long = _name_matches(mentions.filter(~is_short), names).select("call_id", "mention")
    return exact.select("call_id", "mention").unionByName(short.select("call_id", "mention")).unionByName(long).distinct()


def names_inside(texts: DataFrame, names: DataFrame, name_chars: int = NAME_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """`(text, name)` for every name of `names` (name) that stands anywhere in a text of `texts` (text), once each.

    Runs one job over either side to size the parts; a task holds one part of the names and one of the texts. Empty
    names and nulls are in no text.
    """
    texts, names = (df.filter(f"{c} <> ''").distinct() for df, c in ((texts, "text"), (names, "name")))
    parts, shares = (
        1 + int(df.agg(F.coalesce(F.sum(F.length(c) + 8), F.lit(0))).first()[0]) // most
        for df, c, most in ((names, "name", name_chars), (texts, "text", text_chars))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt_names = names.select("name", own("name", parts).alias("part"), every(shares).alias("share"))
    dealt_texts = texts.select("text", every(parts).alias("part"), own("text", shares).alias("share"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in left["name"].to_pylist():
            automaton.add_word(name, name)
        automaton.make_automaton()
        found = []
        if len(left):
            for text in right["text"].to_pylist():
                found += [(text, name) for name in {name for _, name in automaton.iter(text)}]
        return pa.table({"text": pa.array([t for t, _ in found], pa.string()), "name": pa.array([n for _, n in found], pa.string())})

    keys = ["part", "share"]
    return dealt_names.groupBy(*keys).cogroup(dealt_texts.groupBy(*keys)).applyInArrow(search, "text string, name string")


def unresolved_entities(mentions: DataFrame, master: DataFrame) -> DataFrame:
    """Mentions without a match of their own that also contain no matched name of their call.

    Names are first looked up inside the open mentions by automata, and only those
    found are held against the other mentions of the call. Runs jobs while it is called.
    """
    names = master.select("symbol", F.coalesce("organ_name", F.lit("")).alias("organ_name"))
    open_mentions = mentions.join(_matched_mentions(mentions, names), ["call_id", "mention"], "left_anti")
    known = names.select("symbol", F.lower("organ_name").alias("name"))
    keyed = open_mentions.withColumn("text", F.lower("mention"))
    found = names_inside(keyed.select("text"), known.select("name"))
    inside = keyed.join(found, "text").join(_shuffled(known), "name").select("call_id", "mention", "symbol", "name").distinct()
    others = mentions.select("call_id", F.col("mention").alias("other"))
    said = F.contains(F.col("name"), F.lower("other")) | (F.upper("symbol") == F.upper("other"))
    covered = inside.join(others, "call_id").filter(said).select("call_id", "mention").distinct()
    return open_mentions.join(covered, ["call_id", "mention"], "left_anti")

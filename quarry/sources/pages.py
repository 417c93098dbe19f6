"""Text and titles of HTML pages."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from html.entities import html5
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_web_url, strip

# Tags whose content is skipped, and tags that start a line.
SKIPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form")
LINE_TAGS = ("p", "br", "li", "h1", "h2", "h3", "h4")

# The HTML5 names by what they stand for.
ENTITIES = dict(sorted(html5.items()))
_OPEN_NAMES = sorted((n for n in ENTITIES if not n.endswith(";")), key=len, reverse=True)
# Numbers that stand for another character than their own, or for none.
_ODD_NUMBERS = {
    n: html.unescape(f"&#{n};")
    for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | n for p in range(17) for n in (0xFFFE, 0xFFFF)))
    if html.unescape(f"&#{n};") != chr(n)
}

_REFERENCE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_MARKUP = r"<[^>]*>|[^<]+|<"
_NO_MARKUP = r"[^<]+|<"
_TAG = r"^</?([a-zA-Z][a-zA-Z0-9]*)"

# Tags and texts that are folded together; a longer page is folded in segments.
SEGMENT = 256


class PageExtractor(Protocol):
    """Turns one HTML page into its title and its text; for parsers of other origin."""

    def extract(self, html: str) -> tuple[str, str]: ...


def _lookup(table: dict) -> Column:
    """A fixed map as one folded literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def _named(table: dict[str, str], name: Column) -> Column:
    """What a name stands for: a fixed map per first letter, so that few names are compared."""
    groups: dict[str, dict[str, str]] = {}
    for key, value in table.items():
        groups.setdefault(key[0], {})[key] = value
    by_letter = F.from_json(F.lit(json.dumps(groups)), "map<string, map<string, string>>")
    return F.element_at(F.element_at(by_letter, F.substring(name, 1, 1)), name)


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _spelled(ref: Column) -> Column:
    """One reference, `&` and all, by the rules of HTML5."""
    hexadecimal = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    value = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    code = F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000).otherwise(value)
    known = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")
    number = F.coalesce(F.element_at(_lookup(_ODD_NUMBERS), code.cast("string")), char)
    name = F.substring(ref, 2, 40)
    prefix = "^(" + "|".join(_OPEN_NAMES) + ")"
    start = F.regexp_extract(name, prefix, 1)
    opened = F.concat(F.element_at(_lookup({n: ENTITIES[n] for n in _OPEN_NAMES}), start), F.regexp_replace(name, prefix, ""))
    return F.when(F.startswith(ref, F.lit("&#")) & (F.length(ref) > 2), number).otherwise(
        F.coalesce(_named(ENTITIES, name), F.when(start != "", opened), ref)
    )


def unescape(text: Column) -> Column:
    """Character references spelled out as `html.unescape` does, each place once."""
    parts = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    spelled = F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("&")), _spelled(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), spelled).otherwise(text)


def _markup(html: Column) -> Column:
    """Tags and texts in order. Behind the last `>` nothing can be a tag, so nothing there is searched for its end."""
    seen = F.regexp_replace(html, _UNSEEN, "")

    def cut(page: Column) -> Column:
        tail = F.substring_index(page, ">", -1)
        head = F.substring(page, F.lit(1), F.length(page) - F.length(tail))
        return F.concat(F.regexp_extract_all(head, F.lit(_MARKUP), F.lit(0)), F.regexp_extract_all(tail, F.lit(_NO_MARKUP), F.lit(0)))

    return _bind(seen, cut)


def _tagged(token: Column) -> Column:
    return F.struct(F.lower(F.regexp_extract(token, _TAG, 1)).alias("tag"), F.startswith(token, F.lit("</")).alias("ends"), token.alias("raw"))


def _part(token: Column) -> Column:
    """What a tag does to the depth of skipped tags and to the title, or what a text says."""
    tag, ends, raw = token["tag"], token["ends"], token["raw"]
    said = (tag == "") & (raw != "<") & ~F.startswith(raw, F.lit("<!"))
    return F.struct(
        F.when(~tag.isin(*SKIPPED_TAGS), 0).when(ends, -1).otherwise(1).alias("change"),
        F.when(tag == "title", ~ends).alias("titled"),
        (tag.isin(*LINE_TAGS) & ~ends).alias("line"),
        F.when(said, raw).alias("said"),
    )


def _segments(parts: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(parts), F.lit(size))
    return F.when(F.size(parts) == 0, F.array().cast("array<int>")).otherwise(starts)


def visible_text(html: Column, segment: int = SEGMENT) -> Column:
    """Struct of title and text: a segmented scan over the tags and texts of a page.

    Comments, scripts and styles go first. What stands inside a skipped tag is left out,
    a line tag starts a line, and every other text is followed by a blank.

    The depth of skipped tags and whether a title is open run through the whole page. What a segment
    does to them is worked out first (depth d becomes max(d + add, least)), then
    where each segment starts, then each segment is folded on its own: no list that grows with the page is
    copied per tag, so time grows with the page.
    """
    no_effect = F.struct(F.lit(0).alias("add"), F.lit(0).alias("least"), F.lit(None).cast("boolean").alias("titled"))

    def compose(effect: Column, part: Column) -> Column:
        return F.struct(
            (effect["add"] + part["change"]).alias("add"),
            F.greatest(effect["least"] + part["change"], F.lit(0)).alias("least"),
            F.coalesce(part["titled"], effect["titled"]).alias("titled"),
        )

    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("titled"))
    no_starts = F.struct(first.alias("now"), F.array().cast("array<struct<depth: int, titled: boolean>>").alias("all"))

    def follow(state: Column, effect: Column) -> Column:
        now = state["now"]
        after = F.struct(
            F.greatest(now["depth"] + effect["add"], effect["least"]).alias("depth"), F.coalesce(effect["titled"], now["titled"]).alias("titled")
        )
        return F.struct(after.alias("now"), F.array_append(state["all"], now).alias("all"))

    def step(state: Column, part: Column) -> Column:
        said = part["said"].isNotNull() & (state["depth"] == 0)
        word = strip(part["said"])
        body = (
            F.when(said & ~state["titled"] & (word != ""), F.array_append(state["body"], F.concat(word, F.lit(" "))))
            .when(part["line"], F.array_append(state["body"], F.lit("\n")))
            .otherwise(state["body"])
        )
        return F.struct(
            F.greatest(state["depth"] + part["change"], F.lit(0)).alias("depth"),
            F.coalesce(part["titled"], state["titled"]).alias("titled"),
            F.when(said & state["titled"], F.concat(state["title"], part["said"])).otherwise(state["title"]).alias("title"),
            body.alias("body"),
        )

    def folded(pair: Column) -> Column:
        start = F.struct(
            pair["start"]["depth"].alias("depth"), pair["start"]["titled"].alias("titled"), F.lit("").alias("title"), F.array().cast("array<string>").alias("body")
        )
        return F.aggregate(pair["parts"], start, step, lambda s: F.struct(s["title"].alias("title"), F.array_join(s["body"], "").alias("body")))

    def in_segments(parts: Column) -> Column:
        pieces = F.transform(_segments(parts, segment), lambda at: F.slice(parts, at, F.lit(segment)))

        def scanned(pieces: Column) -> Column:
            # The last segment has none behind it.
            before = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
            effects = F.transform(before, lambda piece: F.aggregate(piece, no_effect, compose))
            starts = F.aggregate(effects, no_starts, follow, lambda s: F.array_append(s["all"], s["now"]))
            pairs = F.zip_with(pieces, starts, lambda p, s: F.struct(p.alias("parts"), s.alias("start")))
            return F.transform(pairs, folded)

        return _bind(pieces, scanned)

    def finish(pieces: Column) -> Column:
        title = F.array_join(F.transform(pieces, lambda p: p["title"]), "")
        text = F.regexp_replace(unescape(F.array_join(F.transform(pieces, lambda p: p["body"]), "")), r"[ \t]+", " ")
        text = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
        return F.struct(strip(unescape(title)).alias("title"), text.alias("text"))

    return _bind(_bind(F.transform(F.transform(_markup(html), _tagged), _part), in_segments), finish)


def _foreign(html: Column, extractor: PageExtractor) -> Column:
    """Struct of title, text and error from a given extractor."""

    @F.pandas_udf("struct<title: string, text: string, error: string>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(page: str | None) -> tuple[str, str, str | None]:
            try:
                return *extractor.extract(page or ""), None
            except Exception as problem:  # a broken page must not stop the job
                return "", "", f"html parse failed: {problem}"

        for batch in batches:
            yield pd.DataFrame(list(map(one, batch)), columns=["title", "text", "error"])

    return extract(html)


def pages_to_text(pages: DataFrame, extractor: PageExtractor | None = None, max_chars: int | None = None) -> DataFrame:
    """`url, title, text, truncated, error` next to the other columns of `pages`.

    Only http and https addresses are read. Texts are whole; with `max_chars` longer
    ones are cut and flagged. Without an `extractor` everything stays in the JVM.
    """
    web = F.coalesce(is_web_url(F.col("url")), F.lit(False))
    bad_url = F.when(strip(F.coalesce("url", F.lit(""))) == "", "empty url").when(
        ~web, "only http/https schemes are allowed"
    )
    html = F.when(web, F.col("html"))
    page = _foreign(html, extractor) if extractor else visible_text(html)
    error = F.col("page.error") if extractor else F.lit(None).cast("string")
    rest = [c for c in pages.columns if c not in ("url", "html")]
    parsed = pages.select(*rest, strip(F.col("url")).alias("url"), page.alias("page"))
    blank = F.lit("")
    text = F.coalesce("page.text", blank)
    return parsed.select(
        *rest,
        F.coalesce("url", blank).alias("url"),
        F.coalesce("page.title", blank).alias("title"),
        (F.substring(text, 1, max_chars) if max_chars else text).alias("text"),
        (F.length(text) > max_chars if max_chars else F.lit(False)).alias("truncated"),
        F.coalesce(bad_url, error).alias("error"),
    )

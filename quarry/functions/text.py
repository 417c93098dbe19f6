"""Text expressions: clean-up, tokens, names, paths, loose JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
ENTITY_PATTERN = r"(?U)^[\w \-\.&,/À-ỹ]+$"
PREFIX_PATTERN = r"^[A-Za-z0-9]+_?$"
TEST_TOKEN_PATTERN = r"(?s)^\s*\[\s*([A-Za-z]+-\d+)\s*\]\s*(.*)$"
# All characters that count as white space, also beyond ASCII.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SENTENCE_PATTERN = f"(?<=[.!?;])[{WHITE_SPACE}]+|\n{{2,}}"

# Words that carry no topic (Vietnamese, then English).
TOPIC_STOP_WORDS = (
    "công", "ty", "doanh", "nghiệp", "tôi", "bạn", "của", "cho", "với", "như",
    "thế", "nào", "gì", "sao", "khi", "trong", "một", "các", "những", "nhất",
    "hiện", "được", "đang", "hãy", "biết", "giúp", "mình", "đây", "này", "kia",
    "năm", "tháng", "quý", "ngày",
    "what", "how", "why", "when", "where", "which", "that", "this", "with",
    "from", "have", "been", "were", "will", "would", "could", "should",
    "please", "tell", "about", "some", "many", "much",
)


def strip(text: Column) -> Column:
    """Trim white space on both sides."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def unique_by(values: Column, key) -> Column:
    """First of the elements that share a key, in their order."""
    nothing = F.filter(values, lambda _: F.lit(False))
    start = F.struct(F.transform(nothing, key).alias("keys"), nothing.alias("kept"))

    def add(seen, value):
        known = F.array_contains(seen["keys"], key(value))
        longer = F.struct(
            F.array_append(seen["keys"], key(value)).alias("keys"), F.array_append(seen["kept"], value).alias("kept")
        )
        return F.when(known, seen).otherwise(longer)

    return F.aggregate(values, start, add, lambda seen: seen["kept"])


def first_of(values: Column, most: int | None) -> Column:
    """The first `most` elements, or all of them."""
    return values if most is None else F.slice(values, 1, most)


def cut(text: Column, chars: int | None) -> Column:
    """The first `chars` characters, or the whole text."""
    return text if chars is None else F.substring(text, 1, chars)


def clean_entities(mentions: Column, chars: int | None = None, most: int | None = None) -> Column:
    """Trimmed, of allowed characters, distinct by lower case; with `chars` no longer ones, with `most` the first."""
    trimmed = F.transform(mentions, strip)
    usable = F.filter(trimmed, lambda m: (F.length(m) > 0) & m.rlike(ENTITY_PATTERN))
    if chars is not None:
        usable = F.filter(usable, lambda m: F.length(m) <= chars)
    return first_of(unique_by(usable, F.lower), most)


def normalize_prefixes(prefixes: Column) -> Column:
    """Upper case, alphanumeric, ending in one underscore, distinct."""
    upper = F.transform(prefixes, lambda p: F.upper(strip(p)))
    usable = F.filter(upper, lambda p: p.rlike(PREFIX_PATTERN))
    return F.array_distinct(
        F.transform(usable, lambda p: F.when(F.endswith(p, F.lit("_")), p).otherwise(F.concat(p, F.lit("_"))))
    )


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(strip(text), SENTENCE_PATTERN), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def words(text: Column) -> Column:
    """Distinct blank-separated words, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0))


def topic_tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, longer than 3, that may carry a topic."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-zA-ZÀ-ỹ]+)"), F.lit(1)))
    long = F.filter(found, lambda w: F.length(w) > 3)
    return F.array_except(long, F.array(*[F.lit(w) for w in TOPIC_STOP_WORDS]))


def test_id(text: Column) -> Column:
    """`[B-001] question` -> `B-001`; null without a token."""
    found = F.regexp_extract(text, TEST_TOKEN_PATTERN, 1)
    return F.when(F.length(found) > 0, F.upper(found))


def test_text(text: Column) -> Column:
    """The text behind the token, or the whole text without one."""
    return F.when(
        text.rlike(TEST_TOKEN_PATTERN), strip(F.regexp_extract(text, TEST_TOKEN_PATTERN, 2))
    ).otherwise(F.coalesce(text, F.lit("")))


def category_prefix(category: Column) -> Column:
    """`B. Single fact` -> `B.`; empty for a missing category."""
    head = F.substring_index(strip(F.coalesce(category, F.lit(""))), " ", 1)
    return F.when((head == "") | F.endswith(head, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))


def bucket(category: Column) -> Column:
    """First letter of the category, `?` when there is none."""
    first = F.upper(F.substring(strip(F.coalesce(category, F.lit(""))), 1, 1))
    return F.when(first == "", F.lit("?")).otherwise(first)


def contains_ignore_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def url_host(url: Column) -> Column:
    """Text between `://` and the next slash; empty without a scheme."""
    behind = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1)
    return F.when(F.contains(url, F.lit("://")), behind).otherwise(F.lit(""))


def is_web_url(url: Column) -> Column:
    return strip(url).rlike("^https?://")


def chunk_hash(text: Column) -> Column:
    """What tells equal chunks."""
    return F.md5(text)


def file_hash(content: Column) -> Column:
    """What tells equal files."""
    return F.sha2(content, 256)


def json_field(raw: Column, field: str) -> Column:
    """A top-level field of stored JSON as text; null where there is none."""
    return F.get_json_object(raw, f"$.{field}")


def object_path(project: Column, user: Column, session: Column, file_hash: Column, file_name: Column) -> Column:
    """Storage path by project sign: private session, shared base, or personal project."""
    safe = F.regexp_replace(file_name, r"[/\\]", "_")
    leaf = F.concat(file_hash, F.lit("_"), safe)
    owner = F.concat(F.lit("user_"), user.cast("string"))
    return (
        F.when(project < 0, F.concat_ws("/", F.lit("incognito"), F.coalesce(session, F.lit("no_session")), leaf))
        .when(project == 0, F.concat_ws("/", F.lit("base"), owner, leaf))
        .otherwise(F.concat_ws("/", owner, F.concat(F.lit("project_"), project.cast("string")), leaf))
    )


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def loose_json(raw: Column) -> Column:
    """The JSON value inside a model reply, as JSON text, or null.

    Tried in turn: the whole reply, the fenced blocks that start with a brace,
    and the text from the first to the last brace.
    """
    text = strip(raw)
    fenced = F.filter(
        F.transform(F.split(text, "```(?:json|JSON)?"), strip),
        lambda part: F.startswith(part, F.lit("{")) & F.try_parse_json(part).isNotNull(),
    )
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    candidates = (text, F.get(fenced, 0), F.when(braces != "", braces))
    return F.coalesce(*[F.to_json(F.try_parse_json(c)) for c in candidates])


def coerce_list(values: Column, cap: int | None = None) -> Column:
    """Trimmed, non-empty entries of a string array; the first `cap` if given."""
    trimmed = F.transform(values, strip)
    return first_of(F.filter(trimmed, lambda v: F.length(v) > 0), cap)


def coerce_comma_list(text: Column, cap: int | None = None) -> Column:
    return coerce_list(F.split(text, ","), cap)

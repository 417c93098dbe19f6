"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, langid, link_graph, lm, preference, quality_model, repair, rules, simhash, token_counts, warc, whitening
from quarry.llm.common import in_fold, prepare
from quarry.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register `plan(table, ...)` under `name`."""

    def register(plan: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return plan(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan

    return register


OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, payload_bytes, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CAST(CASE WHEN page_id < winner THEN winner END AS DOUBLE) AS refers_to
FROM p LEFT JOIN w USING (payload_digest, payload_bytes)
"""


@query("op1_warc", "pages", sql=OP1)
def op1(pages: DataFrame) -> DataFrame:
    index = warc.write_archives(warc.page_records(pages))
    read = warc.read_records(index, with_payload=False)
    ids = [F.col(c).cast("long") for c in ("record_id", "refers_to")]
    return read.select(ids[0].alias("page_id"), "payload_bytes", "payload_digest", "record_type", ids[1].alias("refers_to"))


@query("op3_quality_model", "documents", "labels")
def op3(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 4, 2)
    docs = documents.select("doc_id", "text")
    vectors = quality_model.word_vectors(docs)
    model = quality_model.train(docs.filter(~held_out), labels.filter(~held_out).select("doc_id", "quality"), vectors)
    return quality_model.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


URL_RULES = (
    link_graph.UrlRule("block", "net"), link_graph.UrlRule("allow", "example.net", "/en/"),
    link_graph.UrlRule("block", "example.com", "/de/"), link_graph.UrlRule("allow", "org", "/fr/"),
)


# Rounds of the propagation in SQL, more than the given pages need: they link to no other host.
SQL_ROUNDS = 24


def op4_sql() -> str:
    """The rules, then the rounds of the propagation one after the other."""

    def parts(url: str) -> str:
        rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{link_graph.UPPER}', '{link_graph.LOWER}')"
        return f"coalesce({host}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"

    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules))
    action = " ".join(f"WHEN {f} THEN '{r.action}'" for f, r in zip(fits, rules))
    link, d = link_graph.LINK.replace("'", "''"), link_graph.DAMPING
    rounds = "".join(
        f"""
r{k + 1} AS (
  SELECT host, kind, sum(value) AS value FROM (
    SELECT t AS host, kind, {d} * value * share AS value FROM r{k} JOIN steps ON kind = k AND host = f UNION ALL SELECT * FROM r0)
  GROUP BY ALL),"""
        for k in range(SQL_ROUNDS)
    )
    return f"""
WITH parts AS (SELECT page_id, html, {parts("url")} FROM pages),
judged AS (SELECT *, CASE {rule} END AS rule, CASE {action} END AS action FROM parts),
links AS (SELECT host AS source, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS link FROM parts),
targets AS (SELECT source, {parts("CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END")} FROM links),
edges AS (SELECT source, host AS target, count(*) AS n FROM targets WHERE source <> '' AND host <> '' AND source <> host GROUP BY ALL),
steps AS (
  SELECT 'trust' AS k, source AS f, target AS t, n / sum(n) OVER (PARTITION BY source) AS share FROM edges
  UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) FROM edges),
r0 AS (
  SELECT host, kind, (1 - {d}) * avg(CASE WHEN action = a THEN 1.0 ELSE 0.0 END) AS value
  FROM judged, (VALUES ('trust', 'allow'), ('distrust', 'block')) v(kind, a) WHERE host <> '' GROUP BY ALL),{rounds}
bad AS (
  SELECT host FROM r{SQL_ROUNDS} GROUP BY host
  HAVING round(coalesce(sum(value) FILTER (kind = 'distrust'), 0), 9) - round(coalesce(sum(value) FILTER (kind = 'trust'), 0), 9) >= {link_graph.THRESHOLD})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


@query("op4_url_filter", "pages", sql=op4_sql())
def op4(pages: DataFrame) -> DataFrame:
    return link_graph.judge_urls(pages, URL_RULES)


@query("op7_lm_score", "documents")
def op7(documents: DataFrame) -> DataFrame:
    return lm.score_texts(documents.select("doc_id", "text", in_fold(F.col("doc_id"), 10, 0).alias("held_out")))


OP8 = """
WITH turns AS (SELECT conv_id AS pair_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT DISTINCT pair_id, last FROM turns),
raw AS (
  SELECT 'chosen' AS side, pair_id, turn, role, text FROM turns
  UNION ALL SELECT 'rejected', pair_id, turn, role, text FROM turns WHERE turn < last
  UNION ALL SELECT 'rejected', l.pair_id, l.last, t.role, t.text
  FROM turns t JOIN lasts l ON l.pair_id = t.pair_id + CASE WHEN t.pair_id % 2 = 0 THEN 1 ELSE -1 END WHERE t.turn = t.last),
sides AS (SELECT *, row_number() OVER (PARTITION BY side, pair_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS copy FROM raw),
matched AS (
  SELECT pair_id, turn, copy, l.role IS NOT DISTINCT FROM r.role AND l.text IS NOT DISTINCT FROM r.text AND l.side IS NOT NULL AND r.side IS NOT NULL AS same
  FROM (FROM sides WHERE side = 'chosen') l FULL JOIN (FROM sides WHERE side = 'rejected') r USING (pair_id, turn, copy)),
firsts AS (SELECT pair_id, min(turn * 1000000 + copy) AS first FROM matched WHERE NOT same GROUP BY pair_id),
parts AS (
  SELECT CASE WHEN first IS NULL OR turn * 1000000 + copy < first THEN 'prompt' ELSE side END AS part, sides.*
  FROM sides LEFT JOIN firsts USING (pair_id))
SELECT pair_id, part, turn, copy, role, '<|im_start|>' || coalesce(role, '') || chr(10) AS header,
  coalesce(text, '') || '<|im_end|>' || chr(10) AS body, part <> 'prompt' AND coalesce(role, '') = 'assistant' AS train
FROM parts WHERE NOT (part = 'prompt' AND side = 'rejected')
"""


@query("op8_preference", "conversations", sql=OP8)
def op8(conversations: DataFrame) -> DataFrame:
    return preference.segments(*preference.swapped_endings(conversations))


@query("op2_simhash", "documents")
def op2(documents: DataFrame) -> DataFrame:
    return simhash.near_duplicates(documents.select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), UPPER, LOWER), PATTERN) AS words FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), UPPER, LOWER), PATTERN) AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[k:k + 9], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS k FROM i WHERE len(words) > 0)),
grams AS (
  SELECT r, k, n, array_to_string(words[k:k + n - 1], ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows))),
matches AS (SELECT r, item_id, k, n FROM grams JOIN windows USING (n, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM matches) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM matches) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
OP5 = OP5.replace("UPPER", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'").replace("LOWER", "'abcdefghijklmnopqrstuvwxyz'")
OP5 = OP5.replace("PATTERN", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")


@query("op5_decontaminate", "documents", "benchmark", sql=OP5)
def op5(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate.contamination(documents.select("doc_id", "text"), benchmark).drop("text_hash")


@query("op6_byte_bpe", "documents")
def op6(documents: DataFrame) -> DataFrame:
    return bpe.digest(documents.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
facts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM w JOIN lines USING (r) LEFT JOIN repeats USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM base
"""


@query("op9_quality_rules", "documents", sql=OP9)
def op9(documents: DataFrame) -> DataFrame:
    return rules.quality_facts(documents.select("doc_id", "text"))


@query("op10_language_id", "documents")
def op10(documents: DataFrame) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = langid.train(documents.filter(~held_out).select("doc_id", "text", "lang"))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# Cached token counts live here; unset, every run starts with an empty cache of its own.
TOKEN_CACHE = "spark.quarry.tokenCache"


@query("op11_token_counts", "documents")
def op11(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    cache = spark.conf.get(TOKEN_CACHE, None) or scratch_path(spark, "token-cache")
    tokenizer = token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(documents.select("doc_id", "text"), tokenizer, cache, limit=1024)


@query("op12_whitening", "embeddings")
def op12(embeddings: DataFrame) -> DataFrame:
    return whitening.whiten(embeddings.select("vec_id", "embedding"))


def op13_sql() -> str:
    """The cheapest edits row by row: per place of the pattern the least (cost, audit, repaired text) so far.

    The checksum is worked out bit by bit, as SQL has none.
    """
    inserts = {(p, q): (c, a) for (p, q), (c, a) in repair.NOTHING.items() if p != q}
    words = {"I": {0: ["user:"], 1: ["user:"], 2: ["assistant:"], 3: ["user:"]}}

    def cell(source: str, cost: str, audit: str, line: str | None) -> str:
        text = f"{source}.o" if line is None else f"CASE WHEN {source}.o IS NULL THEN {line} ELSE {source}.o || chr(10) || {line} END"
        return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{audit}', 'o': {text}}}"

    def least(cells: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(cells)}], lambda x: x.c IS NOT NULL))[1]"

    def closed(names: dict[int, str]) -> dict[int, str]:
        """Places after any insertions, from places before them."""
        out = {}
        for q in repair.PLACES:
            cells = [names[q]]
            for (p, to), (cost, audit) in inserts.items():
                if to == q:
                    lines, at = [], p
                    for _ in audit:
                        lines += words["I"][at]
                        at = 3 if at == 2 else 2
                    cells.append(cell(names[p], str(cost), audit, "'" + "' || chr(10) || '".join(lines) + "'"))
            out[q] = least(cells)
        return out

    start = {0: "{'c': 0, 'a': '', 'o': CAST(NULL AS VARCHAR)}"}
    start |= {q: "{'c': CAST(NULL AS INTEGER), 'a': '', 'o': CAST(NULL AS VARCHAR)}" for q in (1, 2, 3)}
    before = {q: f"s{q}" for q in repair.PLACES}
    after = {}
    for q in repair.PLACES:
        cells = [cell(before[q], str(repair.DELETE), "D", None)]
        for (initial, p), to in repair.STEPS.items():
            if to == q:
                keep = f"CASE WHEN initial = '{initial}' AND NOT must THEN {repair.KEEP} + late END"
                cells.append(cell(before[p], keep, "K", "line"))
                if initial in repair.ROLES:
                    role = f"CASE WHEN NOT must THEN {repair.REROLE} + late END"
                    cells.append(cell(before[p], role, "R", f"'{repair.ROLES[initial]}:' || text"))
        after[q] = least(cells)
    pick = lambda cells: ", ".join(f"{e} AS s{q}" for q, e in cells.items())
    white = r"[\x20\x09-\x0D]"
    zeros = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (
  SELECT DISTINCT name, list_transform(range(0, 8 * length(name)), lambda i: (ascii(substr(name, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1) AS bits FROM named),
kinds AS (
  SELECT name, xor(list_reduce(list_concat([4294967295], bits), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS kind FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM named JOIN kinds USING (name) WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    regexp_extract(text, '([^ 	-
]){white}*$', 1) AS said, substr(role, 1, 1) AS initial FROM damaged),
facts AS (
  SELECT *, said = '' AS blank, said <> '' AND again > 1 AS duplicate, said NOT IN ('', '.', '!', '?') AND again = 1 AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS previous FROM numbered),
rows AS (
  SELECT conv_id, pos, initial, text, role || ':' || text AS line, blank OR duplicate AS must,
    CASE WHEN truncated THEN {repair.TRUNCATED} ELSE 0 END AS late FROM facts),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM facts GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {pick({q: closed(start)[q] for q in repair.PLACES})} FROM counts
  UNION ALL
  SELECT conv_id, pos, {pick(closed(before))} FROM (
    SELECT conv_id, r.pos, {pick(after)} FROM steps JOIN rows r USING (conv_id) WHERE r.pos = steps.pos + 1)),
ends AS (
  SELECT conv_id, {least(["s0", "s3"])} AS e FROM steps JOIN counts USING (conv_id) WHERE pos = n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, {zeros}, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.o, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


@query("op13_structure_repair", "conversations", sql=op13_sql())
def op13(conversations: DataFrame) -> DataFrame:
    return repair.repair(conversations, repair.damaged(conversations))

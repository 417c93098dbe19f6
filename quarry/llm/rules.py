"""Quality rules as a short-circuit cascade.

Each rule looks at facts of a whole text and says whether the text fails. A text
is kept if no rule fails, so the order of the rules cannot change a verdict, only
its price. `plan_order` measures on a sample how long each rule takes and how many
texts it rejects, and sorts by rejections per second; `judge` then stops at the
first rule that fails.

Defined results: a null text has no words and is treated like an empty one; both
fail `too_short`. Repeated rows get the same verdict each. Very long texts are counted whole. An empty table has
no rows. Extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LONG_BYTES, free_name, words_in

_LINE = re.compile(rb"[^\n]+")

SYMBOLS = b"#*$%&|<>"
# White space, and the bytes that continue a character in UTF-8.
NOT_COUNTED = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha()) + bytes(range(0x80, 0xC0))


class Facts:
    """Counts over one whole text, each computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @property
    def long(self) -> bool:
        """Too long to hold all words at once; counted by numbers instead."""
        return len(self.raw) > LONG_BYTES

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes are split at the six ASCII white-space characters

    @cached_property
    def numbers(self) -> np.ndarray:
        """The words as numbers, equal ones alike."""
        names: defaultdict[bytes, int] = defaultdict(lambda: len(names))
        return np.fromiter(map(names.__getitem__, words_in(self.raw)), np.int64)

    @property
    def n_words(self) -> int:
        return len(self.numbers if self.long else self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and different ones among them."""
        if not self.long:
            lines = [line for line in self.raw.split(b"\n") if line.strip()]
            return len(lines), len(set(lines))
        seen, n = set(), 0
        for match in _LINE.finditer(self.raw):
            if match.group().strip():
                n += 1
                seen.add(hashlib.blake2b(match.group(), digest_size=16).digest())
        return n, len(seen)

    @property
    def n_lines(self) -> int:
        return self.lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self.lines[0] - self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any 3-word window that occurs at least twice."""
        if self.long:
            return repeated_in(self.numbers)
        grams = list(zip(self.words, self.words[1:], self.words[2:]))
        seen = Counter(grams) if len(set(grams)) < len(grams) else {}
        total, covered = 0, 0
        for at, gram in enumerate(grams if seen else ()):
            if seen[gram] > 1:
                total += at + 3 - max(at, covered)
                covered = at + 3
        return total

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw.translate(None, NOT_UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw.translate(None, NOT_LETTER))


def repeated_in(numbers: np.ndarray) -> int:
    """`n_repeat_words` of words given as numbers."""
    if len(numbers) < 3:
        return 0
    size = int(numbers.max()) + 1
    pairs = np.unique(numbers[:-1] * size + numbers[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * size + numbers[2:], return_inverse=True, return_counts=True)
    again, covered = counts[at] > 1, np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """`fails` says whether a text with these facts goes."""

    name: str
    fails: Callable[[Facts], bool]


def too_short(f: Facts) -> bool:
    return f.n_words < 50


def repetitive(f: Facts) -> bool:
    return 100 * f.n_repeat_words > 50 * f.n_words


def symbol_heavy(f: Facts) -> bool:
    return 10 * f.n_symbols > 3 * f.n_words


def duplicate_lines(f: Facts) -> bool:
    return 2 * f.n_dup_lines > f.n_lines


def shouting(f: Facts) -> bool:
    return 2 * f.n_upper > f.n_letters


def word_length(f: Facts) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 20 * f.n_words


BASE = (Rule("too_short", too_short), Rule("repetitive", repetitive))
RULES = (
    *BASE,
    Rule("symbol_heavy", symbol_heavy),
    Rule("duplicate_lines", duplicate_lines),
    Rule("shouting", shouting),
    Rule("word_length", word_length),
)
SAMPLE_ROWS = 400
MEASURES = "rule string, seconds double, texts long, rejected long"


def measure(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """Seconds and rejections of every rule alone over the texts of one task."""
    seconds, rejected, texts = [0.0] * len(rules), [0] * len(rules), 0
    for batch in batches:
        for raw in batch.column(0).cast(pa.binary()).to_pylist():
            texts += 1
            for k, rule in enumerate(rules):
                facts, began = Facts(raw), time.perf_counter()
                rejected[k] += rule.fails(facts)
                seconds[k] += time.perf_counter() - began
    yield pa.RecordBatch.from_pydict(
        {"rule": [r.name for r in rules], "seconds": seconds, "texts": [texts] * len(rules), "rejected": rejected}
    )


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second on `sample_rows` texts, best first.

    The sample only sets the order, never a verdict. It is drawn by a hash of the id at a rate that leaves
    a few times `sample_rows` of the whole table, so that what is gathered does not grow with the tasks. Rules that reject nothing
    come last, cheapest first; without any row the given order stays.
    """
    rate = 4 * sample_rows / max(1, docs.count())
    drawn = docs if rate >= 1 else docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    sample = drawn.select(F.col("text").cast("string")).limit(sample_rows)
    found = sample.mapInArrow(lambda batches: measure(batches, rules), MEASURES)
    sums = found.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    by = {r["rule"]: (-r["rejected"] / max(r["seconds"], 1e-9), r["seconds"]) for r in sums.collect()}
    return tuple(sorted(rules, key=lambda r: by.get(r.name, (0.0, 0.0))))


def passes(facts: Facts, rules: tuple[Rule, ...]) -> bool:
    """False at the first rule that fails; later rules are not looked at."""
    return not any(rule.fails(facts) for rule in rules)


def kept_column(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Does the text pass all rules, tried in the given order?"""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array([passes(Facts(raw), rules) for raw in texts.cast(pa.binary()).to_pylist()], pa.bool_())

    return kept(text.cast("string"))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of `docs` whose text passes all rules; columns unchanged."""
    order, kept = plan_order(docs, rules), free_name(docs, "kept")
    return docs.withColumn(kept, kept_column(F.col("text"), order)).filter(F.col(kept)).drop(kept)


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_facts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, `base_failed` and the verdict of the cascade, a row per document."""
    order = plan_order(docs, rules)
    type_ = pa.struct(
        [pa.field(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in (f.split() for f in FACTS.split(", "))]
    )

    @F.arrow_udf(f"struct<{FACTS.replace(' ', ':').replace(',:', ', ')}>")
    def facts_of(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.cast(pa.binary()).to_pylist():
            f = Facts(raw)
            rows.append(
                {
                    "n_words": f.n_words, "word_chars": f.word_chars, "n_symbols": f.n_symbols,
                    "n_dup_lines": f.n_dup_lines, "n_repeat_words": f.n_repeat_words,
                    "base_failed": not passes(f, BASE), "kept": passes(f, order),
                }
            )
        return pa.array(rows, type_)

    facts = docs.select("doc_id", facts_of(F.col("text").cast("string")).alias("facts"))
    return facts.select("doc_id", "facts.*")

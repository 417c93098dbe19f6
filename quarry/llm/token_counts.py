"""Token counts with a digest cache.

A text's count depends on its content and on the tokenizer alone. The cache is a Parquet folder with a
subfolder per tokenizer version (digest of the library, its version and the vocabulary file) and a row
(content, n_bytes, n_tokens) per digest of normalised content. Counting a table

1. digests every text in one scan; from there on rows are (id, digest, bytes) and no text;
2. joins the distinct digests to the stored counts; what finds none is a miss, represented by the least
   id that has it;
3. reads the texts of the misses, encodes each once and appends the counts to the cache;
4. joins the digests of all rows to the counts.

The joins are on digests, so a text that a third of all rows hold is one row in steps 2 and 3, and in
step 4 its rows may be split while the other side has one row for it. Texts are only moved when there
are more misses than may be broadcast (`small`, counted); then the texts are shuffled once, by
digest and id. Cached counts are facts on their own: an append that is
done twice or breaks off leaves rows that are right, and readers take one row per digest.

Normalisation must be one that the tokenizer does not see: `as_it_is` (null becomes empty), or
`folded_ascii` for tokenizers that lower-case and join white space.

Defined results: a null or empty text has no bytes and no tokens. Repeated rows and rows without an id are
counted each. Very long texts are encoded in parts where the tokenizer's cuts allow it, else whole; counts
are those of the whole text. An empty table gives no rows and adds nothing to the cache. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small, stored

CACHE = "content BINARY, n_bytes BIGINT, n_tokens BIGINT, tokenizer STRING"
FOUND = "content binary, n_bytes long, n_tokens long"
# Characters of a text looked at once.
PART_CHARS = 1 << 20
# Words each task remembers, in each of two generations; longer ones are not remembered.
REMEMBERED = 250_000
LONG_WORD = 64
# Digests each task remembers, for copies that share an id with their representative.
SEEN = 100_000

# A blank between two characters that are none: byte-level cuts always fall in front of it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file's content and the library that reads it: `tokenizers` or `sentencepiece`."""

    library: str
    data: bytes

    @property
    def version(self) -> str:
        """Digest of all that a count depends on besides the content."""
        release = __import__(self.library).__version__
        return hashlib.sha256(f"{self.library}\n{release}\n".encode() + self.data).hexdigest()

    @property
    def cut_at_blanks(self) -> bool:
        """May a text be encoded in parts that begin at a single blank?"""
        if self.library != "tokenizers":
            return False
        rules = json.loads(self.data)
        before = rules["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        marks = [t["content"] for t in rules["added_tokens"] if t["lstrip"] or t["rstrip"] or " " in t["content"]]
        return bool(plain and rules["normalizer"] is None and not marks)

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Counts of texts, as the library gives them."""
        if self.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        model = tokenizers.Tokenizer.from_str(self.data.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def load_tokenizer(path: str) -> Tokenizer:
    """From a `.json` file of the library tokenizers or a `.model` file of sentencepiece, read on the driver."""
    with open(path, "rb") as file:
        return Tokenizer("sentencepiece" if path.endswith(".model") else "tokenizers", file.read())


def as_it_is(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def folded_ascii(text: Column) -> Column:
    """A-Z in lower case and runs of ASCII white space as one blank; other characters are left to the tokenizer."""
    lower = F.translate(as_it_is(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")


def words_of(text: str) -> list[str]:
    """Parts of a text that are tokenised apart: cut in front of each single blank, which goes with what follows."""
    odd = {c for c in set(text) if c.isspace()} - {" ", "\n"}
    if odd or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        first, *rest = _CUT.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *(" " + w for w in rest)]


class WordCounts:
    """Counts of texts by their words; each word is encoded once while it is remembered."""

    def __init__(self, count: Callable[[list[str]], list[int]], most: int = REMEMBERED):
        self.count, self.most = count, most
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def __call__(self, words: list[str]) -> int:
        """Sum over the words. Of two generations the older is forgotten when the younger is full."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, new, total = self.young, [], 0
        for word in (w for w in set(words) if w not in young):
            if word in self.old:
                young[word] = self.old[word]
            else:
                new.append(word)
        young.update(zip(new, self.count(new)))
        total = sum(map(young.__getitem__, words))
        for word in new:
            if len(word) > LONG_WORD:
                del young[word]
        return total


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """A text that may be cut at blanks, in parts of about `size` characters."""
    at = 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def text_counter(tokenizer: Tokenizer) -> Callable[[str], int]:
    """Count of a text: by words where the tokenizer's cuts allow it, else at once."""
    count = tokenizer.counter()
    if not tokenizer.cut_at_blanks:
        return lambda text: count([text])[0]
    by_words = WordCounts(count)
    return lambda text: sum(by_words(words_of(part)) for part in parts_of(text))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(content, n_bytes, n_tokens), one row per digest; no cache yet means no rows."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == version).drop("tokenizer").dropDuplicates(["content"])


def encode_misses(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Counts of (content, n_bytes, text), each digest of a task once."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = text_counter(shared.value), set()
        for batch in batches:
            digests, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = {d: i for i, d in enumerate(digests) if d not in seen}
            rows = sorted(new.values())
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            counts = [count(batch.column(2)[i].as_py()) for i in rows]
            values = [pa.array([digests[i] for i in rows], pa.binary()), pa.array([sizes[i] for i in rows], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(values, names=["content", "n_bytes", "n_tokens"])

    return texts.mapInArrow(run, FOUND).groupBy("content").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: Tokenizer, cache: str, limit: int | None = None, normalise: Callable[[Column], Column] = as_it_is
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, given a `limit`, over_limit per row of `docs` (doc_id, text).

    Fills the cache while it is called; the returned frame reads the cache. `n_bytes` is the UTF-8 length of the text itself.
    """
    spark, version = docs.sparkSession, tokenizer.version
    content = normalise(F.col("text"))
    digest = F.unhex(F.sha2(content, 256)).alias("content")
    n_bytes = F.octet_length(as_it_is(F.col("text"))).cast("long").alias("n_bytes")
    keys = stored(docs.select("doc_id", digest, n_bytes), "token-keys")
    missing = keys.groupBy("content").agg(F.min("doc_id").alias("first")).join(read_cache(spark, cache, version), "content", "left_anti")
    missing = small(stored(missing, "token-misses").select(F.col("content").alias("miss"), "first"))
    texts = docs.select("doc_id", digest, n_bytes, content.alias("text"))
    texts = texts.join(missing, (F.col("content") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    found = encode_misses(texts.select("content", "n_bytes", "text"), tokenizer)
    found.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").option("compression", "zstd").parquet(cache)
    # Written, so that the rows of a digest that very many share can be split in the join.
    counts = stored(keys.select("content").distinct().join(read_cache(spark, cache, version), "content").select("content", "n_tokens"), "token-counts")
    counted = keys.join(counts, "content")
    over = [(F.col("n_tokens") > limit).alias("over_limit")] if limit is not None else []
    return counted.select("doc_id", "n_bytes", "n_tokens", *over)

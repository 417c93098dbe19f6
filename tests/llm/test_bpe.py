import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(open(PATH, "rb").read(), P.PATTERN)
ODD = ["", "a" * 3000, "ab" * 700, "é" * 200, " " * 500, "\x00\x1c\x85  x", "<|endoftext|>", "the " * 60000, "x" * 64, "x" * 65, "漢字🙂" * 40]


def ids_of(text):
    return [int(i) for part in ENCODER.encode(text) for i in part]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_library(text):
    assert ids_of(text) == KNOWN.encode_ordinary(text)
    assert ENCODER.decode(np.array(ids_of(text), np.int64)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=120))
def test_any_text(text):
    assert ids_of(text) == KNOWN.encode_ordinary(text)


def test_single_trees_and_batches_agree():
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"theinganoru ") for _ in range(rng.randint(2, 60))) for _ in range(500)]
    batch = bpe.encode_batch(pieces, ENCODER.vocabulary, 64)
    for piece, ids in zip(pieces, batch):
        assert bpe.encode_long(piece, ENCODER.vocabulary) == np.frombuffer(ids, "<u4").tolist()


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    small = bpe.Encoder(open(PATH, "rb").read(), P.PATTERN)
    texts = [f"word{k} other{k * 7} the same" for k in range(200)]
    got = [[int(i) for part in portions for i in part] for portions in small.encode_all(texts)]
    assert got == [KNOWN.encode_ordinary(t) for t in texts]


def test_documents(spark, frame):
    rows = [(k, t) for k, t in enumerate([None, *ODD])] + [(1, "again"), (1, "again"), (None, "no id")]
    found = bpe.digest(frame(rows), PATH, P.PATTERN).collect()

    def plain(doc_id, text):
        ids = np.array(KNOWN.encode_ordinary(text or ""), "<u4")
        return str((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))

    assert sorted(str(tuple(r)) for r in found) == sorted(plain(*r) for r in rows)
    assert bpe.digest(frame([]), PATH, P.PATTERN).count() == 0


def test_columns_round_trip(spark):
    df = spark.createDataFrame([("a héllo world",), ("",), (None,)], "text string")
    ids = df.withColumn("ids", bpe.encode_column(spark, F.col("text"), PATH, P.PATTERN))
    back = ids.select("text", "ids", bpe.decode_column(spark, F.col("ids"), PATH).alias("raw")).collect()
    assert [(bytes(r["raw"]).decode(), list(r["ids"])) for r in back] == [(t or "", KNOWN.encode_ordinary(t or "")) for t in ("a héllo world", "", None)]

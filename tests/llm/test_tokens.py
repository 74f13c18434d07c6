"""Counts of the library, text by text."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_odd_texts(library):
    rng, count = random.Random(1), tokens.PairMerger(PATH).count
    parts = [*" \t\n\r\x0b\x0c\x1c\x85\xa0　abzAé日1'sdmt.,!-́٣\U0001f600", "<|endoftext|>", "<|endof", "  ", "'ll", "\n\n ", " a", "don't", "the"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert count(text) == library(text), repr(text)


def test_tables(spark, docs, none, library, monkeypatch):
    for r in docs.select("text", tokens.token_count(F.col("text"), PATH).alias("n")).collect():
        assert r["n"] == library(r["text"] or "")
    assert none.select(tokens.token_count(F.col("text"), PATH)).count() == 0
    monkeypatch.setattr(tokens, "REMEMBERED", 3)  # forgetting changes nothing
    count = tokens.PairMerger(PATH).count
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect():
        assert count(r["text"]) == library(r["text"])


def test_long_chunks_are_not_remembered(library):
    merger = tokens.PairMerger(PATH)
    text = " ".join(f"{i}" * 90 for i in range(200)) + " short"
    assert merger.count(text) == library(text)
    assert all(len(key) <= tokens.LONGEST for memory in (merger.chunks, merger.pieces) for key in memory) and "short" in merger.chunks


def test_long_piece(library):
    text = "x" * 30_000 + " " + "ab" * 10_000
    assert tokens.PairMerger(PATH).count(text) == library(text)

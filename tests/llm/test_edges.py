"""Ids at both ends of long, clashing columns and very long texts, for operators that their own tests leave out."""

from __future__ import annotations

import ctypes
import os
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import chat_format, decontaminate, language, license_scan, packing, simhash

LOW, HIGH = -(1 << 63), (1 << 63) - 1
IDS = [LOW, -1, 0, HIGH, None]


@pytest.fixture(scope="module")
def ends(spark):
    text = "one two three four five six seven eight nine ten eleven under the MIT license"
    return spark.createDataFrame([(i, f"{text} {k}", "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string").repartition(3)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i or 0))


def test_ids_at_both_ends_of_long_come_back(spark, ends):
    want = sorted(IDS, key=lambda i: (i is None, i or 0))
    packed = packing.pack(ends, public_tokenizers.path("word_bpe_49k.json"), window=64).collect()
    assert set(ids(packed)) == set(want) and sum(r.length for r in packed if r.doc_id == HIGH) == next(r.doc_tokens for r in packed if r.doc_id == HIGH)
    items = spark.createDataFrame([(HIGH, "two three four five six seven eight nine ten eleven"), (LOW, "not in there at all, none of these ten words")], "item_id long, text string")
    found = decontaminate.contamination(decontaminate.build_index(ends), items).collect()
    assert ids(found) == want and all(r["items"] == [HIGH] and r.n_hit == 10 for r in found)
    assert ids(license_scan.scan(ends).collect()) == want
    near = simhash.near_duplicates(ends).collect()
    assert ids(near) == want and {r.component_id for r in near if r.doc_id is not None} >= {LOW}
    assert ids(language.languages(ends).collect()) == want


def test_conversations_with_clashing_columns(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").limit(60)
    path = public_tokenizers.path("byte_bpe_50k.json")
    clashing = turns.withColumns({c: F.lit(c) for c in ("formatted", "token_ids", "loss", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "position", "turns")})
    plain = sorted(map(str, chat_format.format_conversations(turns, path).select("conv_id", "n_turns", "turns_sha256", "loss_sha256").collect()))
    assert plain == sorted(map(str, chat_format.format_conversations(clashing, path).select("conv_id", "n_turns", "turns_sha256", "loss_sha256").collect())) and plain


KEPT = """
import re
import numpy as np
from newsdesk.llm import common

def used():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

parts = common.held("an operator's", lambda: [np.ones(60_000, np.uint8) for _ in range(2_000)])
last, before = parts[-1], used()
del parts
common.release()
print(before - used())
"""


def test_released_memory_goes_back_to_the_system():
    # A worker lives on beside the next operator's; what still stands at the end of its heap mustn't hold the rest.
    if not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux with glibc")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", KEPT], cwd=root, capture_output=True, text=True, check=True).stdout
    assert float(said) > 100

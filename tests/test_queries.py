"""Every registered query runs; those with SQL agree with DuckDB on the small tables."""

from __future__ import annotations

import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsdesk.functions import html
from newsdesk.oracle import ORACLE_SQL
from newsdesk.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_summaries_are_split_whole(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        t = re.sub(r"[ \t\n\r\x0b\f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " ", r.text).strip(" ")
        found = [x for x in (p.strip(" ") for p in re.findall("[^。！？.!?]+[。！？.!?]?", t)) if x][:3]
        if len(found) < 2:
            left, right = t[: -(-len(t) // 2)].strip(" "), t[-(-len(t) // 2) :].strip(" ")
            found = [left, right] if right else [left or "要約データなし。"] * 2
        want[f"d{r.doc_id}"] = (len(found), found[0] if t else "要約データなし。")
    assert max(len(first) for _, first in want.values()) > 200
    assert {r.id: (r.parts, r.first_part) for r in QUERIES["summary_sentences"](spark, sf).collect()} == want


def test_entities_of_whole_pages_are_decoded(spark, sf):
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}

    def one(m):
        ref = m[1]
        if not ref.startswith("#"):
            return named.get(ref, m[0])
        digits = re.fullmatch(r"#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})", ref)
        code = int(digits[1], 16) if digits and digits[1] else int(digits[2]) if digits else 0
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    marked = F.concat("html", F.lit(" &amp;lt; &#233;&#x1F600; &nope; &#xD800; &#0; &quot;"), "html")
    rows = pages.select(marked.alias("h"), html.decoded(marked).alias("decoded")).collect()
    assert sum("&amp;" in r.h[: len(r.h) // 2 - 60] for r in rows) > 0 and len(rows) == pages.count()
    assert all(r.decoded == re.sub(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);", one, r.h) for r in rows)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("lacking", ["folders", "dependency"])
def test_entry_works_without_the_corpus_operators(tmp_path, lacking):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "newsdesk", tmp_path / "newsdesk", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if lacking == "folders" else [])))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if lacking == "dependency" else [])):
        shutil.copy(root / name, tmp_path / name)
    block = "import sys; sys.modules['xxhash'] = None; " if lacking == "dependency" else ""
    code = f"{block}import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False"], out.stderr[-2000:]


def _agrees(spark, name: str, folder: Path) -> list[tuple]:
    """The rows of a query over the tables in ``folder``, which DuckDB's are equal to."""
    con = duckdb.connect()
    for at in folder.glob("*.parquet"):
        con.execute(f"create view {at.stem} as select * from read_parquet('{at}')")
    got = rows(QUERIES[name](spark, str(folder)).toPandas())
    assert got == rows(con.execute(ORACLE_SQL[name]).df())
    return got


def _parts_on_both_sides_of_the_shift(folder: Path) -> None:
    """Parts whose keys, shifted as added entries' are, are other parts' keys: one kept, one removed, one changed."""
    keys = [1, 5, 7, 13, 19, 38, 57, 95, 133, 1_000_013, 1_000_019, 1_000_038, 1_000_057, 1_000_095, 1_000_133]
    pd.DataFrame({"p_partkey": keys, "p_name": "n", "p_size": 3, "p_retailprice": 900.5}).to_parquet(folder / "part.parquet")


def test_added_entries_are_new_where_a_part_has_their_key(spark, tmp_path):
    _parts_on_both_sides_of_the_shift(tmp_path)
    # By name: event, events, first_id, last_id.
    assert set(_agrees(spark, "catalogue_diff", tmp_path)) == {("new", 5, 1_000_019, 1_000_133), ("removed", 2, 13, 1_000_038), ("price_change", 3, 7, 1_000_013), ("context_change", 3, 5, 1_000_095)}


def test_every_event_of_colliding_keys_is_listed(spark, tmp_path):
    _parts_on_both_sides_of_the_shift(tmp_path)
    found = _agrees(spark, "catalogue_events", tmp_path)
    # A part that goes and an added entry of its key are two events of one id.
    assert len(found) == 13 and {e for e, k in found if k == 1_000_038} == {"new", "removed"}


def test_collected_bodies_are_whole(spark, tmp_path):
    edges = ["plain text.", " both ends ", "line\n", "\tin\n the  middle", "　wide ", "", " ", "\n　", None, "x" * 999 + " " + "y" * 20, "z" * 139 + "  z", " " + "a b " * 400]
    texts = [t for t in edges for _ in range(14)]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": "src", "lang": "en", "n_chars": 1}).to_parquet(tmp_path / "documents.parquet")
    found = _agrees(spark, "collected_candidates", tmp_path)
    # By name: the first is body_chars, the fourth platform.
    assert {r[0] for r in found if r[3] == "qiita"} == {None if t is None else len(t) for t in edges}

"""A table kept as versions of Parquet folders: changes rewrite the hash buckets they touch, and a manifest makes them visible at once.

A change is staged in a folder of its own.  Readers only see what the newest manifest names, so a job that dies
before the manifest's rename leaves the version before, and its folder is litter.  Buckets that a change
doesn't touch keep their folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators.counters import counted
from newsdesk.operators.relational import upsert
from newsdesk.session import hadoop_file

BUCKET = "__bucket"


@dataclass(frozen=True)
class Staged:
    """A change that is written but not yet visible: its buckets' folders, those it replaces, and its counts by action."""

    base: int
    folders: dict[str, str]
    counts: dict[str, int]


class Conflict(RuntimeError):
    """Another change became visible first."""


@dataclass(frozen=True)
class Versioned:
    """A table at ``path`` of rows told apart by ``keys``; ``schema`` is DDL of all columns."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 16

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def version(self) -> int:
        """The newest version's number, 0 for a table that nothing has been written to."""
        files, at = hadoop_file(self.spark, f"{self.path}/manifests")
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Bucket -> folder of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(self._manifest(version), wholetext=True).collect()))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(sorted(self.folders(version).values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stage(self, base: int, touched: list[str], rows: DataFrame, counts: Callable[[], dict[str, int]]) -> Staged:
        folder = f"{self.path}/data/{base + 1:010d}-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        dealt = rows.select(*names, self._bucket().alias(BUCKET)).repartition(F.col(BUCKET), F.pmod(F.hash(*self.keys), F.lit(4)))
        dealt.write.partitionBy(BUCKET).parquet(folder)
        files, at = hadoop_file(self.spark, folder)
        made = {s.getPath().getName().split("=")[1] for s in files.listStatus(at) if "=" in s.getPath().getName()}
        # A bucket that has lost its last row has no folder any longer.
        kept = {b: f for b, f in self.folders(base).items() if b not in touched}
        return Staged(base, {**kept, **{b: f"{folder}/{BUCKET}={b}" for b in made}}, counts())

    def _touched(self, rows: DataFrame) -> list[str]:
        # At most as many as there are buckets.
        return [str(r[0]) for r in rows.select(self._bucket()).distinct().collect()]

    def stage_upsert(self, incoming: DataFrame, values: Sequence[str], keep: Sequence[str] = ()) -> Staged:
        """Rows of ``incoming``, one a key, inserted or updated; ``keep`` columns never change once they are there.

        Only buckets that hold one of its keys are read and written.
        """
        base, touched = self.version(), self._touched(incoming)
        now = self.folders(base)
        if not touched:
            return Staged(base, now, dict.fromkeys(("inserted", "updated", "skipped"), 0))
        merged = upsert(self._rows([now[b] for b in sorted(touched) if b in now]), incoming, self.keys, values, keep)
        of = lambda action: F.count_if(F.col("action") == action)
        rows, counts = counted(merged, **{a: of(a) for a in ("inserted", "updated", "skipped")})
        return self._stage(base, touched, rows, counts)

    def stage_delete(self, gone: DataFrame) -> Staged:
        """Rows whose keys ``gone`` has are left out."""
        base, touched = self.version(), self._touched(gone)
        now = self.folders(base)
        if not touched:
            return Staged(base, now, {"deleted": 0})
        marked = self._rows([now[b] for b in sorted(touched) if b in now]).join(gone.select(*self.keys).distinct().withColumn("_gone", F.lit(True)), list(self.keys), "left")
        rows, counts = counted(marked, deleted=F.count("_gone"))
        return self._stage(base, touched, rows.filter("_gone is null"), counts)

    def publish(self, staged: Staged) -> int:
        """The change becomes visible as one; an error if another one has since it was staged."""
        if self.version() != staged.base:
            raise Conflict(f"{self.path} has moved on from version {staged.base}")
        files, at = hadoop_file(self.spark, self._manifest(staged.base + 1))
        _, draft = hadoop_file(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(staged.folders, sort_keys=True).encode())
        out.close()
        if files.exists(at) or not files.rename(draft, at):
            files.delete(draft, False)
            raise Conflict(f"{self.path} has moved on from version {staged.base}")
        return staged.base + 1

    def upsert(self, incoming: DataFrame, values: Sequence[str], keep: Sequence[str] = ()) -> dict[str, int]:
        """``stage_upsert`` made visible; the counts of rows inserted, updated and skipped."""
        staged = self.stage_upsert(incoming, values, keep)
        self.publish(staged)
        return staged.counts


def retire(tables: dict[Versioned, DataFrame], unchanged: Sequence[Callable[[dict[str, DataFrame]], DataFrame]] = (), dry_run: bool = False, check: Callable[[dict[str, int]], None] | None = None) -> dict[str, int]:
    """Deletes ``tables``' keys, after all deletions are staged and checked; the rows that go, by the table's folder.

    ``unchanged`` make, from the tables by path, results that no deletion may alter: each is told by count and hash before, and again
    with the staged tables in place.  If one differs, or ``check`` raises, nothing becomes visible.  A dry run
    stages and checks the same way, so that it tells what the deletion would do.
    """
    staged = {t: t.stage_delete(gone) for t, gone in tables.items()}
    counts = {t.path.rsplit("/", 1)[-1]: s.counts["deleted"] for t, s in staged.items()}
    after = {t.path: t._rows(sorted(s.folders.values())) for t, s in staged.items()}
    for result in unchanged:
        before, then = fingerprint(result({t.path: t.read() for t in tables})), fingerprint(result(after))
        if before != then:
            raise ValueError(f"a deletion would change what has to stay: {before} to {then}")
    if check:
        check(counts)
    if not dry_run:
        for t, s in staged.items():
            t.publish(s)
    return counts


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of their hashes that no order changes."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)

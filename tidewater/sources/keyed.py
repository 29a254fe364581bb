"""Tables by key that many writers may change at once: rows in buckets by hash of their key, small deltas over them, and a log of commits.

A change writes only its own rows, as a delta to the buckets that they fall in. Whoever reads takes of each key the row of the latest commit;
buckets without deltas are read as they are. A commit is a numbered file of the log that is put in place only if no one else has that number.
A writer that comes second looks at what was committed since it read: if no bucket that it read has changed, it takes the next number, else
it works its change out again. When a bucket has many deltas, they are folded into one; the log is summed up every so often.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a table, deltas of a bucket before they are folded, commits between two sums of the log, and attempts of a writer.
BUCKETS, DELTAS, SUMMED, ATTEMPTS = 64, 8, 32, 20


class Conflict(RuntimeError):
    """Others kept changing what a writer had read."""


class KeyedTable:
    """A table under ``path`` whose rows are told apart by ``key`` (no nulls). All columns but those named here are the caller's.

    ``buckets`` holds for a table's whole life. Deleted rows are rows whose key is known and gone. Old files stay for those who still read them;
    ``unreferenced`` lists them.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.key, self.buckets, self.deltas = spark, path.rstrip("/"), key, buckets, deltas
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # The log

    def _put(self, name: str, entry: dict) -> bool:
        """Puts a file of the log in place, whole, unless it is there: a rename that replaces nothing."""
        draft = self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        target = self._hadoop.Path(f"{self.path}/log/{name}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, target, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{name}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _names(self) -> list[str]:
        log = self._hadoop.Path(f"{self.path}/log")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def state(self) -> tuple[int, dict[int, list[list]]]:
        """The last commit's number, and for each bucket the (commit, folder) that hold its rows, oldest first."""
        names = self._names()
        sums = [n for n in names if n.startswith("sum-")]
        number, held = 0, {}
        if sums:
            found = self._get(sums[-1])
            number, held = found["number"], {int(b): x for b, x in found["held"].items()}
        for name in (n for n in names if n.startswith("commit-") and n > f"commit-{number:012d}"):
            entry = self._get(name)
            number = entry["number"]
            if entry["whole"]:
                held = {}
            for b in entry["buckets"]:
                there = held.get(b, [])
                folded = entry.get("folds", {}).get(str(b), 0)  # so many of the oldest go into this one
                held[b] = [[number, entry["folder"]], *there[folded:]] if folded else [*there, [number, entry["folder"]]]
        return number, held

    # Rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, list[list]], schema=None) -> DataFrame | None:
        """The rows of the buckets ``held``: of each key that of the latest commit, if it isn't gone."""
        single = {b: x for b, x in held.items() if len(x) == 1}
        many = {b: x for b, x in held.items() if len(x) > 1}

        def scan(some: dict[int, list[list]]) -> DataFrame | None:
            folders: dict[tuple[int, str], list[int]] = {}
            for b, parts in some.items():
                for at, (_, folder) in enumerate(parts):
                    folders.setdefault((at, folder), []).append(b)
            found = None
            for (at, folder), own in sorted(folders.items()):
                base = f"{self.path}/data/{folder}"
                part = self.spark.read.option("basePath", base).parquet(*[f"{base}/_b={b}" for b in sorted(own)]).withColumn("_at", F.lit(at))
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
            return found

        plain, layered = scan(single), scan(many)
        if layered is not None:
            newest = Window.partitionBy(*self.key).orderBy(F.desc("_at"))
            layered = layered.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
        rows = plain if layered is None else layered if plain is None else plain.unionByName(layered, allowMissingColumns=True)
        return None if rows is None else rows.where("not _gone").drop("_b", "_at", "_gone")

    def read(self) -> DataFrame | None:
        """All rows as of now; a later change doesn't touch what is being read."""
        return self._rows(self.state()[1])

    def _write(self, rows: DataFrame, gone: DataFrame | None = None) -> tuple[str, list[int]]:
        """Writes rows (and keys that go) by bucket; the folder, and the buckets that got any."""
        folder = uuid.uuid4().hex
        out = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            out = out.unionByName(gone.select(*self.key).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        out.withColumn("_b", self._bucket()).repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/data/{folder}")
        there = self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/{folder}"))
        names = [x.getPath().getName() for x in there]
        return folder, sorted(int(n.removeprefix("_b=")) for n in names if n.startswith("_b="))

    def _commit(self, number: int, folder: str, buckets: list[int], whole: bool = False, folds: dict[int, int] | None = None) -> bool:
        entry = {"number": number, "folder": folder, "buckets": buckets, "whole": whole, "folds": {str(b): n for b, n in (folds or {}).items()}}
        if not self._put(f"commit-{number:012d}", entry):
            return False
        if number % SUMMED == 0:
            last, held = self.state()
            self._put(f"sum-{last:012d}", {"number": last, "held": held})
        return True

    # Changes

    def overwrite(self, rows: DataFrame) -> int:
        """Puts ``rows`` in place of all there are."""
        folder, buckets = self._write(rows)
        while True:
            number = self.state()[0] + 1
            if self._commit(number, folder, buckets, whole=True):
                return number

    def change(self, keys: DataFrame, work: Callable[[DataFrame | None], tuple[DataFrame | None, DataFrame | None]]) -> int:
        """Changes rows whose keys are among ``keys``: ``work`` gets those that are stored, and gives rows to put and keys that go (or none; neither: nothing is changed).

        Only the buckets that ``keys`` fall in are read, and only what ``work`` gives is written. If another writer has changed one of these
        buckets meanwhile, ``work`` is asked again on what it left; it must give the same for the same rows. The commit's number.
        """
        wanted = keys.select(*self.key).distinct()
        touched = [r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # no more than there are buckets
        for _ in range(ATTEMPTS):
            number, held = self.state()
            mine = {b: held[b] for b in touched if b in held}
            stored = self._rows(mine)
            put, gone = work(None if stored is None else stored.join(wanted, self.key, "left_semi"))
            if put is None:
                return number
            folder, buckets = self._write(put, gone)
            while True:
                if self._commit(number + 1, folder, buckets):
                    self._fold(number + 1)
                    return number + 1
                number, now = self.state()
                if any(now.get(b) != held.get(b) for b in touched):
                    break  # what was read holds no longer
        raise Conflict(f"no commit in {ATTEMPTS} attempts")

    def put(self, rows: DataFrame) -> int:
        """Puts ``rows`` in, in place of those of their keys."""
        return self.change(rows, lambda _: (rows, None))

    def insert(self, rows: DataFrame) -> int:
        """Puts in those of ``rows`` (one a key) whose key isn't there: a second time nothing."""
        return self.change(rows, lambda stored: (rows if stored is None else rows.join(stored.select(*self.key), self.key, "left_anti"), None))

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of ``keys``, as far as they are there."""

        def work(stored: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
            return (None, None) if stored is None else (stored.limit(0), stored.select(*self.key))

        return self.change(keys, work)

    def _fold(self, number: int) -> None:
        """Folds the deltas of buckets that have over ``deltas`` of them. Others may commit meanwhile: what they add stays on top."""
        _, held = self.state()
        full = {b: x for b, x in held.items() if len(x) > self.deltas}
        if not full:
            return
        rows = self._rows(full)
        folder, buckets = self._write(rows)
        folds = {b: len(full[b]) for b in full}
        for b in set(full) - set(buckets):
            folds.pop(b)  # nothing is left in it: its deltas stay
        while buckets:
            last, now = self.state()
            if any(now.get(b, [])[: folds[b]] != full[b] for b in buckets):
                return  # another writer has folded, or written all anew
            if self._commit(last + 1, folder, buckets, folds={b: folds[b] for b in buckets}):
                return

    def unreferenced(self) -> list[str]:
        """Folders of data that the table as it is now has no use for."""
        used = {folder for parts in self.state()[1].values() for _, folder in parts}
        data = self._hadoop.Path(f"{self.path}/data")
        return sorted(n for n in (x.getPath().getName() for x in self._fs.listStatus(data)) if n not in used) if self._fs.exists(data) else []

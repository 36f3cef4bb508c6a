"""Operator 5, substring deduplication with a log-structured fingerprint index.

A window is 13 consecutive words of a document. Documents come in batches of ascending ids. The windows
of a batch are hashed, reduced to one claim for each window and chunk of documents, and dealt to units of
the fingerprint space. In each unit the sorted claims are merge-joined with the sorted immutable runs of
earlier batches on a 64-bit fingerprint; a hit is verified by a second, independent 32-bit hash of the
same words before it counts. Windows that are new become the batch's own run; runs of one level are
compacted into one of the next when there are ``FANOUT``. Every word covered by a window that an earlier
document holds is removed.

Equality of windows is that of both hashes, 96 bits in all; the words themselves are not compared, as an
index of words would be many times the corpus. Two windows of other words are taken for one with a chance
of 2^-96 a pair.

Runs are bucketed tables in the shared folder, so that joining them needs no shuffle. A unit holds the
windows of ``UNIT_BYTES`` of text, which fit in memory; a bucket, one file, has as many units as it takes
to keep to ``MAX_BUCKETS``. A very common window has one claim for each chunk. A named index outlives the
call: ``FingerprintIndex.open`` finds its runs again, and later batches, of greater ids, are judged by them.

Null texts have no words. A row with a null id owns no window and keeps all its words. Rows with one id
are one document and don't remove each other's words. Columns of any name are kept. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, delete_path, shared_folder

WINDOW = 13
BATCHES = 3
FANOUT = 2
CHUNK_WINDOWS = 1 << 18
UNIT_BYTES = 8 << 20
MIN_BUCKETS, MAX_BUCKETS = 64, 1 << 15
_ROW = "bucket int, unit long, kind int, doc long, fp binary, chk binary, owner binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()), ("fp", pa.binary()), ("chk", pa.binary()), ("owner", pa.binary())])
_KEYS = ("bucket", "unit")
CLAIM, ANSWER, RUN = 0, 1, 2


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as planes of bytes, differences first if ascending: what repeats is then easily compressed."""
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if ascending else values


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and check of each window; the two are seeded apart."""
    starts, ends = tx.spans(data)
    if len(starts) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    fp = tx.grams(tx.word_hashes(data, starts, ends, 101), WINDOW)
    chk = tx.grams(tx.word_hashes(data, starts, ends, 202), WINDOW)
    return fp, (chk >> np.uint64(32)).astype(np.uint32)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)


def _answers(unit, buckets: int, doc: np.ndarray, fp: np.ndarray, chk: np.ndarray) -> list[tuple]:
    """One row for each document that has windows to remove; ``unit`` of a document id."""
    order = np.argsort(doc, kind="stable")
    doc, fp, chk = doc[order], fp[order], chk[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    parts = zip(*(np.split(x, cuts) for x in (doc, fp, chk)), strict=True)
    return [(unit(int(d[0])) % buckets, unit(int(d[0])), ANSWER, int(d[0]), f.tobytes(), c.tobytes(), None) for d, f, c in parts if len(d)]


def _owners(fp: np.ndarray, chk: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (fp, chk, doc); the place of the least document of each window, and each one's window."""
    order = np.lexsort((doc, chk, fp))
    f, c = fp[order], chk[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _chunk(fps: list, chks: list, docs: list, units: int, buckets: int) -> pa.Table:
    fp, chk, doc = np.concatenate(fps), np.concatenate(chks), np.concatenate(docs)
    order, first, group = _owners(fp, chk, doc)
    fp, chk, doc = fp[order], chk[order], doc[order]
    later = doc != doc[first][group]
    rows = _answers(lambda d: d % units, buckets, doc[later], fp[later], chk[later])
    fp, chk, doc = fp[first], chk[first], doc[first]
    unit = (fp % np.uint64(units)).astype(np.int64)
    order = np.argsort(unit, kind="stable")
    cuts = np.flatnonzero(np.diff(unit[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            mine = int(unit[at[0]])
            rows.append((mine % buckets, mine, CLAIM, None, pack(fp[at], True), pack(chk[at]), pack(doc[at])))
    return _rows(rows)


def _claims(units: int, buckets: int, chunk_windows: int):
    def run(batches):
        fps, chks, docs, n = [], [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not value.is_valid:
                    continue
                fp, chk = windows(value.as_py())
                if not len(fp):
                    continue
                fps.append(fp)
                chks.append(chk)
                docs.append(np.full(len(fp), doc, np.int64))
                n += len(fp)
                if n >= chunk_windows:
                    yield from _chunk(fps, chks, docs, units, buckets).to_batches()
                    fps, chks, docs, n = [], [], [], 0
        if n:
            yield from _chunk(fps, chks, docs, units, buckets).to_batches()

    return run


def _held(run: tuple[np.ndarray, np.ndarray], fp: np.ndarray, chk: np.ndarray) -> np.ndarray:
    """Which windows are in the run: merge by fingerprint, verified by the check."""
    rf, rc = run
    out = np.zeros(len(fp), bool)
    at, todo = np.searchsorted(rf, fp), np.arange(len(fp))
    while todo.size:
        inside = at[todo] < len(rf)
        todo = todo[inside]
        todo = todo[rf[at[todo]] == fp[todo]]
        same = rc[at[todo]] == chk[todo]
        out[todo[same]] = True
        todo = todo[~same]  # another window of the same fingerprint stands next, if at all
        at[todo] += 1
    return out


def _resolve(buckets: int):
    def run(key, left, right):
        bucket, unit = int(key[0].as_py()), int(key[1].as_py())
        kinds = left.column("kind").to_numpy() if left.num_rows else np.empty(0, np.int32)
        passed = left.filter(pa.array(kinds == ANSWER)) if left.num_rows else None
        claims = left.filter(pa.array(kinds == CLAIM)).to_pylist() if left.num_rows else []
        if not claims:
            return passed.select(_SCHEMA.names).cast(_SCHEMA) if passed is not None else _SCHEMA.empty_table()
        fp = np.concatenate([unpack(r["fp"], np.uint64, True) for r in claims])
        chk = np.concatenate([unpack(r["chk"], np.uint32) for r in claims])
        doc = np.concatenate([unpack(r["owner"], np.int64) for r in claims])
        order, first, group = _owners(fp, chk, doc)
        fp, chk, doc = fp[order], chk[order], doc[order]
        known = np.zeros(len(first), bool)
        for r in right.to_pylist():
            known |= _held((unpack(r["fp"], np.uint64, True), unpack(r["chk"], np.uint32)), fp[first], chk[first])
        remove = known[group] | (doc != doc[first][group])
        rows = _answers(lambda d: unit, buckets, doc[remove], fp[remove], chk[remove])
        new = first[~known]
        if len(new):
            rows.append((bucket, unit, RUN, None, pack(fp[new], True), pack(chk[new]), None))
        out = _rows(rows)
        return pa.concat_tables([out, passed.select(_SCHEMA.names).cast(_SCHEMA)]) if passed.num_rows else out

    return run


def _merge_runs(key, left, right):
    rows = [*left.to_pylist(), *right.to_pylist()]
    fp = np.concatenate([unpack(r["fp"], np.uint64, True) for r in rows])
    chk = np.concatenate([unpack(r["chk"], np.uint32) for r in rows])
    order = np.lexsort((chk, fp))
    return _rows([(int(key[0].as_py()), int(key[1].as_py()), RUN, None, pack(fp[order], True), pack(chk[order]), None)])


class FingerprintIndex:
    """Sorted immutable runs of the window hashes of earlier batches.

    ``units`` and ``buckets`` are fixed for its life: take those of the corpus that it is to hold (``sized``).
    With a ``name`` its state is written after each batch, and ``open`` finds it again. ``drop`` when done.
    """

    def __init__(self, spark: SparkSession, units: int = MIN_BUCKETS, buckets: int | None = None, name: str | None = None, fanout: int = FANOUT, chunk_windows: int = CHUNK_WINDOWS):
        self.spark, self.units, self.fanout, self.chunk_windows = spark, units, fanout, chunk_windows
        self.buckets = min(buckets or MAX_BUCKETS, units)
        self.saved = name is not None
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []  # level, table
        self._n = 0

    @staticmethod
    def sized(n_bytes: int) -> int:
        """Units for so many bytes of text."""
        return max(MIN_BUCKETS, -(-n_bytes // UNIT_BYTES))

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> FingerprintIndex:
        """The index of this name in the shared folder, as its last finished batch left it."""
        folder = f"{shared_folder(spark)}/{name}_state"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
        done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not done:
            raise ValueError(f"no index {name!r} in the shared folder")
        last = max((f.getPath().getParent().toString() for f in done), key=lambda p: int(p.rsplit("/", 1)[1]))
        state = spark.read.parquet(last).collect()  # a row for each run
        index = cls(spark, state[0].units, state[0].buckets, name, state[0].fanout, state[0].chunk_windows)
        index._n = state[0].n
        index.runs = [(r.level, r.run) for r in state if r.run]
        for _, table in index.runs:
            if not spark.catalog.tableExists(table):
                columns = ", ".join(c for c in _ROW.split(", ") if not c.startswith("kind"))
                spark.sql(f"CREATE TABLE {table} ({columns}, kind int) USING parquet PARTITIONED BY (kind) CLUSTERED BY (bucket) INTO {index.buckets} BUCKETS LOCATION '{shared_folder(spark)}/{table}'")
                spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return index

    def _remember(self) -> None:
        """Write the state beside the former one, which counts until this one is whole."""
        folder = f"{shared_folder(self.spark)}/{self.name}_state"
        rows = [(level, run, self.units, self.buckets, self.fanout, self.chunk_windows, self._n) for level, run in self.runs or [(0, "")]]
        state = self.spark.createDataFrame(rows, "level int, run string, units long, buckets int, fanout int, chunk_windows long, n long")
        state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{self._n}")

    def _save(self, df: DataFrame) -> str:
        self._n += 1
        table = f"{self.name}_{self._n}"
        path = f"{shared_folder(self.spark)}/{table}"
        self._forget(table)  # of a batch that failed half way
        df.write.option("compression", "zstd").partitionBy("kind").bucketBy(self.buckets, "bucket").option("path", path).saveAsTable(table)
        return table

    def _run(self, table: str) -> DataFrame:
        return self.spark.table(table).where(f"kind = {RUN}").select(*_KEYS, "fp", "chk")

    def _by_bucket(self, job):
        """Runs ``job`` with groups of (bucket, unit) joined where their bucket lies, without a shuffle of the runs."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            return job()
        finally:
            self.spark.conf.set(key, before)

    def dedup(self, batch: DataFrame, remember: bool = True) -> DataFrame:
        """``doc, fp, chk``: the windows of each document of ``batch(doc_id, text)`` that an earlier one holds;
        a row for each document and unit. The batch's new windows are remembered as a run."""
        rows = batch.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        claims = rows.mapInArrow(_claims(self.units, self.buckets, self.chunk_windows), _ROW)
        history = None
        for _, table in self.runs:
            run = self._run(table)
            history = run if history is None else history.unionByName(run)
        if history is None:
            history = self.spark.createDataFrame([], "bucket int, unit long, fp binary, chk binary")
        found = claims.groupBy(*_KEYS).cogroup(history.groupBy(*_KEYS)).applyInArrow(_resolve(self.buckets), _ROW)
        scratch = Scratch(self.spark)
        if not remember:
            return self._by_bucket(lambda: scratch.write(found.where(f"kind = {ANSWER}").select("doc", "fp", "chk"), "answers"))
        table = self._by_bucket(lambda: self._save(found))
        del rows, claims, history, found
        scratch.free_shuffles()
        answers = scratch.write(self.spark.table(table).where(f"kind = {ANSWER}").select("doc", "fp", "chk"), "answers")
        self.runs.append((0, table))
        old = self.compact()
        if self.saved:
            self._remember()
        for gone in old:  # the state that named them is no longer the last
            self._forget(gone)
        return answers

    def compact(self) -> list[str]:
        """Merge the runs of a level into one of the next while a level has ``fanout`` of them; the tables merged."""
        level, old = 0, []
        while any(at >= level for at, _ in self.runs):
            full = [t for at, t in self.runs if at == level]
            if len(full) >= self.fanout:
                merged = full[0]
                for table in full[1:]:  # two runs at a time, bucket by bucket: no shuffle
                    both = self._run(merged).groupBy(*_KEYS).cogroup(self._run(table).groupBy(*_KEYS))
                    new = self._by_bucket(lambda both=both: self._save(both.applyInArrow(_merge_runs, _ROW)))
                    old += [merged, table]
                    merged = new
                self.runs = [(at, t) for at, t in self.runs if at != level] + [(level + 1, merged)]
            level += 1
        return old

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(self.spark, f"{shared_folder(self.spark)}/{table}")

    def drop(self) -> None:
        """Remove every table of the index, of failed batches too."""
        for n in range(1, self._n + 1):
            self._forget(f"{self.name}_{n}")
        delete_path(self.spark, f"{shared_folder(self.spark)}/{self.name}_state")
        self.runs = []


def repeated(docs: DataFrame, batches: int = BATCHES, units: int | None = None, index: FingerprintIndex | None = None, **how) -> DataFrame:
    """``doc, fp, chk``: what every document of ``docs`` repeats from those with smaller ids, through the index.

    A given ``index`` holds what earlier calls gave it, of smaller ids, and remembers all of ``docs``.
    """
    spark = docs.sparkSession
    low, high, n, size = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    if not n:
        return spark.createDataFrame([], "doc long, fp binary, chk binary")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0]
    cuts = sorted(c for c in set(cuts if batches > 1 else []) if low <= c < high)
    own = index or FingerprintIndex(spark, units or FingerprintIndex.sized(size or 0), **how)
    out = None
    try:
        for after, upto in zip([None, *cuts], [*cuts, None], strict=True):
            part = docs
            part = part if after is None else part.where(F.col("doc_id") > after)
            part = part if upto is None else part.where(F.col("doc_id") <= upto)
            answers = own.dedup(part, remember=index is not None or upto is not None)
            out = answers if out is None else out.unionByName(answers)
    finally:
        if index is None:
            own.drop()
    Scratch(spark).free_shuffles()
    return out


def kept_words(data: bytes, repeats: list[tuple[bytes, bytes]] | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by a space; ``repeats`` are fingerprints and checks."""
    starts, ends = tx.spans(data)
    n = len(starts)
    gone = np.zeros(n + 1, np.int64)
    if repeats and n >= WINDOW:
        fp, chk = windows(data)
        at = np.flatnonzero(_held(_sorted(repeats), fp, chk))
        gone[at] += 1
        np.subtract.at(gone, at + WINDOW, 1)
    gone = np.cumsum(gone)[:n] > 0
    words = data.split()
    if gone.any():
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return n, int(gone.sum()), b" ".join(words)


def _sorted(repeats: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    fp = np.frombuffer(b"".join(f for f, _ in repeats), np.uint64)
    chk = np.frombuffer(b"".join(c for _, c in repeats), np.uint32)
    order = np.lexsort((chk, fp))
    return fp[order], chk[order]


def _apply(docs: DataFrame, row, columns: str, **how) -> DataFrame:
    """``_row``, the columns of ``docs`` but text, and ``row(data or None, repeats)`` of each document as ``columns``."""
    answers = repeated(docs.select("doc_id", "text"), **how)
    answers = answers.groupBy("doc").agg(F.collect_list(F.struct("fp", "chk")).alias("repeats"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("_row"))
    joined = packed.join(answers, "doc", "left").select("_row", "text", "repeats")
    kinds = {"long": pa.int64(), "string": pa.string()}
    new = [(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            found = ([(r["fp"], r["chk"]) for r in rs] if rs else None for rs in batch.column(2).to_pylist())
            made = [row(t.as_py() if t.is_valid else None, r) for t, r in zip(batch.column(1).cast(pa.binary()), found, strict=True)]
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*made, strict=True), new, strict=True)] if made else [pa.array([], t) for _, t in new]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_row", *(n for n, _ in new)])

    return joined.mapInArrow(run, f"_row {joined.schema['_row'].dataType.simpleString()}, {columns}")


def digests(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each of ``docs(doc_id, text)``."""

    def row(data, repeats):
        n, removed, kept = kept_words(data or b"", repeats)
        return n, removed, hashlib.sha256(kept).hexdigest()

    out = _apply(docs.select("doc_id", "text"), row, "n_words long, n_removed long, kept_sha256 string", **how)
    return out.select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


def clean(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all rows and columns; where words are removed the text is the kept words joined by a space,
    and ``n_chars``, if there, its length. Other texts stay as they are."""

    def row(data, repeats):
        if data is None or not repeats:
            return (None if data is None else data.decode(),)
        _, removed, kept = kept_words(data, repeats)
        return ((kept if removed else data).decode(),)

    out = _apply(docs, row, "text string", **how)
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": F.col("text")} if length is None else {"text": F.col("text"), "n_chars": length.cast(docs.schema["n_chars"].dataType)}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

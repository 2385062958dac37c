"""Rows and the folds of all repetitions, a byte each (W-11, M-9).

``repeats`` x rows are never laid out.  Rows are stored as chunks, one array a
column.  Of each repetition only 8 bytes of a row's md5 go through a shuffle, by
ranges of it; its place in the range comes back as one byte with the row's
number in its chunk, and the chunk stores a byte a repetition.  Repetitions go in
waves of about ``WAVE_ROWS`` digests, so that the shuffle files of one wave can be
removed before the next.  Equal 8 bytes of two rows are seen, and their wave is
dealt again by all 16.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

try:
    from _md5 import md5  # OpenSSL's sets up a context a call, three times as slow
except ImportError:
    from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hints import broadcast_if_small
from ..session import materialize, scratch_folder

#: Rows of a chunk (numbered by two bytes), and chunks of a file: a reader holds a file's chunks at once.
CHUNK_ROWS, FILE_CHUNKS = 65_536, 8
#: Rows of one range of digests or scores, which one task sorts.
RANGE_ROWS = 2_000_000
#: Digests or scores that one wave of repetitions shuffles.
WAVE_ROWS = 100_000_000
#: The fold of a row that is not dealt, since it has no label.
NO_FOLD = 255


def waves(rows: int, repeats: int) -> list[range]:
    """Repetitions that go together."""
    each = max(1, WAVE_ROWS // max(1, rows))
    return [range(a, min(a + each, repeats)) for a in range(0, repeats, each)]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are gone: it does so when their handles are collected."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(path)
    return df.sparkSession.read.parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _one_row(chunk: int, arrays: dict):
    import pyarrow as pa

    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists], names=["_chunk", *arrays])


def _chunked(df: DataFrame) -> DataFrame:
    """(_chunk, an array for each column of ``df``)."""
    names = df.columns

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK_ROWS - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == CHUNK_ROWS:
                    yield _put(pa, held)
                    held, rows = [], 0
        if held:
            yield _put(pa, held)

    def _put(pa, held):
        t = pa.Table.from_batches(held).combine_chunks()
        return _one_row(t.column("_row")[0].as_py(), {n: pa.concat_arrays(t.column(n).chunks) for n in names})

    kind = T.StructType([T.StructField("_chunk", T.LongType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in df.schema.fields]])
    return df.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, kind)


def _digests(ids: list, rep: int, seed: int) -> np.ndarray:
    """md5(id, rep, seed) as two numbers a row; a missing id is left out, as ``concat_ws`` does."""
    end = f"{rep}-{seed}".encode()
    tail = b"-" + end
    found = b"".join([md5(x + tail).digest() if x is not None else md5(end).digest() for x in ids])
    return np.frombuffer(found, ">u8").astype("u8").reshape(-1, 2)


def _groups(columns: list) -> tuple[np.ndarray, list[str]]:
    """A number for the group of each row, and the groups' names; -1 where a value is missing."""
    code, names, missing = np.zeros(len(columns[0]), "i8"), [""], np.zeros(len(columns[0]), bool)
    for c in columns:
        d = c.dictionary_encode()
        values = [str(v) for v in d.dictionary.to_pylist()]
        missing |= ~d.indices.is_valid().to_numpy(zero_copy_only=False)
        code = code * max(1, len(values)) + d.indices.fill_null(0).to_numpy(zero_copy_only=False)
        names = [f"{a}\x1f{v}" for a in names for v in values or [""]]
    return np.where(missing, -1, code), names


def _cuts(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Row numbers by key, in their order, and where each key's begin and end."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order])) + 1
    ends = [0, *edge.tolist(), len(key)]
    return order, [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _dealt_chunks(chunks: DataFrame, id_col: str, group: list[str], k: int, reps: range, bits: int, seed: int, words: int) -> DataFrame:
    """(rep, name, range, _chunk, n, places, twins): per chunk and range of digests the rows'
    numbers and their place in the range modulo ``k``; twins: some digests are equal."""
    kind = "u1" if k <= NO_FOLD else "u4"

    def out(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_pylist()
                code, names = _groups([batch.column(c)[i].values for c in range(2, 2 + len(group))])
                for rep in reps:
                    d = _digests(ids, rep, seed)
                    span = (d[:, 0] >> np.uint64(64 - bits)).astype("i8") if bits else np.zeros(len(d), "i8")
                    order, ends = _cuts((code + 1) * (1 << bits) + span)
                    first = [order[a] for a, _ in ends]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rep] * len(ends), pa.int32()), pa.array([span[x] for x in first], pa.int64()),
                        pa.array([None if code[x] < 0 else names[code[x]] for x in first], pa.string()), pa.array([chunk] * len(ends), pa.int64()),
                        pa.array([zlib.compress(np.diff(order[a:b], prepend=0).astype("u2").tobytes(), 1) for a, b in ends], pa.binary()),
                        pa.array([d[order[a:b], :words].tobytes() for a, b in ends], pa.binary())], names=["rep", "range", "name", "_chunk", "at", "digests"])

    def placed(table):
        import pyarrow as pa

        d = [np.frombuffer(x, "u8").reshape(-1, words) for x in table.column("digests").to_pylist()]
        name = np.array([x or "" for x in table.column("name").to_pylist()], dtype=object)
        held = np.concatenate(d)
        one = np.sort(held[:, 0])
        twins = bool((one[1:] == one[:-1]).any())
        places: list = [None] * len(d)
        for g in set(name.tolist()):
            mine = np.flatnonzero(name == g)
            own = np.concatenate([d[i] for i in mine])
            place = np.empty(len(own), kind)
            place[np.lexsort(own.T[::-1])] = np.arange(len(own)) % k
            upto = 0
            for i in mine:
                places[i] = zlib.compress(place[upto:upto + len(d[i])].tobytes(), 1)
                upto += len(d[i])
        keep = table.select(["rep", "range", "name", "_chunk", "at"])
        return keep.append_column("n", pa.array([len(x) for x in d], pa.int64())).append_column("places", pa.array(places, pa.binary())).append_column(
            "twins", pa.array([twins] * len(d)))

    ids = F.col(id_col).cast("array<string>").cast("array<binary>").alias("_ids")
    sent = chunks.select("_chunk", ids, *group).mapInArrow(out, "rep int, range long, name string, _chunk long, at binary, digests binary")
    found = sent.groupBy("rep", "range").applyInArrow(placed, "rep int, range long, name string, _chunk long, at binary, n long, places binary, twins boolean")
    return materialize(found, "fold_places")


def _placed(chunks: DataFrame, rows: int, id_col: str, group: list[str], k: int, repeats: int, seed: int) -> DataFrame:
    """(_chunk, _places): of each chunk every (rep, at, places, off); ``off`` is
    the rows of the group in the ranges before."""
    bits = max(0, (max(1, rows) - 1) // RANGE_ROWS).bit_length()
    parts = None
    for reps in waves(rows, repeats):
        found = _dealt_chunks(chunks, id_col, group, k, reps, bits, seed, 1)
        if not found.filter("twins").isEmpty():
            found = _dealt_chunks(chunks, id_col, group, k, reps, bits, seed, 2)
        parts = found if parts is None else parts.unionByName(found)
        if len(reps) < repeats:
            release(chunks.sparkSession)
    parts = parts.filter("name is not null")
    before = Window.partitionBy("rep", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("rep", "name", "range").agg(F.sum("n").alias("n"))  # a row a range: few beside the rows
    off = materialize(sizes.select("rep", "name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")), "fold_offsets")
    x = parts.join(broadcast_if_small(off), ["rep", "name", "range"])
    return x.groupBy("_chunk").agg(F.collect_list(F.struct("rep", "at", "places", "off")).alias("_places"))


def _folds(places, n: int, k: int, repeats: int) -> np.ndarray:
    """The fold of each row of a chunk in each repetition."""
    wide = k > NO_FOLD
    out = np.full((repeats, n), np.iinfo("u4").max if wide else NO_FOLD, "u4" if wide else "u1")
    for p in places or []:
        at = np.cumsum(np.frombuffer(zlib.decompress(p["at"]), "u2"), dtype="i8")
        out[p["rep"], at] = (np.frombuffer(zlib.decompress(p["places"]), out.dtype) + np.int64(p["off"])) % k
    return out


def fold_rows(df: DataFrame, id_col: str, group: list[str], k: int, repeats: int, seed: int) -> DataFrame:
    """(group, id, rep, fold) of :func:`faultline.operators.sampling.stratified_folds`."""
    x = df.select(*group, id_col)
    chunks, _ = _stored(_chunked(x), "fold_chunks")
    rows = chunks.select(F.sum(F.size(id_col))).first()[0] or 0
    joined = chunks.join(_placed(chunks, rows, id_col, group, k, repeats, seed), "_chunk")
    columns = x.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("_places")
            for i in range(batch.num_rows):
                own = [batch.column(batch.schema.get_field_index(c))[i].values for c in columns]
                folds = _folds(batch.column(at)[i].as_py(), len(own[0]), k, repeats)
                dealt = folds[0] != np.iinfo(folds.dtype).max  # by label: the same in every repetition
                keep = None if dealt.all() else pa.array(dealt)
                for rep in range(repeats):
                    out = [*own, pa.array(np.full(len(dealt), rep), pa.int32()), pa.array(folds[rep].astype("i4"))]
                    made = pa.RecordBatch.from_arrays(out, names=[*columns, "rep", "fold"])
                    yield made if keep is None else made.filter(keep)

    return joined.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField("rep", T.IntegerType()), T.StructField("fold", T.IntegerType())]))


class FoldedChunks:
    """Rows with their folds of all repetitions, by chunks: the rows of
    :func:`faultline.operators.sampling.folded_rows`, each stored once."""

    def __init__(self, df: DataFrame, id_col: str, label: str, k: int, repeats: int, seed: int):
        spark = self.spark = df.sparkSession
        self.id_col, self.k, self.repeats = id_col, k, repeats
        rest = [c for c in df.columns if c != id_col]
        # Rows of one id meet each other; rows without an id are dealt, but meet none.
        seen = df.groupBy(F.xxhash64(id_col).alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(id_col).isNull()).alias("_none"))
        again = materialize(seen.filter("_n > 1 or _none").select("_h"), "ids_again")
        own = df.select(id_col, label, F.array(F.struct(*rest)).alias("_all"))
        if not again.isEmpty():
            keyed = df.withColumn("_h", F.xxhash64(id_col))
            again = broadcast_if_small(again)
            own = keyed.join(again, "_h", "left_anti").select(id_col, label, F.array(F.struct(*rest)).alias("_all"))
            several = keyed.join(again, "_h", "left_semi")
            met = several.groupBy(id_col).agg(F.collect_list(F.struct(*rest)).alias("_of"))
            met = met.select(id_col, F.explode("_of").alias("_own"), F.when(F.col(id_col).isNull(), F.filter("_of", lambda x: F.lit(False))).otherwise(F.col("_of")).alias("_all"))
            own = own.unionByName(met.select(id_col, F.col("_own")[label].alias(label), "_all"))
        chunks, path = _stored(_chunked(own.withColumnRenamed(label, "_dealt_by")), "rows_by_chunk")
        rows = chunks.select(F.sum(F.size(id_col))).first()[0] or 0
        joined = chunks.join(_placed(chunks, rows, id_col, ["_dealt_by"], k, repeats, seed), "_chunk").select("_chunk", id_col, "_all", "_places")

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    ids, every = batch.column(1)[i].values, batch.column(2)[i].values
                    many = np.diff(every.offsets.to_numpy())
                    flat = every.flatten()
                    folds = _folds(batch.column(3)[i].as_py(), len(ids), k, repeats)
                    if (many != 1).any():
                        ids, folds = ids.take(pa.array(np.repeat(np.arange(len(ids)), many))), np.repeat(folds, many, axis=1)
                    made = _one_row(batch.column(0)[i].as_py(), {id_col: ids, **{c: x for c, x in zip(rest, flat.flatten(), strict=True)}})
                    blobs = pa.ListArray.from_arrays(pa.array([0, repeats], pa.int32()), pa.array([f.tobytes() for f in folds], pa.binary()))
                    yield made.append_column("_folds", blobs)

        kinds = {f.name: f.dataType for f in df.schema.fields}
        schema = T.StructType([T.StructField("_chunk", T.LongType()), *[T.StructField(c, T.ArrayType(kinds[c])) for c in [id_col, *rest]],
                               T.StructField("_folds", T.ArrayType(T.BinaryType()))])
        self.table, _ = _stored(joined.mapInArrow(run, schema), "folded_chunks")
        _remove(spark, path)
        release(spark)
        self.rows = self.table.select(F.sum(F.size(id_col))).first()[0] or 0

    def over(self, columns: list[str], work, schema):
        """``work`` on an iterator of chunks: ({column: Arrow array}, folds as repetitions x rows)."""
        repeats, kind = self.repeats, "u4" if self.k > NO_FOLD else "u1"

        def run(batches):
            def each() -> Iterator:
                for batch in batches:
                    for i in range(batch.num_rows):
                        folds = np.frombuffer(b"".join(batch.column(len(columns))[i].as_py()), kind).reshape(repeats, -1)
                        yield {c: batch.column(n)[i].values for n, c in enumerate(columns)}, folds
            yield from work(each())

        return self.table.select(*columns, "_folds").mapInArrow(run, schema)

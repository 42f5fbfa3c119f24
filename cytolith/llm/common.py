"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one inner batch of a Python operator holds at most (a longer text is a batch of its own).
BATCH_CHARS = 2_000_000

#: Code points of a block that parts of a text are cut from.
BLOCK = 2048

#: Parts of a table of which a join's key may hold one before it is dealt over several tasks.
SHARES = 1000

#: White space of the word definition, as a character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session may have one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # rows are texts or sets of shingles: fewer go to Python at a time
    rows, cleanup = spark.conf.get(ARROW_ROWS), spark.conf.get(CLEANUP, "false")
    spark.conf.set(ARROW_ROWS, str(min(int(rows), 1000) if int(rows) > 0 else 1000))
    # the shuffles of a written table aren't read again: their files go with the query, not when the driver next frees memory
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
        spark.conf.set(CLEANUP, cleanup)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tables that materialise has written and that are still there.
WRITTEN: list[str] = []


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of materialise that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", shares: int = SHARES) -> DataFrame:
    """left joined with right on a column, of which some values may hold a large part of left's rows.

    A value with more than 1 / shares of left's rows (there are fewer than shares of them, so they are broadcast) is dealt over as many tasks as it has such shares; right's rows with it are repeated for each of them.
    left is read twice: it should be a written table.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    heavy = counts.filter(F.col("n") * shares > total).select(key, F.ceil(F.col("n") * shares / F.lit(float(max(total, 1)))).cast("int").alias("__salts"))
    heavy = materialise(heavy, "heavy") if total > shares else None
    if heavy is None or heavy.isEmpty():
        return left.join(right, key, how)
    salts = F.coalesce("__salts", F.lit(1))
    one = left.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*[c for c, kind in left.dtypes if not kind.startswith("map")]), salts).cast("int")).drop("__salts")
    other = right.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return one.join(other, [key, "__salt"], how).drop("__salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(batches: Iterable[pa.RecordBatch], text: int, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``text`` holds about so many bytes at most; a single row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // chars
        start = 0
        for stop in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop
    tidy()


def tidy() -> None:
    """Give memory that a finished partition has freed back to the system: a worker process lives on, and so would it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative function over an array, in log n rounds over all of it.

    In round k each element takes in the one 2^k before it. Growing an array element by element would copy it each time.
    """

    def rounds(v: Column) -> Column:
        last = F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1
        step = lambda now, k: let(F.call_function("shiftleft", F.lit(1), k), lambda d: F.transform(now, lambda x, i: F.when(i >= d, join(F.get(now, i - d), x)).otherwise(x)))
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), last), v, step))

    return let(values, rounds)


def spans_of(column: Column, regex: str) -> Column:
    """Array of struct(start, end, text) of the leftmost non-overlapping matches of a regex, in code points, end exclusive.

    The matches and the gaps between them come from the same matcher, so the running sum of their lengths gives
    positions without a sentinel in the text. The regex must not match the empty string.
    """

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda t, i: F.length(t) + F.length(F.get(x["gaps"], i)))
        ends = running(lengths, lambda a, b: a + b)
        return F.zip_with(ends, x["found"], lambda e, t: F.struct((e - F.length(t)).alias("start"), e.alias("end"), t.alias("text")))

    return let(F.struct(F.regexp_extract_all(column, F.lit(regex), F.lit(0)).alias("found"), F.split(column, regex, -1).alias("gaps")), placed)


def slices(text: Column, spans: Column) -> Column:
    """Array of the parts of a text at spans (struct with start and end, in code points), in the time it takes to read them.

    A substring is counted from the start of its string: the text is cut into blocks first, and each part from its own.
    """

    def cut(x: Column) -> Column:
        blocks, b = x["blocks"], F.lit(BLOCK)

        def part(s: Column) -> Column:
            at = lambda place: F.floor(place / b).cast("int")
            first, last = at(s["start"]), at(s["end"] - 1)
            own = F.substring(F.get(blocks, first), s["start"] - first * b + 1, s["end"] - s["start"])
            return F.when(s["end"] <= s["start"], "").when(first == last, own).otherwise(
                F.concat(own, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(F.get(blocks, last), F.lit(1), s["end"] - last * b))
            )

        return F.transform(x["spans"], part)

    short = F.transform(spans, lambda s: F.substring(text, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0))))
    return F.when(F.length(text) <= BLOCK, short).otherwise(_by_blocks(text, spans, cut))


def _by_blocks(text: Column, spans: Column, cut: Callable[[Column], Column]) -> Column:
    return let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans")), cut)


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with spans (structs with start and end, sorted by start) replaced by their labels; of overlapping spans the first one is named and all are covered."""

    def done(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def around(r: Column) -> Column:
            before = lambda i: F.coalesce(F.when(i > 0, F.get(r, i - 1)), F.lit(0))
            heads = F.filter(F.transform(s, lambda x, i: F.struct(before(i).alias("from"), x.alias("x"))), lambda h: h["x"]["start"] >= h["from"])
            gaps = F.concat(F.transform(heads, lambda h: F.struct(h["from"].alias("start"), h["x"]["start"].alias("end"))), F.array(F.struct(F.array_max(r).alias("start"), F.length(text).alias("end"))))
            return let(F.struct(slices(text, gaps).alias("gaps"), F.transform(heads, lambda h: label(h["x"])).alias("labels")), lambda p: F.array_join(F.zip_with(p["gaps"], p["labels"], lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), ""))

        return let(reach, around)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, done))


def merged(spans: Column) -> Column:
    """The unions of overlapping spans (structs with start and end, sorted by start), as structs with start and end."""

    def done(s: Column) -> Column:
        def around(r: Column) -> Column:
            begins = lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1))
            places = F.transform(s, lambda x, i: F.struct(begins(i).alias("begins"), x["start"].alias("start"), (begins(i + 1) | (i == F.size(s) - 1)).alias("ends"), F.get(r, i).alias("end")))
            starts, ends = F.filter(places, lambda x: x["begins"]), F.filter(places, lambda x: x["ends"])
            return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"], b["end"]))

        return let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), around)

    return let(spans, done)

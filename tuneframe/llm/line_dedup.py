"""Line dedup: levelled sorted runs of line hashes (native).

The store is a set of runs, tables sorted by a 128-bit hash of the line key.
A batch of documents is reduced to its distinct line hashes and
merge-anti-joined with the runs, which tells new lines from known ones. New
lines are added as a run of level 0, so no two runs share a line; known lines
are counts that are added to their run's row in the end. When a level holds
``fanout`` runs they are merged into one run of the next level, so a corpus
of n batches costs O(n log n) merging and a batch meets O(log n) runs. Runs
live in the shared folder; a lost executor only re-reads them.

A run row says how many documents of its batch hold the line and which
holder has the largest id, a count the same of a later batch. Hashes of equal
lines are combined before every shuffle, so a line in a third of all
documents is one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm.common import ASCII_SPACE, ascii_lower, scratch

MIN_POINTS = 40


def line_keys(text: Column, min_points: int = MIN_POINTS) -> Column:
    """Array aligned with the text's lines: ``(h1, h2)`` of the key, null where it is too short.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    """
    def key(line):
        k = F.btrim(line, F.lit(ASCII_SPACE))
        return F.when(F.char_length(k) >= min_points,
                      F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(41), k).alias("h2")))

    return F.transform(F.split(ascii_lower(text), "\n", -1), key)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))


class LineRuns:
    """Levelled runs of line hashes in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_points: int = MIN_POINTS, path: str | None = None):
        self.spark, self.fanout, self.min_points = spark, fanout, min_points
        self.path = path or scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.counts: list[str] = []
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        path = f"{self.path}/run-{self.made}"
        self.made += 1
        run.write.parquet(path)
        return path

    def _read(self, paths: list[str], fresh: bool) -> DataFrame | None:
        parts = [self.spark.read.parquet(p) for p in paths]
        return reduce(DataFrame.union, parts).filter(F.col("fresh") == fresh).drop("fresh") if parts else None

    def runs(self) -> DataFrame | None:
        """All lines, each in one run: ``h1, h2, holders, newest`` of the batch that brought it."""
        return self._read([p for level in self.levels for p in level], True)

    def hashes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Distinct line hashes of a batch: ``h1, h2, holders, newest``."""
        lines = F.array_distinct(F.filter(line_keys(F.col("text"), self.min_points), lambda k: k.isNotNull()))
        flat = _rows(docs, id_col, text_col).select("id", F.explode(lines).alias("k"))
        return flat.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(
            F.count(F.lit(1)).alias("holders"), F.max("id").alias("newest"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; returns its lines that no earlier batch held: ``h1, h2, holders, newest``.

        Whether a run holds a line decides where it goes: new lines are the
        batch's run, known ones its counts.
        """
        batch = self.hashes(docs, id_col, text_col)
        known = self.runs()
        if known is None:
            batch = batch.withColumn("fresh", F.lit(True))
        else:
            seen = known.select("h1", "h2", F.lit(True).alias("_seen"))
            batch = batch.join(seen, ["h1", "h2"], "left").withColumn("fresh", F.col("_seen").isNull()).drop("_seen")
        path = self._write(batch.sortWithinPartitions("h1", "h2"))
        if known is not None:
            self.counts.append(path)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(path)
        self.compact()
        return self._read([path], True)

    def compact(self) -> None:
        """Merge every level that is full into a run of the next one."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                rows = self._read(self.levels[k], True).withColumn("fresh", F.lit(True))
                self.levels[k + 1].append(self._write(rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2")))
                self.levels[k] = []
            k += 1

    def frequent(self, min_holders: int) -> DataFrame:
        """Lines held by at least ``min_holders`` documents: ``h1, h2, newest``."""
        lines, counts = self.runs(), self._read(self.counts, False)
        if lines is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, newest long")
        if counts is not None:
            more = counts.groupBy("h1", "h2").agg(F.sum("holders").alias("_more"), F.max("newest").alias("_newer"))
            lines = lines.join(more, ["h1", "h2"], "left").withColumn("holders", F.col("holders") + F.coalesce("_more", F.lit(0)))
            lines = lines.withColumn("newest", F.greatest("newest", "_newer"))
        often = lines.filter(F.col("holders") >= min_holders).select("h1", "h2", "newest")
        path = f"{self.path}/often"
        often.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def batches(docs: DataFrame, count: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` in ``count`` batches, dealt by a hash of the id."""
    deal = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(count))
    return [docs.filter(deal == k) for k in range(count)]


def dedup_lines(docs: DataFrame, min_holders: int = 5, min_points: int = MIN_POINTS, batch_count: int = 4,
                fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False,
                parts: list[DataFrame] | None = None) -> DataFrame:
    """Drop lines whose key is held by ``min_holders`` documents, except in the holder with the largest id.

    Returns ``id, text, n_lines, n_dropped``, or with ``keep_columns`` the
    columns of ``docs`` with the new text and the two counts, whose names get
    underscores behind them while ``docs`` has such columns. Texts split at
    line feeds; a null or empty text is one empty line; a text that loses
    all its lines is empty. Keys under ``min_points`` code points stay.
    Repeated rows are documents of their own; if they hold the largest id
    all of them keep the line. A null id is smaller than any other.
    Columns of ``docs`` may have any names. Empty tables give no rows.
    ``docs`` is read once a batch and once more, so it should be cheap or
    written, and give the same rows each time. ``parts`` are batches that
    hold the rows of ``docs``, each row in one, such as one per input file.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, fanout, min_points)
    for part in parts or batches(docs, batch_count, id_col):
        store.add(part, id_col, text_col)
    often = store.frequent(min_holders)

    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_columns else F.lit(0).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A row is known by its id and its text; equal rows lose the same lines.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"), every)
    keys = line_keys(F.col("text"), min_points)
    held = rows.select("id", "t", F.posexplode(keys).alias("pos", "k")).filter("k is not null")
    held = held.select("id", "t", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    gone = held.join(often, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("newest")))
    gone = gone.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    out = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.t") == F.col("g.t")), "left")
    out = out.select("r.id", "r.text", "r.row", F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))
    lines = F.split("text", "\n", -1)
    out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.size("gone").cast("long"))

    # What stays lies between two dropped lines: slices of the text, in time linear in its lines.
    def between(k):
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
        end = F.coalesce(F.get("gone", k), F.size("_lines"))
        return F.slice("_lines", start + 1, end - start)

    out = out.withColumn("_lines", lines)
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), between))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(pieces, "\n"))
    if not keep_columns:
        return out.select("id", kept.alias("text"), "n_lines", "n_dropped")
    cols = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols, *[F.col(c).alias(_free_name(c, docs.columns)) for c in ("n_lines", "n_dropped")])


def _free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name

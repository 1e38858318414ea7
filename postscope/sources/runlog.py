"""The text run log as a table (the reference only writes it).

Line format ``<asctime> <LEVEL>:<message>``; the messages below are the
ones a run writes for actions and skips.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ranking import spread

# fixed values: line layout and the run's messages (placeholders in braces)
LINE = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) ([A-Z]+):(.*)$"
# a record starts at a line with a time and a level; other lines continue it
RECORD_START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} [A-Z]+:"
ASCTIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
MESSAGES = [
    # event, first words, pattern, its groups
    ("liked", "Liked post ", r"(?s)^Liked post (\S+) \(hashtag: (.*)\) \| Link: (\S*)\s*$", ("media_id", "hashtag", "link")),
    ("commented", "Commented on post ", r"(?s)^Commented on post (\S+): (.*) \| Link: (\S*)\s*$", ("media_id", "detail", "link")),
    ("like_failed", "Failed to like post ", r"(?s)^Failed to like post (\S+): (.*)$", ("media_id", "detail")),
    ("comment_failed", "Failed to comment on post ", r"(?s)^Failed to comment on post (\S+): (.*)$", ("media_id", "detail")),
    ("skipped_keyword", "Skipped post ",
     r"^Skipped post (\S+) due to 'giveaway' in caption or hashtags\. \| Link: (\S*)\s*$", ("media_id", "link")),
    ("skipped_avoid", "Skipped commenting on post ",
     r"^Skipped commenting on post (\S+) due to avoid hashtag in hashtags\. \| Link: (\S*)\s*$", ("media_id", "link")),
    ("skipped_sensitive", "Skipped commenting on post ",
     r"^Skipped commenting on post (\S+) due to sensitive image\. \| Link: (\S*)\s*$", ("media_id", "link")),
]
FIELDS = ("media_id", "hashtag", "link", "detail")
NONE_TEXT = "None"


def parse_run_log(records: DataFrame, value: str = "value") -> DataFrame:
    """Records -> ``(log_time, level, event, media_id, hashtag, link, detail, raw)`` plus their other columns.

    The line's three parts are cut once; the message's first words choose the
    patterns to try.  A record that does not fit the layout keeps its text in
    ``raw`` with null fields; an unknown message gets ``event = 'other'`` and
    the message as ``detail``.
    """
    rest = [c for c in records.columns if c != value]
    v = F.col(value)
    part = [F.regexp_extract(v, LINE, i) for i in (1, 2, 3)]
    cut = spread(records).select(*rest, v.alias("raw"), part[0].alias("_t"), part[1].alias("_l"), part[2].alias("_m"))
    # per message: its groups as an array, empty if it is another message
    def groups(start: str, pattern: str, n: int) -> Column:
        return F.when(F.col("_m").startswith(start), F.array(*[F.regexp_extract("_m", pattern, i) for i in range(1, n + 1)]))
    tried = cut.select("*", *[groups(s, p, len(g)).alias(f"_g_{e}") for e, s, p, g in MESSAGES])
    event: Column = F.lit("other")
    fields: dict[str, Column] = {f: F.lit(None).cast("string") for f in FIELDS}
    for name, _, _, names in reversed(MESSAGES):
        g = F.col(f"_g_{name}")
        hit = F.coalesce(g[0] != "", F.lit(False))
        event = F.when(hit, F.lit(name)).otherwise(event)
        for i, n in enumerate(names):
            fields[n] = F.when(hit, g[i]).otherwise(fields[n])
    ok = F.col("_t") != ""
    named = tried.select(*rest, "raw", F.when(ok, F.col("_t")).alias("log_time"), F.when(ok, F.col("_l")).alias("level"),
                         F.when(ok, event).alias("event"), *[F.when(ok, fields[f]).alias(f) for f in FIELDS], "_m")
    return named.select(*rest, "log_time", "level", "event", "media_id",
                        F.when(F.col("hashtag") != NONE_TEXT, F.col("hashtag")).alias("hashtag"), "link",
                        F.when(F.col("event") == "other", F.col("_m")).otherwise(F.col("detail")).alias("detail"), "raw")


_PIECE = "path string, file string, block long, place long, begins boolean, ends boolean, value string"


def _pieces(batches):
    """Lines of file blocks, in order -> pieces of records.

    ``begins``: the piece starts with a record's first line; ``ends``: the next
    record begins in the same block, so nothing more belongs to it.
    """
    now, held, place = None, [], 0            # (path, file, block), lines of the piece at hand

    def rows(values, begins, ends):
        nonlocal place
        n = len(values)
        start, place = place, place + n
        cols = [pa.array([x] * n, t) for x, t in zip(now, (pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(range(start + 1, start + n + 1), pa.int64()), pa.array(begins, pa.bool_()), pa.array(ends, pa.bool_()),
             values if isinstance(values, pa.Array) else pa.array(values, pa.string())],
            names=["path", "file", "block", "place", "begins", "ends", "value"])

    def begun() -> bool:
        return re.match(RECORD_START, held[0] or "") is not None

    for b in batches:
        if not b.num_rows:
            continue
        path, file, block, lines = b.column(0), b.column(1), b.column(2), b.column(3)
        key = block.to_numpy()
        codes = path.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(codes) != 0)) + 1
        starts = pc.match_substring_regex(lines, RECORD_START).to_numpy(zero_copy_only=False)
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            here = (path[s].as_py(), file[s].as_py(), int(key[s]))
            if here != now:
                if held:
                    yield rows(["\n".join(held)], [begun()], [False])
                now, held, place = here, [], 0
            at = s + np.flatnonzero(starts[s:e])
            if not len(at):
                held += lines[s:e].to_pylist()
                continue
            held += lines[s:int(at[0])].to_pylist()
            if held:
                yield rows(["\n".join(held)], [begun()], [True])
            if len(at) > 1:         # records that lie in this batch
                runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), lines)
                whole = pc.binary_join(runs, "\n")
                yield rows(whole, [True] * len(whole), [True] * len(whole))
            held = lines[int(at[-1]):e].to_pylist()
    if held:
        yield rows(["\n".join(held)], [begun()], [False])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Log files -> ``(file, record, value)``, one row per record, its lines joined.

    Files are read in blocks by many tasks (Spark's line reader; compressed
    files are one block).  A record that runs over the end of its block is
    joined again: a block's first lines, up to its first record, belong to the
    last record begun in the blocks before it.  Only those ends are shuffled,
    one or two pieces per block.  ``record`` grows along its file: the block's
    first byte plus the place in the block, so 1, 2, 3 ... in a file of one
    block.  Lines before a file's first record form one of their own; line ends
    at the end of a record are dropped, and so are records without text.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = lines.mapInArrow(_pieces, _PIECE)
    number = F.col("block") + F.col("place")
    whole = pieces.filter("begins and ends").select("file", number.alias("record"), "value")
    edges = pieces.filter("not (begins and ends)")
    # the record a piece belongs to: how many records were cut by a block's end before it
    w = Window.partitionBy("path").orderBy("block", "place")
    edges = edges.withColumn("cut", F.sum(F.col("begins").cast("long")).over(w))
    joined = (edges.groupBy("path", "file", "cut").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("p"))
              .select("file", (F.col("p")[0]["block"] + F.col("p")[0]["place"]).alias("record"),
                      F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))
    return (whole.unionByName(joined).withColumn("value", F.rtrim("value", F.lit("\r\n"))).filter(F.col("value") != ""))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files of any size -> parsed records with ``file`` and ``record`` (its place in the file, ascending)."""
    return parse_run_log(read_records(spark, path))


def render_action_lines(actions: DataFrame) -> DataFrame:
    """Log lines for logged actions, in the run's wording (fixtures, replays)."""
    t = F.date_format("ts", ASCTIME_FORMAT)
    tag = F.coalesce("hashtag", F.lit(NONE_TEXT))
    post = F.col("media_id")
    link = F.concat(F.lit(" | Link: "), F.col("post_link"))
    # a skip is no logged action: views stand for the posts a run passed over
    skip = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("Skipped post "), post, F.lit(" due to 'giveaway' in caption or hashtags."), link))
            .when(F.col("id") % 3 == 1, F.concat(F.lit("Skipped commenting on post "), post, F.lit(" due to avoid hashtag in hashtags."), link))
            .otherwise(F.concat(F.lit("Skipped commenting on post "), post, F.lit(" due to sensitive image."), link)))
    # one comment in five holds a line break
    comment = F.when(F.col("id") % 5 == 0, F.concat("comment", F.lit("\nsecond line"))).otherwise(F.col("comment"))
    msg = (F.when(F.col("event_type") == "view", skip)
           .when(F.col("action_type") == "like", F.concat(F.lit("Liked post "), post, F.lit(" (hashtag: "), tag, F.lit(")"), link))
           .when(F.col("action_type") == "comment", F.concat(F.lit("Commented on post "), post, F.lit(": "), comment, link))
           .when(F.col("id") % 2 == 1, F.concat(F.lit("Failed to like post "), post, F.lit(": "), F.col("error")))
           .otherwise(F.concat(F.lit("Failed to comment on post "), post, F.lit(": "), F.col("error"))))
    level = F.when(F.col("action_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    return actions.select("id", F.concat(t, F.lit(" "), level, F.lit(":"), msg).alias("value"))

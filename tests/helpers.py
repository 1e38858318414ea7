from datetime import datetime

from pyspark.sql import functions as F

from postscope.functions.timefmt import iso_text
from postscope.schemas import ACTIONS


def make_actions(spark, recs):
    """recs: (id, ts 'YYYY-mm-dd HH:MM:SS[.ffffff]', action_type, hashtag[, account, media_id])."""
    data = []
    for r in recs:
        rid, ts, typ, tag = r[:4]
        account = r[4] if len(r) > 4 else "acct"
        media = r[5] if len(r) > 5 else f"m{rid}"
        fmt = "%Y-%m-%d %H:%M:%S.%f" if "." in ts else "%Y-%m-%d %H:%M:%S"
        data.append((rid, "", datetime.strptime(ts, fmt), account, typ, media, tag,
                     None, "boom" if typ == "error" else None, None))
    df = spark.createDataFrame(data, ACTIONS)
    # the log's text form: isoformat() omits a zero fraction
    text = F.when(F.date_format("ts", "SSSSSS") == "000000", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(iso_text("ts"))
    return df.withColumn("timestamp", text).withColumn("date", F.to_date("ts"))


def plan_text(df) -> str:
    """The physical plan as ``df.explain()`` prints it (after an action: as it ran)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()

"""Cleaning and time rules of contributions, requests, answers and mailings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIONS = ("bestaetigt", "verworfen", "neu", "nachgezogen")
CLASSES = ("gartenhaus", "pool", "baum", "carport_garage", "hecke")


def contribution_fault(df: DataFrame, tile_m: float = 1000.0) -> Column:
    """First reason why a contribution (aktion, klasse, kachel, geometrie as [x, y] corners) is refused, or null."""
    first = F.get("geometrie", F.lit(0))
    tile = F.concat(F.floor(first[0] / tile_m).cast("long").cast("string"), F.lit("_"), F.floor(first[1] / tile_m).cast("long").cast("string"))
    return (
        F.when(~F.coalesce(F.col("aktion").isin(*ACTIONS), F.lit(False)), "action")
        .when(~F.coalesce(F.col("klasse").isin(*CLASSES), F.lit(False)), "class")
        .when(~F.coalesce(F.col("kachel").rlike(r"^\d{3}_\d{4}$"), F.lit(False)), "tile")
        .when((F.size("geometrie") < 3) | (F.size("geometrie") > 64), "points")
        .when(~F.forall("geometrie", lambda p: (F.abs(p[0] - first[0]) <= 400) & (F.abs(p[1] - first[1]) <= 400)), "extent")
        .when(F.col("kachel") != tile, "other_tile")
    )


def clean_contribution(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with corners rounded to 0.1 and no other fields, refused with reason)."""
    d = df.withColumn("reason", contribution_fault(df))
    corners = F.transform("geometrie", lambda p: F.transform(p, lambda v: F.round(v, 1)))
    return d.filter("reason IS NULL").select("id", "aktion", "klasse", corners.alias("geometrie"), "kachel"), d.filter("reason IS NOT NULL").select("id", "reason")


def request_fault(box: tuple[float, float, float, float]) -> Column:
    """First reason why a request (klasse, punkte) is refused, or null."""
    x1, y1, x2, y2 = box
    xs, ys = F.transform("punkte", lambda p: p[0]), F.transform("punkte", lambda p: p[1])
    return (
        F.when(~F.coalesce(F.col("klasse").isin(*CLASSES), F.lit(False)), "class")
        .when((F.size("punkte") < 1) | (F.size("punkte") > 200), "points")
        .when(~F.forall("punkte", lambda p: p[0].between(x1, x2) & p[1].between(y1, y2)), "area")
        .when((F.array_max(xs) - F.array_min(xs) > 400) | (F.array_max(ys) - F.array_min(ys) > 400), "extent")
    )


def validity_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails; null if usable."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def campaign_eligibility(recipients: DataFrame, unsubscribed: DataFrame, today: str, wait: int, cap: int) -> DataFrame:
    """(id, reason): why a recipient gets no mail now, by precedence; those left are capped in the order of id."""
    day = F.lit(today).cast("date")
    r = recipients.join(unsubscribed.select("id", F.lit(True).alias("gone")), "id", "left")
    reason = (
        F.when(F.col("gone"), "unsubscribed")
        .when(F.col("freigabe") != "ja", "not_released")
        .when(~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "bad_address")
        .when(F.datediff(day, "gesendet") < wait, "too_soon")
    )
    r = r.withColumn("reason", reason)
    ok = r.filter("reason IS NULL").orderBy("id").limit(cap).select("id", F.lit("send").alias("reason"))
    late = r.filter("reason IS NULL").join(ok.select("id"), "id", "left_anti").select("id", F.lit("over_cap").alias("reason"))
    return r.filter("reason IS NOT NULL").select("id", "reason").unionByName(ok).unionByName(late)


def next_in_window(start: int | None, n: int, at: int, span: int) -> tuple[int, int]:
    """Start of the window that a request falls into, and its number there: a window begins with a request and holds what comes up to ``span`` later."""
    return (start, n + 1) if start is not None and at - start <= span else (at, 1)


def limit_requests(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """(client, event_id, ts, start, nth, refused) of every request: a client's window starts at its first request, and the next with the first one over ``seconds`` later.

    Within a window the first ``most`` pass. Requests of a client are gone through in the order of ts, then event_id, as a
    stream of constant memory; those without ts are dropped.
    """
    kind = dict(requests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, start, n = None, None, 0
        for batch in batches:
            starts, numbers = [], []
            for who, at in zip(batch.column("client").to_pylist(), batch.column("at").to_pylist()):  # noqa: B905
                if who != client:
                    client, start, n = who, None, 0
                start, n = next_in_window(start, n, at, seconds * 1_000_000)
                starts.append(start)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("event_id"), batch.column("at"), pa.array(starts, pa.int64()), pa.array(numbers, pa.int64())], names=["client", "event_id", "at", "from", "nth"])

    rows = requests.filter("ts IS NOT NULL").select("client", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    dealt = rows.repartition("client").sortWithinPartitions("client", "at", "event_id")
    out = dealt.mapInArrow(run, f"client {kind['client']}, event_id {kind['event_id']}, at long, from long, nth long")
    return out.select("client", "event_id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("from").alias("start"), "nth", (F.col("nth") > most).alias("refused"))


def rate_limit(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests of each client and window, and how many are refused; windows start with a request, as ``limit_requests`` says."""
    each = limit_requests(requests, seconds, most)
    return each.groupBy("client", "start").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))


def accept_answers(answers: DataFrame, revocations: DataFrame, grace_h: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, link, status): expired after the end of the link's last day and the grace, revoked, or accepted.

    A link's first revocation counts, however often it is revoked.
    """
    a = answers.join(revocations.groupBy("link").agg(F.min("revoked_at").alias("revoked_at")), "link", "left")
    end = F.date_add("bis", 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {grace_h} HOURS")
    status = F.when(F.col("ts") >= end, "expired").when(F.col("ts") > F.col("revoked_at"), "revoked").otherwise("accepted")
    return a.select("event_id", "link", *keep, status.alias("status"))


def answer_counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("antwort") == "passt").alias("fits"), F.min("ts").alias("first"), F.max("ts").alias("last")]


def answers_by_link(answers: DataFrame) -> DataFrame:
    return answers.groupBy("link").agg(*answer_counts())


def sum_days(days: DataFrame) -> DataFrame:
    """Counts of each link from those of its days."""
    return days.groupBy("link").agg(F.sum("n").alias("n"), F.sum("fits").alias("fits"), F.min("first").alias("first"), F.max("last").alias("last"))


def retention(answers: DataFrame, now: str, days: int = 400) -> DataFrame:
    return answers.filter(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def revoke_and_purge(answers: DataFrame, revocations: DataFrame) -> DataFrame:
    """Answers without those of revoked links; the first revocation of a link counts."""
    return answers.join(revocations.groupBy("link").agg(F.min("revoked_at").alias("at")), "link", "left_anti")


def windows_around(requests: DataFrame, *keep: str) -> DataFrame:
    """(client, wx, wy, far) of the nine windows round each request's."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return requests.withColumn("s", step).select("client", (F.col("wx") + F.col("s.i")).alias("wx"), (F.col("wy") + F.col("s.j")).alias("wy"), F.expr("abs(s.i) + abs(s.j)").alias("far"), *keep)


def prepare_windows(requests: DataFrame, ready: DataFrame) -> DataFrame:
    """Windows (wx, wy) round each request's, without those ready, each once, nearest first for each client."""
    w = windows_around(requests).groupBy("client", "wx", "wy").agg(F.min("far").alias("far")).join(ready, ["wx", "wy"], "left_anti")
    return w.withColumn("place", F.row_number().over(W.partitionBy("client").orderBy("far", "wx", "wy")))


def activity(events: DataFrame, kind: str) -> DataFrame:
    """(kind, key, start, n): counts of each action in tumbling or sliding hours, or of each client in sessions of a quarter hour of quiet."""
    if kind == "session":
        key, window = F.col("client").cast("string"), F.session_window("ts", "15 minutes")
    else:
        key, window = F.col("action"), F.window("ts", "1 hour") if kind == "tumbling" else F.window("ts", "2 hours", "1 hour")
    n = events.groupBy(window.alias("w"), key.alias("key")).agg(F.count("*").alias("n"))
    return n.select(F.lit(kind).alias("kind"), "key", F.col("w.start").alias("start"), "n")


def activity_windows(events: DataFrame) -> DataFrame:
    """All three kinds of ``activity``."""
    return activity(events, "tumbling").unionByName(activity(events, "sliding")).unionByName(activity(events, "session"))


def fresh_contributions(log: DataFrame, done: DataFrame) -> DataFrame:
    """The first entry of each id that is not done; a drawn one without a candidate (no result) is tried again."""
    first = log.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("ts", "event_id"))).filter("nth = 1").drop("nth")
    return first.join(done.filter("result IS NOT NULL").select("id"), "id", "left_anti")

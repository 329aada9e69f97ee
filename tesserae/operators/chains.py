"""The write path of single-valued keys as a set operation: chains of writes, scanned over range partitions.

``store.remember`` folds a scope write by write. Where a key has one value at a time and equal contents are the only
duplicates, what a write does follows from two facts about the writes before it, the last one that set the key
and the first one of all. Both are scans that merge associatively, so no task holds a scope or a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import prefix
from tesserae.session import settled

#: Fixed value: the confidence from which a write replaces what is held without being told to.
SURE = 0.8
BY = ["owner", "agent", "key"]
#: Order of the writes of a chain; the columns after id decide between rows with one seq and id.
ORDER = ["seq", "id", "same", "begins", "confidence", "sure"]


def writes(rows: DataFrame) -> DataFrame:
    """Rows (owner, agent, key, seq, id, content, confidence; start, at, action where there are such) as writes with ``outcome``.

    outcome: ``added`` or ``refreshed`` (the key's active content is none, or this one), ``replaced`` (it ends the active one) or
    ``conflicted`` (unsure and of another content). ``prior`` and ``since``: the active content before the write, and from
    when it holds. Contents are the same if they are equal in lower case with white space squeezed. Sure is a write with the action
    SUPERSEDE, or with none and a confidence of SURE. Rows without owner, agent, key, seq, id or content (or with a blank one)
    write nothing; a missing confidence is 0, a missing moment (at, else start) is 0. Repeated rows are writes of their own.
    """
    kinds = {"start": "long", "at": "long", "action": "string"}
    rows = rows.withColumns({c: F.col(c).cast(k) if c in rows.columns else F.lit(None).cast(k) for c, k in kinds.items()})
    content, confidence = t.normalize_content(F.col("content"), already_nfkc=True), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    at = F.coalesce("at", "start", F.lit(0))
    told = rows.select(
        *BY, F.col("seq").cast("long").alias("seq"), "id", content.alias("content"), F.lower(content).alias("same"), confidence.alias("confidence"), at.alias("at"),
        F.coalesce("start", at).alias("begins"), F.coalesce((F.col("action") == "SUPERSEDE") | (F.col("action").isNull() & (confidence >= SURE)), F.lit(False)).alias("sure"),
    )
    told = told.filter(" and ".join(f"{c} is not null" for c in (*BY, "seq", "id")) + " and content <> ''")
    ranged = prefix.by_ranges(told, BY, [F.col(c) for c in ORDER])
    # The first write of a chain sets its key however unsure it is; later only sure ones do.
    placed = prefix.last_before(ranged, BY, ORDER, {"set_": F.when(F.col("sure"), F.col("same"))}, firsts={"first_": F.col("same")})
    prior = F.coalesce("set_", "first_")
    kind = F.when(prior.isNull(), "added").when(prior == F.col("same"), "refreshed").when(F.col("sure"), "replaced").otherwise("conflicted")
    placed = placed.select(*told.columns, prefix.PART, prior.alias("prior"), kind.alias("outcome"))
    # Between two settings of a key only writes of the active content move its start, so the last such write before has it.
    return prefix.last_before(placed, BY, ORDER, {"since": F.when(F.col("outcome") != "conflicted", F.col("begins"))}).drop(prefix.PART)


def state(written: DataFrame) -> DataFrame:
    """The memories after ``writes``: a row for each owner, agent, key and content, with the id and wording of its first write.

    confidence is the greatest of its writes, start the last one's; status active, superseded or conflicted; stop is when it was last
    ended (null while active), supersedes the id of what it ended last, updated the moment of the last write that changed it,
    n_writes how many there were.
    """
    order = F.struct(*ORDER)
    kinds = {"own": _kind(written, order), "end": _kind(written, order), "id": written.schema["id"].dataType, "at": "long", "content": "string", "confidence": "double",
             "begins": "long", "outcome": "string", "ended": "string", "stop": "long"}

    def act(same: str, **fields: Column) -> Column:
        """What a write does to a memory; what it says nothing of is null."""
        return F.struct(F.col(same).alias("same"), *[fields.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    told = {c: F.col(c) for c in ("id", "at", "content", "confidence", "begins", "outcome")}
    own = act("same", own=order, ended=F.when(F.col("outcome") == "replaced", F.col("prior")), **told)
    end = F.when(F.col("outcome") == "replaced", act("prior", end=order, at=F.col("at"), stop=F.greatest(F.col("begins"), F.col("since") + 1)))
    # Both in one pass, so that the scans behind ``written`` run once.
    acts = written.select(*BY, F.explode(F.array_compact(F.array(own, end))).alias("act_")).select(*BY, "act_.*")
    first, last = (lambda c: F.min_by(c, "own")), (lambda c: F.max_by(c, "own"))
    rows = acts.groupBy(*BY, "same").agg(
        first("id").alias("id"), first("content").alias("content"), F.max("confidence").alias("confidence"), last("begins").alias("start"), last("outcome").alias("outcome"),
        F.max("own").alias("own"), F.max("end").alias("end"), last("at").alias("written"), F.max_by("at", "end").alias("ended_at"), F.max_by("stop", "end").alias("stop"),
        F.max_by("ended", F.when(F.col("ended").isNotNull(), F.col("own"))).alias("ended"), F.count("own").alias("n_writes"),
    )
    over = F.coalesce(F.col("end") > F.col("own"), F.lit(False))
    status = F.when(over, "superseded").when(F.col("outcome") == "conflicted", "conflicted").otherwise("active")
    rows = rows.select(*BY, "same", "id", "content", "confidence", "start", status.alias("status"), F.when(status != "active", F.col("stop")).alias("stop"), "ended",
                       F.when(over, F.col("ended_at")).otherwise(F.col("written")).alias("updated"), "n_writes")
    rows = settled(rows)
    # What was ended is named by its own row's id: the larger side stays on the left, where a hot key can be split.
    named = rows.select(*BY, F.col("same").alias("ended"), F.col("id").alias("supersedes"))
    return rows.join(named, [*BY, "ended"], "left").select(*BY, "id", "content", "confidence", "start", "status", "stop", "supersedes", "updated", "n_writes")


def _kind(rows: DataFrame, column: Column):
    """The type of a column of ``rows``."""
    return rows.select(column.alias("c_")).schema["c_"].dataType

"""Writing memories: the ordered fold of remember, reconciliation of two stores, rollup maintenance and feedback."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions import vector
from tesserae.functions.regex import ascii_borders

_WORD, _HAN = re.compile("[a-z0-9]+"), re.compile("[㐀-鿿]")
#: Predicates that a value follows, and wordings of a dislike and a liking.
_PREDICATE = re.compile(r"(?:不喜欢|讨厌|喜欢|偏爱|偏好|姓名|名字|所在地|职业)\s*(.+)$")
_DISLIKE, _LIKING = (re.compile(ascii_borders(p), re.I) for p in (r"不喜欢|讨厌|\bdislike\b|\bhate\b", r"喜欢|偏爱|偏好|\bprefer\b|\blike\b"))


def _tokens(text: str) -> frozenset[str]:
    """``functions.text.bm25_tokens`` of one text, as a set."""
    text = unicodedata.normalize("NFKC", text).lower()
    han = _HAN.findall(text)
    return frozenset([f"w:{w}" for w in _WORD.findall(text)] + [f"c:{c}" for c in han] + [f"b:{a}{b}" for a, b in itertools.pairwise(han)])


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / max(1, len(a | b)) if a or b else 1.0


def _value(content: str) -> str:
    """What follows the last colon; without one what follows a predicate, else the content."""
    cut = max(content.rfind("："), content.rfind(":"))
    if cut >= 0:
        return content[cut + 1 :].strip()
    found = _PREDICATE.search(content)
    return found[1].strip() if found and found[1].strip() else content


class _Row:
    """A memory in the fold, with what is compared of it."""

    def __init__(self, place: int, fields: dict) -> None:
        self.place, self.fields = place, fields
        self.describe()

    def describe(self) -> None:
        content = self.fields["content"]
        self.same, self.tokens, self.value = content.lower(), _tokens(content), _tokens(_value(content))
        self.polarity = -1 if _DISLIKE.search(content) else 1 if _LIKING.search(content) else 0
        self.vector = vector.embed_text(content)

    @property
    def active(self) -> bool:
        return self.fields["status"] == "active"

    def says_the_same(self, old: _Row) -> bool:
        """Near-duplicates: of one kind, and for one key nearly equal, else of one polarity and alike in value or as a whole."""
        kinds = (self.fields["kind"], old.fields["kind"])
        if all(kinds) and kinds[0] != kinds[1]:
            return False
        values, near = _jaccard(self.value, old.value), float(self.vector @ old.vector)
        if self.fields["key"] and self.fields["key"] == old.fields["key"]:
            return near >= 0.95 and values >= 0.6
        return self.polarity == old.polarity and (values >= 0.5 or (near >= 0.94 and _jaccard(self.tokens, old.tokens) >= 0.2))


class _Scope:
    """The rows of one scope with their indexes: by content, by key and, for active rows, by kind and token."""

    def __init__(self) -> None:
        self.rows: list[_Row] = []
        self.by_content: dict[str, list[_Row]] = {}
        self.by_key: dict[str, list[_Row]] = {}
        self.by_token: dict[tuple, dict[int, _Row]] = {}

    def put(self, row: _Row, fresh: bool = True) -> None:
        if fresh:
            self.rows.append(row)
            self.by_content.setdefault(row.same, []).append(row)
        if row.fields["key"] and row not in self.by_key.setdefault(row.fields["key"], []):
            self.by_key[row.fields["key"]].append(row)
        if row.active:
            for token in row.tokens:
                for kind in {None, row.fields["kind"]}:
                    self.by_token.setdefault((kind, token), {})[row.place] = row

    def unlist(self, row: _Row) -> None:
        for token in row.tokens:
            for kind in {None, row.fields["kind"]}:
                self.by_token.get((kind, token), {}).pop(row.place, None)

    def duplicate_of(self, row: _Row) -> _Row | None:
        """The row to merge into: the one named for refinement, the first of equal content, or the first near-duplicate
        among the active rows of the key, or without a key of the three rarest tokens of its kind."""
        f = row.fields
        if f["action"] == "REFINE" and f["matched"] and (named := next((r for r in self.rows if r.fields["id"] == f["matched"]), None)):
            return named
        if equal := self.by_content.get(row.same):
            return equal[0]
        if f["key"]:
            found = [r for r in self.by_key.get(f["key"], []) if r.active]
        else:
            listed = sorted((self.by_token[k] for t in sorted(row.tokens) if (k := (f["kind"], t)) in self.by_token and self.by_token[k]), key=len)
            found = {p: r for rows in listed[:3] for p, r in rows.items()}.values()
        return next((r for r in sorted(found, key=lambda r: r.place) if row.says_the_same(r)), None)

    def write(self, row: _Row) -> None:
        f = row.fields
        single = bool(f["key"]) and f["cardinality"] == "single"
        begins = f["start"] if f["start"] is not None else f["at"] if single else None
        closed = f["stop"] is not None and f["stop"] <= f["at"]
        old = self.duplicate_of(row)
        f["status"] = "superseded" if closed else "active"
        others = [r for r in self.by_key.get(f["key"], []) if r.active and r is not old and r.same != row.same] if single and not closed else []
        if others and (f["action"] == "SUPERSEDE" or (f["action"] is None and f["confidence"] >= 0.8)):
            since = lambda r: r.fields["start"] if r.fields["start"] is not None else r.fields["at"]
            f["supersedes"] = max(others, key=lambda r: (since(r), r.fields["at"], -r.place)).fields["id"]
            for r in others:
                self.unlist(r)
                r.fields |= {"status": "superseded", "stop": max(begins, since(r) + 1), "updated": f["at"]}
        elif others:
            f["status"] = "conflicted"
        if old is None:
            f |= {"start": begins, "updated": f["at"]}
            self.put(row)
            return
        self.unlist(old)
        kept = old.fields
        if f["action"] == "REFINE" and row.same != old.same:
            self.by_content[old.same].remove(old)
            kept["content"] = f["content"]
            old.describe()
            self.by_content.setdefault(old.same, []).append(old)
        kept |= {"confidence": max(kept["confidence"], f["confidence"]), "status": f["status"], "updated": f["at"]}
        kept["sources"] = list(dict.fromkeys([*(kept["sources"] if kept["sources"] is not None else []), *(f["sources"] if f["sources"] is not None else [])]))
        kept |= {name: new for name, new in (("start", begins), ("key", f["key"]), ("supersedes", f["supersedes"])) if new is not None}
        if f["stop"] is not None or old.active:
            kept["stop"] = f["stop"]
        self.put(old, fresh=False)

    def pruned(self, capacity: int | None) -> list[_Row]:
        if capacity is None:
            return self.rows
        newest = sorted(self.rows, key=lambda r: (r.active, r.fields["updated"], r.fields["at"], r.place), reverse=True)[: max(1, capacity)]
        return sorted(newest, key=lambda r: r.place)


MEMORY = (
    "owner string, agent string, seq long, id string, key string, kind string, content string, confidence double, cardinality string, "
    "start long, status string, stop long, supersedes string, at long, updated long, action string, matched string, sources array<string>"
)


def remember(incoming: DataFrame, existing: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """State after writing ``incoming`` rows in order of seq, scope (owner, agent) by scope; rows have the columns of MEMORY.

    incoming: owner, agent, seq, id, key (null: none), kind, content, confidence, cardinality, start; and, where it has them,
    stop, at (the moment of the write; else start), action (the verifier's), matched (what it refines) and sources.

    Each row in turn is merged into a duplicate, or ends the active rows of a single-valued key (if told to, or
    sure where nothing is told; else it is put aside as conflicted) and is added. What is known to be over
    already conflicts with nothing. With a capacity the newest rows stay, active ones first, after each write.
    The fold is sequential by nature; a task folds one scope, and a row meets only rows of its key or of its
    three rarest tokens.
    """
    columns = [c.split()[0] for c in MEMORY.split(", ")]
    kinds = dict(c.split() for c in MEMORY.split(", "))
    filled = lambda df: df.select(*[F.col(c).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    new = filled(incoming).withColumns({"status": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("string"), "at": F.coalesce("at", "start", F.lit(0))})
    rows = new if existing is None else filled(existing).withColumns({"at": F.coalesce("at", "start", F.lit(0)), "updated": F.coalesce("updated", "at", "start", F.lit(0))}).unionByName(new)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        scope = _Scope()
        for place, fields in enumerate(part.sort_values(["seq", "id"]).to_dict("records")):
            fields = {k: v if k == "sources" else None if pd.isna(v) else v for k, v in fields.items()}
            fields["content"] = re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]+", " ", unicodedata.normalize("NFKC", fields["content"] or ""))).strip()[:1000]
            if not fields["content"]:
                continue
            if fields["status"] is not None:
                scope.put(_Row(place, fields))
                continue
            scope.write(_Row(place, fields))
            if capacity is not None and len(scope.rows) > max(1, capacity):
                kept, scope = scope.pruned(capacity), _Scope()
                for row in kept:
                    scope.put(row)
        out = pd.DataFrame([r.fields for r in scope.rows], columns=columns)
        return out.astype({c: "Int64" for c in ("seq", "start", "stop", "at", "updated")})

    return rows.groupBy("owner", "agent").applyInPandas(fold, MEMORY)


def reconcile(source: DataFrame, mirror: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """key and action (upsert, tombstone) that make the mirror follow the source; rows of equal hash need none."""
    digest = F.sha2(F.to_json(F.struct(*payload)).cast("binary"), 256)
    a, b = source.select(key, digest.alias("a_")), mirror.select(key, digest.alias("b_"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("a_").isNull(), "tombstone").when(F.col("b_").isNull() | (F.col("a_") != F.col("b_")), "upsert")
    return both.select(key, action.alias("action")).filter("action is not null")


def rollup_changes(buckets: DataFrame, artifacts: DataFrame, builder: str, budget: int = 64) -> DataFrame:
    """bucket and action (rebuild, prune, skip) from buckets (bucket, episodes, facts: sorted arrays) and artifacts
    (bucket, members_hash, builder, status). Only the first ``budget`` rebuilds and prunes of a run are done; others wait."""
    digest = F.sha2(F.to_json(F.struct("episodes", "facts")).cast("binary"), 256)
    both = buckets.withColumn("hash_", digest).join(artifacts.select("bucket", F.col("members_hash").alias("old_"), F.col("builder").alias("by_"), F.col("status").alias("status_")), "bucket", "full_outer")
    current = (F.col("status_") == "current") & (F.col("by_") == builder) & (F.col("old_") == F.col("hash_"))
    empty = F.coalesce(F.size("facts"), F.lit(0)) <= 0
    action = F.when(empty & F.col("old_").isNotNull(), "prune").when(empty, "empty").when(F.coalesce(current, F.lit(False)), "skip").otherwise("rebuild")
    acted = both.select("bucket", action.alias("action"), F.col("hash_").alias("members_hash"))
    nth = F.row_number().over(Window.partitionBy(F.col("action").isin("rebuild", "prune")).orderBy("bucket"))
    return acted.withColumn("action", F.when(F.col("action").isin("rebuild", "prune") & (nth > budget), "wait").otherwise(F.col("action")))


def merge_duplicates(groups: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Links (fact, episode, active) after the members (group, episode) of each group (group, canonical) gave way to its canonical episode."""
    moved = members.join(groups, "group").select("episode", "canonical").filter("episode <> canonical")
    to = links.join(moved, "episode", "left").select("fact", F.coalesce("canonical", "episode").alias("episode"), "active")
    return to.groupBy("fact", "episode").agg(F.bool_or("active").alias("active"))


#: Replies that correct, and replies that deny, what was recalled.
CORRECTS = r"(?:更正(?:为|成)?|改成|应该是|其实是|并非.{0,24}而是|不是.{0,24}而是|记错.{0,24}(?:应该|其实|是|为)|changed\s+to|should\s+be|actually\s+(?:it\s+)?is|not.{0,40}but)"
DENIES = r"(?:我(?:从来)?没(?:有)?说过|不是我的|这(?:条|个)记忆(?:不对|错了)|记错(?:了|啦)?|别再记|删除(?:这条|这个)?记忆|忘掉这条|never\s+said|not\s+mine|forget\s+that|that(?:'s|\s+is)\s+wrong)"


def reply_kind(reply: Column) -> Column:
    """corrected, denied or null: what a reply says of the answer before it; a correction is looked for first."""
    return F.when(reply.rlike("(?i)" + CORRECTS), "corrected").when(reply.rlike("(?i)" + DENIES), "denied")


def feedback_outcomes(answers: DataFrame, min_single: float = 0.12, min_several: float = 0.24, margin: float = 0.12, past: float = 0.25) -> DataFrame:
    """query, id, outcome from rows (query, id, citation, content, answer, reply, kind and, where there is one, status): cited
    rows are adopted; a reply that corrects or denies (kind) goes to the one row it is closest to, superseded and
    conflicted ones being ``past`` closer, if that stands out; the others are ignored."""
    cited = F.array_contains(t.citations(F.col("answer")), F.col("citation"))
    near = F.coalesce(t.overlap(t.feedback_tokens(F.col("reply")), t.feedback_tokens(F.col("content"))), F.lit(0.0))
    if "status" in answers.columns:
        near = near + F.when(F.col("status").isin("superseded", "conflicted"), past).otherwise(0.0)
    w = Window.partitionBy("query")
    order = w.orderBy(F.col("near_").desc(), "id")
    rows = answers.withColumns({"cited_": cited, "near_": near}).withColumns({"nth_": F.row_number().over(order), "next_": F.lead("near_").over(order), "n_": F.count(F.lit(1)).over(w)})
    least = F.when(F.col("n_") == 1, min_single).otherwise(min_several)
    stands_out = F.col("next_").isNull() | (F.round(F.col("near_") - F.col("next_"), 12) >= margin)
    picked = F.coalesce(F.col("kind").isin("corrected", "denied") & (F.col("nth_") == 1) & (F.col("near_") >= least) & stands_out, F.lit(False))
    return rows.select("query", "id", F.when(picked, F.col("kind")).when(F.col("cited_"), "adopted").otherwise("ignored").alias("outcome"))

"""The life of subjects as an event log: drafts, confirmations, exemplars, folds, sweeps, splits and their withdrawal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.operators.census import smallest_linked
from tidepool.plans.stored import stored

c = F.col
STATE = "what string, subject long, status string, kind string, name string, previous_names array<string>, merged_into long, absorbed_by long, reopened boolean, files long, exemplars array<long>, absorbed array<long>, split_into array<long>, seq long, decision string, reason string, moved array<long>"


@dataclass
class Subject:
    no: int
    kind: str | None
    files: int = 0
    status: str = "draft"
    name: str | None = None
    previous: list[str] = field(default_factory=list)
    merged_into: int | None = None
    absorbed_by: int | None = None
    reopened: bool = False
    exemplars: dict[int, np.ndarray] = field(default_factory=dict)
    absorbed: list[int] = field(default_factory=list)
    split_into: list[int] = field(default_factory=list)


class Refused(ValueError):
    """Why an event changes nothing."""


class Registry:
    """Subjects by number; each verb changes them or is refused."""

    def __init__(self, cap: int = P.EXEMPLAR_CAP):
        self.subjects: dict[int, Subject] = {}
        self.cap = cap

    def get(self, no: int) -> Subject:
        if no not in self.subjects:
            raise Refused("no such subject")
        return self.subjects[no]

    def final(self, no: int) -> Subject:
        """The subject that a tombstone stands for; tombstones never point to tombstones."""
        s = self.get(no)
        return self.get(s.merged_into) if s.status == "merged-into" else s

    def trim(self, s: Subject) -> None:
        """Over the cap the exemplar whose nearest neighbour is closest goes, of equal ones the smallest."""
        while len(s.exemplars) > self.cap:
            refs = sorted(s.exemplars)
            v = np.stack([s.exemplars[r] for r in refs])
            alike = np.round(v @ v.T, 9)
            np.fill_diagonal(alike, -1.0)
            del s.exemplars[refs[int(alike.max(axis=1).argmax())]]

    def draft(self, e) -> list[int]:
        if e.subject in self.subjects:
            raise Refused("exists")
        self.subjects[e.subject] = Subject(e.subject, e.kind, e.files)
        return []

    def confirm(self, e) -> list[int]:
        s = self.get(e.subject)
        if s.status != "draft":
            raise Refused(f"is {s.status}")
        s.status, s.name, s.reopened = "confirmed", e.name, False
        return []

    def add(self, e) -> list[int]:
        s = self.get(e.subject)
        if s.status != "confirmed":
            raise Refused("not confirmed")
        if e.ref in s.exemplars:
            raise Refused("held")
        v = np.asarray(e.v, float)
        s.exemplars[e.ref] = v / np.linalg.norm(v)
        self.trim(s)
        return []

    def sweep(self, e) -> list[int]:
        """A draft that looks like a confirmed subject is no longer asked about."""
        s, other = self.get(e.subject), self.get(e.other)
        if s.status != "confirmed" or other.status != "draft":
            raise Refused("sweeps take drafts into confirmed subjects")
        if s.kind != other.kind:
            raise Refused("kinds differ")
        other.status, other.absorbed_by = "absorbed", s.no
        s.absorbed.append(other.no)
        return [other.no]

    def fold(self, e) -> list[int]:
        """Two confirmed subjects are one: the smaller number stays, the other becomes a tombstone. Names, exemplars
        and what the other absorbed move, and its own tombstones point to the one that stays."""
        a, b = self.final(e.subject), self.final(e.other)
        for s in (a, b):
            if s.status != "confirmed":
                raise Refused(f"{s.no} is {s.status}")
        if a is b:
            raise Refused("one subject already")
        if a.kind and b.kind and a.kind != b.kind:
            raise Refused("kinds differ")
        stays, goes = sorted((a, b), key=lambda s: s.no)
        name = e.name or stays.name
        held = [n for n in (stays.name, *stays.previous, goes.name, *goes.previous) if n and n != name]
        stays.name, stays.previous = name, list(dict.fromkeys(held))
        stays.exemplars = {**goes.exemplars, **stays.exemplars}
        self.trim(stays)
        for no in goes.absorbed:
            self.subjects[no].absorbed_by = stays.no
        stays.absorbed += goes.absorbed
        for s in self.subjects.values():
            if s.merged_into == goes.no:
                s.merged_into = stays.no
        goes.status, goes.merged_into, goes.name, goes.previous, goes.exemplars, goes.absorbed = "merged-into", stays.no, None, [], {}, []
        return [goes.no]

    def release(self, e) -> list[int]:
        """What a subject absorbed goes back to the open drafts."""
        s, out = self.get(e.subject), []
        for no in s.absorbed:
            child = self.subjects[no]
            if child.status == "absorbed" and child.absorbed_by == s.no:
                child.status, child.absorbed_by, child.reopened = "draft", None, True
                out.append(no)
        s.absorbed = []
        return out

    def unconfirm(self, e) -> list[int]:
        """The name is withdrawn, not the evidence: exemplars stay and attribute nothing."""
        s = self.get(e.subject)
        if s.status != "confirmed":
            raise Refused(f"is {s.status}")
        if s.name:
            s.previous = list(dict.fromkeys([*s.previous, s.name]))
        s.status, s.name, s.reopened = "draft", None, True
        return self.release(e)

    def reject(self, e) -> list[int]:
        s = self.get(e.subject)
        if s.status != "draft":
            raise Refused(f"is {s.status}")
        s.status = "rejected"
        return []

    def revive(self, e) -> list[int]:
        s = self.get(e.subject)
        if s.status != "rejected":
            raise Refused(f"is {s.status}")
        s.status, s.reopened = "draft", True
        return []

    def split(self, e) -> list[int]:
        """Two or more groups make a child each, and the parent is superseded; one group changes nothing."""
        s, groups = self.get(e.subject), list(e.children if e.children is not None else [])
        if s.status != "draft" or s.name:
            raise Refused("only unnamed drafts are split")
        if len(groups) < 2:
            return []
        if any(no in self.subjects for no in groups):
            raise Refused("exists")
        for no in groups:
            self.subjects[no] = Subject(no, s.kind)
        s.status, s.split_into = "superseded", groups
        return groups


VERBS = ("draft", "confirm", "add", "sweep", "fold", "release", "unconfirm", "reject", "revive", "split")


def rows_of(registry: Registry) -> Iterator[dict]:
    for s in registry.subjects.values():
        yield {
            "what": "state", "subject": s.no, "status": s.status, "kind": s.kind, "name": s.name, "previous_names": s.previous, "merged_into": s.merged_into,
            "absorbed_by": s.absorbed_by, "reopened": s.reopened, "files": s.files, "exemplars": sorted(s.exemplars), "absorbed": s.absorbed, "split_into": s.split_into,
        }


def replay(log: DataFrame, key: str, cap: int = P.EXEMPLAR_CAP) -> DataFrame:
    """key with a row for each subject (what = state) and each event (what = audit) of the logs.

    log: key, seq, verb, subject, other, name, kind, files, ref, v, children. Subjects that no event links can't change
    each other, so each group of linked subjects is replayed on its own in the order of seq: a hot registry is as many
    tasks as it has groups.
    """
    none = F.array().cast("array<long>")
    ids = F.array_distinct(F.array_compact(F.flatten(F.array(F.array("subject", "other"), F.coalesce("children", none)))))
    named = stored(log.withColumn("ids", ids), "log")
    node = lambda x: F.struct(c(key).alias("k"), x.alias("n"))
    links = named.select(key, F.explode("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"))
    numbered = links.select(F.xxhash64(node(c("first"))).alias("a"), F.xxhash64(node(c("n"))).alias("b")).where("a != b").distinct()
    found = smallest_linked(numbered).select(c("label").alias("a"), "root")
    own = F.xxhash64(node(F.get("ids", F.lit(0))))
    grouped = named.withColumn("a", own).join(found, "a", "left").withColumn("group", F.coalesce("root", "a")).drop("a", "root", "ids")

    columns = [key, *[p.split(" ")[0] for p in STATE.split(", ")]]
    whole = lambda x: None if pd.isna(x) else int(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a group's events come in order and leave with their batch, so only its subjects are held
        now, registry = None, Registry(cap)
        for pdf in batches:
            out, at, of = [], pdf.columns.get_loc(key), pdf.columns.get_loc("group")
            for e in pdf.rename(columns={key: "of_key"}).itertuples(index=False):
                k = None if pd.isna(e[at]) else e[at]
                if now != (k, e[of]):
                    out += [{key: now[0], **r} for r in rows_of(registry)] if now else []
                    now, registry = (k, e[of]), Registry(cap)
                e = e._replace(subject=whole(e.subject), other=whole(e.other), ref=whole(e.ref), files=whole(e.files) or 0, name=e.name or None)
                row = {key: k, "what": "audit", "subject": e.subject, "seq": e.seq, "decision": e.verb}
                try:
                    row["moved"] = getattr(registry, e.verb)(e) if e.verb in VERBS else []
                except Refused as why:
                    row |= {"decision": "refused", "reason": f"{e.verb}: {why}"}
                out.append(row)
            yield table(out)
        if now:
            held = rows_of(registry)
            while some := list(islice(held, 10_000)):
                yield table([{key: now[0], **r} for r in some])

    def table(rows: list[dict]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=columns)
        return found.astype(object).where(found.notna(), None) if len(found) else found

    ordered = grouped.repartition(key, "group").sortWithinPartitions(key, "group", "seq")
    return ordered.mapInPandas(run, f"{key} {dict(log.dtypes)[key]}, {STATE}")


def shown_files(states: DataFrame, key: str) -> DataFrame:
    """key, subject and shown: a subject's own files, those of the drafts it absorbed, and those of its tombstones and
    of what they absorbed. Stored counts never change, so a release takes them away again."""
    to = F.when(c("status") == "merged-into", c("merged_into")).when(c("status") == "absorbed", c("absorbed_by")).otherwise(c("subject"))
    more = states.select(key, to.alias("subject"), "files").groupBy(key, "subject").agg(F.sum("files").alias("shown"))
    live = states.where(~c("status").isin("merged-into", "absorbed")).select(key, "subject")
    return live.join(more, [key, "subject"])

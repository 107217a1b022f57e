"""The registry's replay against a plain fold over the whole log, one event after the other."""

import random
from collections import Counter

import numpy as np
import pytest
from tidepool.operators import lifecycle

LOG = "pack string, seq long, verb string, subject long, other long, name string, kind string, files long, ref long, v array<double>, children array<long>"
VERBS = ["draft"] * 6 + ["confirm"] * 4 + ["add"] * 5 + ["sweep"] * 2 + ["fold"] * 3 + ["release", "unconfirm", "reject", "revive", "split", "unknown"]


def random_log(rnd, packs, many, subjects):
    out = []
    for pack in packs:
        for seq in range(many):
            verb = rnd.choice(VERBS)
            children = [1000 * (seq + 1) + k for k in range(rnd.randint(0, 3))] if verb == "split" else None
            name = rnd.choice([None, "a", "b", "c"]) if verb in ("confirm", "fold") else None
            out.append((pack, seq, verb, rnd.randrange(subjects), rnd.randrange(subjects) if verb in ("sweep", "fold") else None, name, rnd.choice(["cat", "dog", None]), rnd.randint(0, 9), rnd.randrange(30), [rnd.random() for _ in range(3)], children))
    rnd.shuffle(out)
    return out


def fold(events, cap):
    """Dictionaries only: {subject: fields}, and {seq: (decision, moved)}."""
    live, audit = {}, {}

    def trim(s):
        while len(s["ex"]) > cap:
            refs = sorted(s["ex"])
            near = {r: max(round(float(np.dot(s["ex"][r], s["ex"][q])), 9) for q in refs if q != r) for r in refs}
            s["ex"].pop(min(refs, key=lambda r: (-near[r], r)))

    def new(no, kind, files):
        live[no] = {"status": "draft", "kind": kind, "name": None, "prev": [], "into": None, "by": None, "open": False, "files": files, "ex": {}, "abs": [], "split": []}

    def release(no):
        out = [k for k in live[no]["abs"] if live[k]["status"] == "absorbed" and live[k]["by"] == no]
        for k in out:
            live[k] |= {"status": "draft", "by": None, "open": True}
        live[no]["abs"] = []
        return out

    for _, seq, verb, no, other, name, kind, files, ref, v, children in sorted(events, key=lambda e: e[1]):
        s, moved, good = live.get(no), [], False
        status = s["status"] if s else None
        if verb == "draft" and not s:
            new(no, kind, files)
            good = True
        elif verb == "confirm" and status == "draft":
            s |= {"status": "confirmed", "name": name, "open": False}
            good = True
        elif verb == "add" and status == "confirmed" and ref not in s["ex"]:
            s["ex"][ref] = np.array(v) / np.linalg.norm(v)
            trim(s)
            good = True
        elif verb == "sweep" and status == "confirmed" and other in live and live[other]["status"] == "draft" and live[other]["kind"] == s["kind"]:
            live[other] |= {"status": "absorbed", "by": no}
            s["abs"].append(other)
            moved, good = [other], True
        elif verb == "fold" and s and other in live:
            a, b = (live[x]["into"] if live[x]["status"] == "merged-into" else x for x in (no, other))
            a, b = min(a, b), max(a, b)
            x, y = live[a], live[b]
            if a != b and x["status"] == y["status"] == "confirmed" and not (x["kind"] and y["kind"] and x["kind"] != y["kind"]):
                kept = name or x["name"]
                x["prev"] = list(dict.fromkeys(n for n in [x["name"], *x["prev"], y["name"], *y["prev"]] if n and n != kept))
                x["name"], x["ex"] = kept, {**y["ex"], **x["ex"]}
                trim(x)
                for k in live.values():
                    k["by"] = a if k["by"] == b else k["by"]
                    k["into"] = a if k["into"] == b else k["into"]
                x["abs"] = x["abs"] + y["abs"]
                y |= {"status": "merged-into", "into": a, "name": None, "prev": [], "ex": {}, "abs": []}
                moved, good = [b], True
        elif verb == "release" and s:
            moved, good = release(no), True
        elif verb == "unconfirm" and status == "confirmed":
            s["prev"] = list(dict.fromkeys([*s["prev"], *([s["name"]] if s["name"] else [])]))
            s |= {"status": "draft", "name": None, "open": True}
            moved, good = release(no), True
        elif verb == "reject" and status == "draft":
            s["status"], good = "rejected", True
        elif verb == "revive" and status == "rejected":
            s |= {"status": "draft", "open": True}
            good = True
        elif verb == "split" and status == "draft" and not s["name"] and not (len(children) > 1 and any(k in live for k in children)):
            good = True
            if len(children) > 1:
                for k in children:
                    new(k, s["kind"], 0)
                s |= {"status": "superseded", "split": children}
                moved = children
        audit[seq] = (verb if good or verb not in lifecycle.VERBS else "refused", tuple(moved))
    return live, audit


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_plain_fold(spark, seed):
    rnd = random.Random(seed)
    events = random_log(rnd, ["p", "q", "r"], 260, rnd.choice([6, 14, 30]))
    rows = lifecycle.replay(spark.createDataFrame(events, LOG).repartition(5), "pack", cap=3)
    got = rows.collect()
    states, seen = {}, Counter()
    for pack in ("p", "q", "r"):
        live, audit = fold([e for e in events if e[0] == pack], 3)
        for no, x in live.items():
            states[pack, no] = (x["status"], x["kind"], x["name"], tuple(x["prev"]), x["into"], x["by"], x["open"], x["files"], tuple(sorted(x["ex"])), tuple(x["abs"]), tuple(x["split"]))
            seen[x["status"]] += 1
        mine = {r.seq: (r.decision, tuple(r.moved or ())) for r in got if r.pack == pack and r.what == "audit"}
        assert mine == audit
    assert states == {
        (r.pack, r.subject): (r.status, r.kind, r.name, tuple(r.previous_names), r.merged_into, r.absorbed_by, r.reopened, r.files, tuple(r.exemplars), tuple(r.absorbed), tuple(r.split_into))
        for r in got if r.what == "state"
    }
    shown = {(r.pack, r.subject): r.shown for r in lifecycle.shown_files(rows.where("what = 'state'"), "pack").collect()}
    for (pack, no), total in shown.items():
        own = [x for (p, n), x in states.items() if p == pack and (n == no or x[4] == no or x[5] == no)]
        assert total == sum(x[7] for x in own)
    assert all(x[4] is None or states[p, x[4]][0] != "merged-into" for (p, _), x in states.items())


def test_unlinked_subjects_are_replayed_apart(spark):
    events = [("hot", k, "draft", k, None, None, "cat", 1, 0, [1.0], None) for k in range(300)]
    rows = lifecycle.replay(spark.createDataFrame(events, LOG).repartition(3), "pack")
    assert rows.where("what = 'state'").count() == 300
    assert lifecycle.replay(spark.createDataFrame([], LOG), "pack").count() == 0

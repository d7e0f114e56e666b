import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import catalogue, consensus, conversations, mixture, runs, splits, subjects
from weftline.llm.records import plain_session, role_of


def test_session_ids_and_roles(spark):
    h = "c62979c7-3dc4-40e8-940a-111ae40b5ae0"
    forms = [h, h.upper() + " ", "urn:uuid:" + h, "{" + h + "}", "session:" + h, h + ".jsonl", h.replace("-", ""), " " + h]
    df = spark.createDataFrame([(f,) for f in forms], "s string").select(plain_session(F.col("s")).alias("s"))
    assert {r.s for r in df.collect()} == {h}
    bad = spark.createDataFrame([(None,), ("",), ("xyz",), ("0" * 32,)], "s string").select(plain_session(F.col("s")).alias("s"))
    assert {r.s for r in bad.collect()} == {None}
    roles = spark.createDataFrame([("User ",), ("ai",), ("System",), ("?",), (None,), ("",)], "r string").select(role_of(F.col("r")).alias("r"))
    assert [r.r for r in roles.collect()] == ["user", "assistant", "other", None, None, None]


EV = "entity string, anchor string, ident string, ms long, place int, tie long, n string"


def brute_runs(rows, least=2, gap=None):
    by = defaultdict(list)
    for e, a, i, ms, place, tie, _ in rows:
        if e is not None:
            by[e].append((ms, tie, place, a, i))
    out = []
    for e, xs in by.items():
        cur = None
        for ms, _, _, a, i in sorted(xs):
            if cur and a is not None and a == cur[0] and (gap is None or ms - cur[4] <= gap):
                cur[2], cur[3], cur[4] = i, cur[3] + 1, ms
                continue
            if cur and cur[0] is not None and cur[3] >= least:
                out.append((e, cur[1], cur[2], cur[3]))
            cur = [a, i, i, 1, ms]
        if cur and cur[0] is not None and cur[3] >= least:
            out.append((e, cur[1], cur[2], cur[3]))
    return sorted(out)


@pytest.mark.parametrize("gap", [None, 3])
@pytest.mark.parametrize("chunks", [1, 7])
def test_runs_across_chunks(spark, gap, chunks):
    r = random.Random(chunks)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice(["x", "x", "x", "y", None]), f"c{i}", r.randint(0, 300), i % 3, i, "clash") for i in range(600)]
    got = runs.collapse_runs(spark.createDataFrame(rows, EV), gap, chunks=chunks)
    assert sorted((x.entity, x.first_id, x.last_id, x.n) for x in got.collect()) == brute_runs(rows, 2, gap)
    assert runs.collapse_runs(spark.createDataFrame([], EV)).count() == 0


def test_one_run_over_many_chunks(spark):
    rows = [("e", "x", f"c{i:03d}", i, 0, i, "") for i in range(200)]
    got = runs.collapse_runs(spark.createDataFrame(rows, EV), chunks=9).collect()
    assert [(x.first_id, x.last_id, x.n, x.last_ms - x.first_ms) for x in got] == [("c000", "c199", 200, 199)]


@pytest.mark.parametrize("tolerance", [0.0, 0.4])
@pytest.mark.parametrize("gap", [None, 90_000_000])
def test_similar_runs(spark, tolerance, gap):
    """Every event against the anchor of the open run, as one stream does it; over many days, so over many cuts."""
    r, rows = random.Random(5), []
    for i in range(500):
        words = r.choice([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 5, 6], [], None])
        rows.append((r.choice(["hot"] * 5 + ["b", None]), r.choice(["read", "read", "read", "edit", None]), words, f"c{i}", r.randint(0, 40) * 20_000_000, i % 2, i, "clash"))
    want, by = [], defaultdict(list)
    for e, hard, words, ident, ms, place, tie, _ in rows:
        if e is not None:
            by[e].append((ms, tie, place, hard, frozenset(words or ()), ident))
    for e, xs in by.items():
        cur = None
        for ms, _, _, hard, words, ident in sorted(xs, key=lambda x: x[:3]):
            if cur and hard is not None and hard == cur[0] and (gap is None or ms - cur[5] <= gap) and len(words & cur[1]) >= (1 - tolerance) * len(words | cur[1]):
                cur[3], cur[4], cur[5] = ident, cur[4] + 1, ms
                continue
            want += [(e, *cur[2:5])] if cur and cur[0] is not None and cur[4] > 1 else []
            cur = [hard, words, ident, ident, 1, ms]
        want += [(e, *cur[2:5])] if cur and cur[0] is not None and cur[4] > 1 else []
    df = spark.createDataFrame(rows, "entity string, hard string, words array<bigint>, ident string, ms long, place int, tie long, n string")
    got = sorted((x.entity, x.first_id, x.last_id, x.n) for x in runs.similar_runs(df, tolerance, gap).collect())
    assert got == sorted(want)
    assert runs.similar_runs(df.where("false"), tolerance, gap).count() == 0


def test_input_signature(spark):
    sig = lambda *t: [r.x for r in spark.createDataFrame([(x,) for x in t], "t string").select(runs.input_signature(F.col("t")).alias("x")).collect()]
    a = sig('{"command": "git log --since 2026-02-17T19:34:29Z -- a.py", "timeout": 10}', '{ "timeout":999, "command":"git log  --since 2026-08-19T22:14:46Z -- a.py" }')
    assert a[0] == a[1]
    a = sig('{"p": "pod-8af50991c40a1 x"}', '{"p": "pod-2c158f3889ba1 x"}', '{"p": "pod-2c158f3889ba1 y"}', '{"p": "x.ts"}', '{"p": "x.ts-old"}', None, "", "not json 5", "not json 77")
    assert a[0] == a[1] != a[2] and a[3] != a[4] and a[5] == a[6] == "" and a[7] == a[8]


REC = "session string, record string, parent string, ms long, tie long, role string, spoken boolean, turn_no string"


def brute_turns(rows):
    recs = {}
    for s, k, p, ms, tie, role, spoken, _ in sorted(rows, key=lambda x: x[4]):
        if k is not None:
            recs.setdefault(k, (s, p or None, ms, tie, role, spoken))
    out = []
    for s in {v[0] for v in recs.values()} - {None}:
        ks = [k for k, v in recs.items() if v[0] == s]
        if any(recs[k][1] and recs[k][1] not in recs for k in ks):
            continue
        kids = defaultdict(list)
        for k in ks:
            kids[recs[k][1] if recs[k][1] in ks else None].append(k)
        order, stack = [], sorted(kids[None], key=lambda k: recs[k][2:4], reverse=True)
        while stack:
            k = stack.pop()
            order.append(k)
            stack += sorted(kids[k], key=lambda k: recs[k][2:4], reverse=True)
        if any(recs[k][5] and recs[k][4] is None for k in ks):
            continue
        t = [k for k in order if recs[k][5] and recs[k][4] in ("user", "assistant")]
        if t and recs[t[0]][4] == "user" and recs[t[-1]][4] == "assistant":
            out += [(s, k, i + 1) for i, k in enumerate(t)]
    return sorted(out)


@pytest.mark.parametrize("chunks", [1, 5])
def test_conversations(spark, chunks):
    r, rows, tie = random.Random(chunks), [], 0
    for c in range(40):
        n, prev, t = (120 if c == 0 else r.randint(1, 9)), None, r.randint(0, 1000)
        for i in range(n):
            tie += 1
            t += r.choice([0, 1, 5])
            role = ("user", "assistant")[i % 2] if r.random() < 0.97 else r.choice(["other", None])
            k = f"{c}-{i}"
            rows.append((f"s{c}", k, prev, t + 1000 * c, tie, role, r.random() < 0.95, "clash"))
            prev = k
    r.shuffle(rows)
    rows = [(*x[:4], i, *x[5:]) for i, x in enumerate(rows)]  # delivered in any order
    rows = [x for i, x in enumerate(rows) if i % 61]  # some missing
    rows += [(*x[:4], x[4] + 10_000, *x[5:]) for x in rows[::9]] + [(None, "free", None, 1, 99_999, "user", True, ""), ("sx", "child", "free", 2, 99_998, "user", True, ""), ("sx", "child2", "child", 3, 99_997, "assistant", True, "")]
    got = conversations.assemble(spark.createDataFrame(rows, REC), chunks=chunks)
    assert sorted((x.session, x.record, x.turn_no) for x in got.collect()) == brute_turns(rows)
    assert conversations.assemble(spark.createDataFrame([], REC)).count() == 0


def test_rings_end(spark):
    rows = [("s", "a", "c", 1, 1, "user", True, ""), ("s", "b", "a", 2, 2, "assistant", True, ""), ("s", "c", "b", 3, 3, "assistant", True, "")]
    assert conversations.assemble(spark.createDataFrame(rows, REC)).count() == 3


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(4)
    rows, k = [], 0
    for s in range(400):
        for _ in range(300 if s == 0 else r.randint(1, 12)):
            k += 1
            rows.append((k, f"u{k}", None, f"m{s}" if r.random() < 0.3 else None, f"s{s}", f"s{s}", r.choice(["a", "a", "b"]), "clash"))
    rows += [(k + 1, "x1", "u1", None, None, "record:x1", "a", ""), (k + 2, "x2", None, "m1", "s9", "s9", "b", "")]
    df = spark.createDataFrame(rows, "row_id long, uuid string, parent string, message_id string, session string, node string, label string, component string").drop("component")
    goal = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("val", 0.1), (None, 1.0), ("zero", 0.0)], "split_name string, target_share double")
    got = splits.assign_splits(df, goal).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for x in got:
        by[x.session or x.node].add(x.split_name)
    assert all(len(v) == 1 for v in by.values()) and by["record:x1"] == by["s0"] and by["s1"] == by["s9"]
    share = {s: sum(x.split_name == s for x in got) / len(got) for s in ("train", "test", "val")}
    assert abs(share["train"] - 0.8) < 0.06 and abs(share["test"] - 0.1) < 0.06  # one group alone holds a tenth
    assert splits.assign_splits(df, goal.where("false")).where("split_name is not null").count() == 0
    assert splits.assign_splits(df.where("false"), goal).count() == 0


def test_quotas_are_dealt_by_need():
    def one_by_one(need, total, size, members):
        need, total, got = list(need), list(total), [0] * len(need)
        for _ in range(members):
            i = max(range(len(need)), key=lambda j: (need[j], total[j], -j))
            got[i] += 1
            need[i] -= size
            total[i] -= size
        return got

    r = random.Random(3)
    for _ in range(200):
        n, size, members = r.randint(1, 5), r.randint(1, 6), r.randint(0, 300)
        need, total = [r.uniform(-20, 900) for _ in range(n)], [r.uniform(0, 5000) for _ in range(n)]
        assert splits.quotas(need, total, size, members) == one_by_one(need, total, size, members)


def test_rare_labels_are_spread(spark):
    """Labels of 1, 2, 5 and 100 records among 3,000 groups: each is spread as near to its shares as whole groups allow."""
    rows, k = [], 0
    for s in range(3000):
        for _ in range(1 + s % 5):
            k += 1
            rows.append((k, f"u{k}", None, None, f"s{s}", f"s{s}", "ab"[s % 2]))
        label = "once" if s == 7 else "twice" if s in (50, 2000) else "five" if s % 600 == 11 else "hundred" if s % 30 == 13 else None
        if label:
            k += 1
            rows.append((k, f"u{k}", None, None, f"s{s}", f"s{s}", label))
    df = spark.createDataFrame(rows, "row_id long, uuid string, parent string, message_id string, session string, node string, label string")
    goal = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("val", 0.1)], "split_name string, target_share double")
    n = defaultdict(int)
    for x in splits.assign_splits(df, goal).collect():
        n[x.label, x.split_name] += 1
    assert n["hundred", "train"] == 80 and n["hundred", "test"] == n["hundred", "val"] == 10
    assert n["five", "train"] == 4 and n["twice", "train"] <= 2 and sum(v for (a, _), v in n.items() if a == "once") == 1
    for label in "ab":
        total = sum(v for (a, _), v in n.items() if a == label)
        assert abs(n[label, "train"] / total - 0.8) < 0.01 and abs(n[label, "val"] / total - 0.1) < 0.01


def test_linked_pairs(spark):
    rows = [(1, "u1", None, "msg_0123", "a", "a", "l"), (2, "u2", None, "msg_0123", "b", "b", "l"), (3, "u3", "u2", None, "c", "c", "l"), (4, "u4", None, None, "d", "d", "l"), (5, "u5", "u4", "x", None, "record:5", "l")]
    got = splits.linked_pairs(spark.createDataFrame(rows, "row_id long, uuid string, parent string, message_id string, session string, node string, label string"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_placeholder_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("msg_01AbCdEf23", "unknown", "msg_synthetic", "", None, "msg_00000000")], "m string").select(splits.real_id(F.col("m")).alias("m"))
    assert [r.m for r in df.collect()] == ["msg_01AbCdEf23", None, None, None, None, None]


def test_ids_without_digits_are_real(spark):
    real = ["msg_01JMSkwSBXnIJ", "msg_01DXFXCNUZkgs", "msg_01AoqlOXJjN0F", "msg_01AAAAAAAAAAB", "msg_01unknownAbC", "gen-abcdef"]
    not_real = ["msg_01", "msg_0100000000000", "msg_01xxxxxxxxxxx", "Unknown ", "<synthetic>", "NULL", "n/a", "\t", "00000000-0000-0000-0000-000000000000", "---"]
    df = spark.createDataFrame([(x,) for x in real + not_real], "m string").select(splits.real_id(F.col("m")).alias("m"))
    assert [r.m for r in df.collect()] == real + [None] * len(not_real)


LAB = "label_id long, item_key string, labeler string, labeled_at timestamp, origin string, status string, boundary string, is_repeat boolean, v string"


def label_rows(seed=0, items=250):
    """Labels of nine labelers of unlike care, with the truth."""
    from datetime import datetime, timedelta

    r, rows, truth, n = random.Random(seed), [], {}, 0
    words = consensus.CODEBOOK["status"]
    for i in range(items):
        truth[i] = r.choice(words)
        for lab, care in (("good1", 0.9), ("good2", 0.9), ("good3", 0.85), ("mid", 0.6), ("noise1", 0.2), ("noise2", 0.2), ("shift", 0.0)):
            if r.random() < 0.6:
                n += 1
                w = words[(words.index(truth[i]) + 1) % 5] if lab == "shift" else truth[i] if r.random() < care else r.choice(words)
                rows.append((n, f"i{i}", lab, datetime(2026, 1, 1) + timedelta(minutes=n), None, r.choice([w, w.upper(), f" {w}"]), "oops", False, "clash"))
    return rows + rows[::17], truth


def test_consensus_beats_the_majority(spark):
    rows, truth = label_rows()
    got = {x.item_key: x.label_value for x in consensus.consensus(spark.createDataFrame(rows, LAB)).where("label_field = 'status'").collect()}
    votes = defaultdict(lambda: defaultdict(int))
    for x in {(r[1], r[2]): r for r in rows}.values():
        votes[x[1]][x[5].strip().lower()] += 1
    right = sum(got[k] == truth[int(k[1:])] for k in votes)
    major = sum(max(v, key=v.get) == truth[int(k[1:])] for k, v in votes.items())
    assert right > major and right / len(votes) > 0.85
    w = {x.labeler: x.weight for x in consensus.reliability(spark.createDataFrame(rows, LAB)).collect()}
    assert min(w["good1"], w["good2"], w["good3"]) > w["mid"] > max(w["noise1"], w["noise2"])


def test_consensus_edges(spark):
    from datetime import datetime

    at = datetime(2026, 1, 1)
    rows = [(1, "i", "a", at, "ask", "outcome?", "too big", False, ""), (2, "i", "a", at, "plan", "open", None, True, ""), (3, None, "a", at, "asked", "done", "right", False, ""), (4, "j", None, None, "asked", None, "", None, ""), (5, "k", "b", None, "nonsense", None, None, None, "")]
    got = {(x.item_key, x.label_field): x.label_value for x in consensus.consensus(spark.createDataFrame(rows, LAB)).collect()}
    assert got == {("i", "origin"): "asked", ("i", "status"): "unclear", ("i", "boundary"): "too_big"}
    none = spark.createDataFrame([], LAB)
    assert consensus.consensus(none).count() == 0 and consensus.agreement(none).count() == 0
    two = [(n, "i", f"l{n}", at, "asked", "done", "right", False, "") for n in (1, 2)] + [(3, "j", "l1", at, "plan", "open", "right", False, ""), (4, "j", "l2", at, "plan", "done", "right", False, "")]
    a = {x.label_field: (x.observed, x.alpha) for x in consensus.agreement(spark.createDataFrame(two, LAB)).collect()}
    assert a["origin"] == (1.0, 1.0) and a["status"][0] == 0.5


def test_apportionment():
    assert mixture.apportion([0.5, 0.3, 0.2], [100, 100, 100], 10) == [5, 3, 2]
    assert mixture.apportion([0.5, 0.5], [1, 100], 10) == [1, 9] and mixture.apportion([0.5, 0.5], [1, 1], 10) == [1, 1] and mixture.apportion([], [], 5) == []


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["Big", " big", "big"] if i % 10 else ["small-one", "Small_One"]), r.randint(0, 60), "x") for i in range(3000)] + [(9001, None, 50, ""), (9002, "other", 50, ""), (9003, "big", 0, "")]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, repeats string")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.4, 5), ("absent", 0.3, 2), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    d = mixture.draw(sizes, goal).collect()
    tok = defaultdict(int)
    for x in d:
        tok[x.source] += x.n_tokens * x.repeats
    assert max(x.repeats for x in d if x.source == "big") == 1 and max(x.repeats for x in d) <= 5 and len({x.doc_id for x in d}) == len(d)
    assert abs(tok["big"] / sum(tok.values()) - 0.6) < 0.01
    s = {x.source: x for x in mixture.shares(mixture.draw(sizes, goal), sizes, goal).collect()}
    assert s["absent"].drawn_tokens == 0 and abs(s["small_one"].actual_share - 0.4) < 0.01
    assert mixture.draw(sizes.where("false"), goal).count() == 0 and mixture.draw(sizes, goal.where("false")).count() == 0


def corpus():
    r = random.Random(2)
    terms = {"law": ["court docket", "plaintiff", "liability cap", "arbitration panel"], "sport": ["marathon pace", "goalkeeper", "home leg", "relay team"], "music": ["drum loop", "string quartet", "sheet music", "oboe solo"]}
    forms = ["The report explains the {} now.", "Added a field for the {} and the {}.", "The column for the {} is empty.", "Nobody knows where the {} comes from."]
    plain = ["The person agreed to it at once.", "Stopped here on request.", "This is a marathon review of it all."]
    docs, labels = [], []
    for i in range(600):
        own = r.sample(sorted(terms), r.choice([1, 1, 1, 1, 2]))
        s = [r.choice(forms).format(*(r.choice(terms[k]) for _ in range(2))) for k in own for _ in range(2)] + r.choices(plain, k=2)
        if r.random() < 0.3:
            other = r.choice([k for k in terms if k not in own] or own)
            s.append(r.choice(forms[2:]).format(r.choice(terms[other]))) if other not in own else None
        r.shuffle(s)
        docs.append((i, "\n".join(s), own))
        if i % 4 == 0:
            labels.append((i, r.choice(own) if r.random() < 0.95 else r.choice(sorted(terms))))
    return docs, labels, terms


def test_subjects(spark):
    docs, labels, terms = corpus()
    extra = [(1000, "The report explains the goalkeeper now.", ["sport"]), (1001, "", []), (1002, None, []), (1003, "   \n", []), (1004, "(plaintiff) Stopped here on request.", []), (1005, "The person agreed to it at once.", [])]
    d = spark.createDataFrame([(i, t, "clash") for i, t, _ in docs + extra], "doc_id long, text string, subject string").drop("subject")
    lab = spark.createDataFrame([(i, s, "l") for i, s in labels] + [(None, "law", "l"), (3, "unknown", "l"), (5, None, "l")], "doc_id long, subject string, labeler string")
    area = spark.createDataFrame([(s, "x") for s in terms], "subject string, about string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(d, lab, area).collect()}
    want = {(i, s) for i, _, own in docs + extra for s in own}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    assert not [x for x in got if x[0] in (1001, 1002, 1003, 1004, 1005)]
    assert subjects.subjects_of(d.where("false"), lab, area).count() == 0 and subjects.subjects_of(d, lab.where("false"), area).count() == 0
    comp = {r.subject: r.n_docs for r in subjects.composition(d, spark.createDataFrame(sorted(got), "doc_id long, subject string")).collect()}
    assert comp["(none)"] >= 5 and set(terms) <= set(comp)


def test_copies_change_no_subject(spark):
    docs, labels, terms = corpus()
    remark = "The column for the goalkeeper is empty.\nThe person agreed to it at once.\nStopped here on request."
    d = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(1000 + i, remark) for i in range(7)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, s, "l") for i, s in labels], "doc_id long, subject string, labeler string")
    area = spark.createDataFrame([(s, "x") for s in terms], "subject string, about string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(d, lab, area).where("doc_id >= 1000").collect()}
    assert not [x for x in got if x[0] < 2000]  # a remark in passing, in any number of copies


def test_additions_follow_many_statements(spark):
    words = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"Part {w}x is here. Nobody objected." for w in words] + [f"Item {w}x came first.\nItem {w}y came next." for w in words] + ["Rare start. Rare end."] * 30 + [f"Always opens.\nLine {w}z." for w in words]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = subjects.statements(d)
    plain = {r.part for r in rows.join(subjects.plain_statements(rows, d), "sid", "left_semi").select("part").distinct().collect()}
    assert "nobody objected" not in plain and {"always opens", "rare start", "rare end", "part ax is here"} <= plain


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_run(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_found_columns(spark, data):
    want = {
        "p1_found": "row_id bigint, block_no int, pii_kind string, pii_text string", "p2_found": "item_key string, label_field string, label_value string", "p3_found": "session_a string, session_b string",
        "p4_found": "session_id string, first_call_id string, last_call_id string, n_calls bigint", "p7_found": "src string, session_id string, turn_no int, message_key string", "p8_ids": "doc_id bigint, ids array<int>", "p10_found": "doc_id bigint, subject string",
    }
    for name, ddl in want.items():
        assert ", ".join(f"{c} {t}" for c, t in catalogue.QUERIES[name](spark, data).dtypes) == ddl

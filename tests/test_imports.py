"""Imports against a replay item by item, and commits that are whole or nothing."""

import random

import pytest

from tessella.operators import imports

MACROS, VERSIONS = "macro_id long, title string, current_version long, archived boolean, is_favorite boolean", "macro_id long, version long, title string, body string"
FACTS, ITEMS = "macro_id long, fact_key string, value string", "pos long, title string, body string, archived boolean, is_favorite boolean, facts array<struct<fact_key:string,value:string>>"
key = lambda t: " ".join((t or "").split()).lower()
content = lambda t, b: ((t or "").strip(" "), (b or "").strip(" "))


def replay(macros, versions, facts, items, policy):
    macros = {m[0]: list(m) for m in macros}
    bodies = {(v[0], v[1]): (v[2], v[3]) for v in versions}
    facts = {m: [f for f in facts if f[0] == m] for m in macros}
    now = lambda m: content(*bodies[m, macros[m][2]])
    live = {}
    for m in sorted(macros, reverse=True):
        if not macros[m][3]:
            live[key(bodies[m, macros[m][2]][0])] = m
    gone = {now(m) for m in macros if macros[m][3]}
    counts, actions = {"create": 0, "update": 0, "skip": 0}, {}
    made = max(macros, default=0)
    for pos, title, body, archived, favourite, given in sorted(items, key=lambda i: i[0]):
        dup = live.get(key(title))
        if (archived and content(title, body) in gone) or (not archived and dup and policy == "skip"):
            action = "skip"
        elif not archived and dup and policy == "new_version":
            action = "update"
            if now(dup) != content(title, body):
                macros[dup][2] += 1
                bodies[dup, macros[dup][2]] = (title, body)
            macros[dup][1] = title
            macros[dup][4] = bool(macros[dup][4] or favourite)
            facts[dup] = [(dup, k, v) for k, v in given] if given else facts[dup]
        else:
            action, made = "create", made + 1
            name = (title or "") + " (copy)" if not archived and dup else title
            macros[made] = [made, name, 1, bool(archived), bool(favourite)]
            bodies[made, 1] = (name, body)
            facts[made] = [(made, k, v) for k, v in given or []]
            if archived:
                gone.add(content(title, body))
            elif not dup:
                live[key(title)] = made
        counts[action] += 1
        actions[pos] = action
    return counts, actions, {tuple(m) for m in macros.values()}, {(m, v, t, b) for (m, v), (t, b) in bodies.items()}, sorted(f for fs in facts.values() for f in fs)


def library():
    macros = [(1, "Refund", 2, False, True), (2, "Late  payout", 1, False, False), (3, "Old", 1, True, False), (5, "refund", 1, False, False)]
    versions = [(1, 1, "Refund", "a"), (1, 2, "Refund", "b"), (2, 1, "Late  payout", "x"), (3, 1, "Old", "o"), (5, 1, "refund", "z")]
    return macros, versions, [(1, "k", "1"), (2, "k", "2"), (3, "k", "3")]


def batch(seed, n):
    rng = random.Random(seed)
    titles = ["Refund", "refund ", "late payout", "New", "NEW", "Old", "", None, "Hot", "Hot", "Hot"]
    facts = [None, [], [("p", "9")], [("q", "8"), ("r", "7")]]
    return [(p, rng.choice(titles), rng.choice(["a", "b", "x", "o", None, " b"]), rng.choice([True, False, False, False, None]), rng.choice([True, False, None]), rng.choice(facts)) for p in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("policy", imports.POLICIES)
@pytest.mark.parametrize("items", [batch(1, 120), []])
def test_replay(spark, policy, items):
    macros, versions, facts = library()
    tables = dict(zip(imports.TABLES, [spark.createDataFrame(r, s) for r, s in ((macros, MACROS), (versions, VERSIONS), (facts, FACTS))], strict=True))
    plan = imports.planned(tables["macros"], tables["versions"], spark.createDataFrame(items, ITEMS), policy, width=64)
    counts, actions, want_macros, want_versions, want_facts = replay(macros, versions, facts, items, policy)
    assert {r["pos"]: r["action"] for r in plan.collect()} == actions
    out = imports.applied(**tables, plan=plan)
    assert {tuple(r) for r in out["macros"].collect()} == want_macros
    assert sorted(map(str, map(tuple, out["versions"].collect()))) == sorted(map(str, want_versions))
    assert sorted(map(tuple, out["facts"].collect())) == want_facts


def test_commit(spark, tmp_path):
    folder = str(tmp_path)
    assert imports.latest(spark, folder) == (0, {})
    first = dict(zip(imports.TABLES, [spark.createDataFrame(r, s) for r, s in zip(library(), (MACROS, VERSIONS, FACTS), strict=True)], strict=True))
    assert imports.committed(spark, folder, first) == 1
    items = batch(2, 40)
    assert imports.import_items(spark, folder, spark.createDataFrame(items, ITEMS), "new_version") == replay(*library(), items, "new_version")[0]
    n, tables = imports.latest(spark, folder)
    assert n == 2 and {tuple(r) for r in tables["macros"].collect()} == replay(*library(), items, "new_version")[2]
    broken = {**tables, "facts": tables["facts"].selectExpr("macro_id", "fact_key", "raise_error('no') AS value")}
    with pytest.raises(Exception, match="no"):
        imports.committed(spark, folder, broken)
    assert imports.latest(spark, folder)[0] == 2
    with pytest.raises(ValueError):
        imports.planned(tables["macros"], tables["versions"], spark.createDataFrame(items, ITEMS), "other")

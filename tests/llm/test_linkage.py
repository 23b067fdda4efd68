import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import linkage

SCHEMA = "finding_id long, batch_no int, template_id string, file_path string, extracts array<struct<value_text:string,line_no:int,byte_offset:long>>, block string, sig int"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, t, p, None if v is None else [(x, 1, 2) for x in v], "clash", 1) for i, b, t, p, v in rows], SCHEMA)


def brute(rows):
    accepted, out = {}, set()
    for i, _, t, p, v in sorted(rows):
        if t is None:
            continue
        key = (t.strip().lower(), None if p is None else "/".join(s for s in re.split(r"[/\\]+", p.strip()) if s not in ("", ".")))
        vals = sorted(x for x in (re.sub("^[\"'`,\\s]+|[\"'`,\\s]+$", "", y) for y in v or [] if y is not None) if x)
        hit = [a for a, w in accepted.get(key, []) if linkage.agreement(w, vals) >= linkage.AGREEMENT - 1e-9]
        if hit:
            out.add((hit[0], i))
        else:
            accepted.setdefault(key, []).append((i, vals))
    return out


def random_rows(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop0123456789") for _ in range(rnd.randrange(10, 40)))
    shared, rows = ["localhost", "v2.23.0", "token=deadbeefdeadbeef"], []
    for i in range(n):
        if rows and rnd.random() < 0.4:
            _, _, t, p, v = rnd.choice(rows)
            v = None if v is None else list(v)
            if v and rnd.random() < 0.6:
                k = rnd.randrange(len(v))
                at = rnd.randrange(len(v[k]) or 1)
                v[k] = rnd.choice([v[k][:at] + "Z" + v[k][at + 1 :], v[k][: max(4, at)] + "...", f'"{v[k]}",'])
            if v and rnd.random() < 0.3:
                rnd.shuffle(v)
            t = rnd.choice([t, t.upper(), f" {t} "]) if t else t
            p = rnd.choice([p, p.replace("/", "\\"), "./" + p, p.replace("/", "//")])
        else:
            t, p = rnd.choice(["hot-rule", "hot-rule", "b-rule", None]), rnd.choice(["hot/path.env", "hot/path.env", "x/y.py"])
            v = rnd.choice([None, [], [word() for _ in range(rnd.randrange(1, 6))] + rnd.sample(shared, rnd.randrange(0, 3))])
        rows.append((i + 1, i * 6 // n, t, p, v))
    return rows


def replayed(spark, rows, tile=linkage.TILE, path=None):
    """All repeats; one new history object per batch if there is a path to reopen it by."""
    h = linkage.History(spark, path, tile=tile)
    for b in sorted({r[1] for r in rows}):
        h.add(frame(spark, [r for r in rows if r[1] == b]))
        h = linkage.History(spark, path, tile=tile) if path else h
    return {tuple(r) for r in h.repeats().select("finding_id_a", "finding_id_b").collect()}


def test_equals_brute_force(spark):
    rows = random_rows(240, 1)
    got = {tuple(r) for r in linkage.replay(frame(spark, rows)).repeats().select("finding_id_a", "finding_id_b").collect()}
    assert got == brute(rows)


def test_reopened_history_with_buckets_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "BUCKET_ROWS", 20)
    rows = random_rows(240, 3)
    path = f"file://{tmp_path}/history"
    assert replayed(spark, rows, path=path) == brute(rows)
    h = linkage.History(spark, path)
    assert h.step == 6 and len(h.segments) == 3 and sum(h.patterns.values()) > 0
    with pytest.raises(ValueError):
        h.add(frame(spark, rows[:5]))
    assert linkage.History(spark, path).step == 6


def test_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    rows, path = random_rows(60, 4), f"file://{tmp_path}/history"
    h = linkage.History(spark, path)
    h.add(frame(spark, [r for r in rows if r[1] < 3]))
    monkeypatch.setattr(linkage, "write_text", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        h.add(frame(spark, [r for r in rows if r[1] >= 3]))
    monkeypatch.undo()
    h = linkage.History(spark, path)
    h.add(frame(spark, [r for r in rows if r[1] >= 3]))
    assert {tuple(r) for r in h.repeats().collect()} == brute(rows)


def test_chain_of_near_copies(spark):
    base = "abcdefghijklmnopqrstuvwxyz0123456789ABCD"
    values = [base[: 40 - 5 * k] + "#" * (5 * k) for k in range(5)]
    rows = [(k + 1, k, "t", "p", [v, "shared-value-xyz"]) for k, v in enumerate(values)]
    got = replayed(spark, rows)
    assert got == brute(rows) and got


def test_increments_equal_one_go(spark):
    rows = random_rows(120, 9)
    h = linkage.History(spark)
    for b in range(6):
        new = h.add(frame(spark, [r for r in rows if r[1] == b]))
        assert {r.finding_id_b for r in new.collect()} <= {r[0] for r in rows if r[1] == b}
    assert {(r.finding_id_a, r.finding_id_b) for r in h.repeats().collect()} == brute(rows)
    before = h.repeats().count()
    assert h.add(frame(spark, [])).count() == 0 and h.repeats().count() == before


def short_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            v = list(rnd.choice(rows)[4])
            for k in range(len(v)):
                for _ in range(rnd.choice([0, 1, 1]) if len(v[k]) < 20 else 3):
                    at = rnd.randrange(len(v[k]))
                    v[k] = v[k][:at] + rnd.choice(["#", "", "##"]) + v[k][at + 1 :]
        else:
            v = ["".join(rnd.choice("abcdefgh0123") for _ in range(rnd.choice([10, 10, 15, 24, 60]))) for _ in range(rnd.choice([1, 1, 2, 10]))]
        rows.append((i + 1, i * 3 // n, "t", "p", v))
    return rows


@pytest.mark.parametrize("tile, sent", [(10, 200_000), (4096, 0), (10, 0)])
def test_edits_in_short_values_and_hot_blocks_equal_brute_force(spark, monkeypatch, tile, sent):
    monkeypatch.setattr(linkage, "SENT_ROWS", sent)
    one = [(1, 0, "t", "p", ["abcdefghijklmno"]), (2, 1, "t", "p", ["abcdefgXijklmno"])]
    ten = [["%010d" % (k * 7919**2 % 10**10) for k in range(10)]]
    ten.append([v[:4] + "x" + v[5:] if k < 8 else v for k, v in enumerate(ten[0])])
    rows = one + [(k + 3, k, "t", "q", v) for k, v in enumerate(ten)] + [(i + 10, b, t, p, v) for i, b, t, p, v in short_rows(120, 5)]
    rows = [(i, min(k * 3 // len(rows), 2), t, p, v) for k, (i, _, t, p, v) in enumerate(rows)]
    got = replayed(spark, rows, tile)
    assert got == brute(rows) and {(1, 2)} <= got


def test_empty(spark):
    assert linkage.replay(frame(spark, [])).repeats().count() == 0


def test_bound_of_agreement_keeps_every_pair():
    rows = [sorted(x for x in r[4] or [] if x) for seed in range(3) for r in random_rows(60, seed) + short_rows(60, seed)]
    for a in rows:
        for b in rows[::5]:
            exact, told = linkage.agreement(a, b), linkage.agreement(a, b, 0.8)
            assert told == exact or exact <= told < 0.8
        near = {k: set(js.tolist()) for k, js in linkage.alike([(9999, sum(map(len, a)), 0, a)], [(k, sum(map(len, b)), 0, b) for k, b in enumerate(rows)])}
        assert {k for k, b in enumerate(rows) if linkage.agreement(a, b) >= 0.8} <= near.get(0, set())


def test_agreement():
    assert linkage.agreement([], []) == 1 and linkage.agreement([], ["a"]) == 0
    assert linkage.agreement(["abcdefghij"], ["abcdeXghij"]) == 0.9
    assert linkage.agreement(["aaaa", "bbbb"], ["bbbb", "aaaa"]) == 1
    assert linkage.agreement(["a" * 8, "b" * 2], ["a" * 8]) == 0.8


def test_weights_favour_agreement_and_are_learned():
    seen = Counter({(4, 2, 1): 80, (4, 1, 0): 20, (0, 0, 0): 300, (1, 1, 1): 100})
    w, odds, least = linkage.learn_weights(seen)
    assert w[0, 4] > 0 > w[0, 0] and odds < 0 and least == 0
    alone, _, _ = linkage.learn_weights(Counter())
    assert alone[0, 4] > 0 > alone[0, 0] and abs(alone[2, 1]) < 1e-9 < abs(w[2, 1])


def test_weights_never_lose_a_pair_that_agrees():
    rnd = random.Random(1)
    for _ in range(200):
        seen = Counter({(i, j, k): int(10 ** rnd.uniform(0, 7)) - 1 for i in range(5) for j in range(3) for k in range(2)})
        w, odds, least = linkage.learn_weights(seen)
        assert all(odds + w[0, 4] + w[1, j] + w[2, k] >= least - 1e-9 for j in range(3) for k in range(2)) and least <= 0


def test_representatives():
    r = linkage.Representatives()
    r.unite(5, 2)
    r.unite(9, 5)
    assert [r.find(x) for x in (2, 5, 9, 7)] == [2, 2, 2, 7]


def test_pairs_within_groups_keep_every_pair_that_agrees(monkeypatch):
    monkeypatch.setattr(linkage, "PAIRS", 300)
    rnd = random.Random(2)
    vals = [sorted(x for x in r[4] or [] if x) for r in random_rows(150, 5) + short_rows(150, 6)]
    vals += [["ab"], ["ab", "é"], ["é"], [], ["zürich-straße-ÄÖ-😀😀"], ["zürich-strasse-ÄÖ-😀😀"]] * 3
    n = len(vals)
    group, ids = np.array([rnd.randrange(3) - 1 for _ in range(n)], np.int64), np.array(rnd.sample(range(n), n), np.int64)
    rows = linkage._Rows(group, np.array([sum(map(len, v)) for v in vals]), ids, pa.array(vals, pa.list_(pa.string())))
    got = [(i, j) for a, b in linkage.near_pairs(rows, rows) for i, j in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and all(group[i] == group[j] and ids[j] < ids[i] for i, j in got)
    agreeing = {(i, j) for i in range(n) for j in range(n) if group[i] == group[j] and ids[j] < ids[i] and linkage.agreement(vals[j], vals[i]) >= linkage.AGREEMENT - 1e-9}
    assert agreeing and agreeing <= set(got)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rows_taken_together_keep_groups_whole(size):
    t = pa.table({"block": [1, 1, 2, 2, 2, 3, 4, 4], "total": [3, 0, 5, 1, 9, 0, 2, 2]})
    for batch in (1, 3, 8):
        for same in (0, 1):
            parts = list(linkage._together(iter(t.to_batches(max_chunksize=batch)), size, same))
            assert pa.concat_tables(parts).equals(t)
            assert not same or sum(len(set(p["block"].to_pylist())) for p in parts) == 4


@pytest.mark.parametrize("keys", [0, 1000])
def test_a_large_batch_meets_a_history_by_block(spark, monkeypatch, keys):
    monkeypatch.setattr(linkage, "SENT_ROWS", 0)
    monkeypatch.setattr(linkage, "SENT_KEYS", keys)
    rows = random_rows(150, 11)
    assert replayed(spark, rows, 10) == brute(rows)


def test_an_increment_takes_few_stages(spark):
    rows, sc = random_rows(120, 13), spark.sparkContext
    h = linkage.History(spark)
    h.add(frame(spark, [r for r in rows if r[1] < 2]))
    sc.setJobGroup("increment", "one increment")
    try:
        h.add(frame(spark, [r for r in rows if r[1] >= 2]))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(x) for j in tracker.getJobIdsForGroup("increment") for x in tracker.getJobInfo(j).stageIds]
    ran = sum(1 for s in stages if s is not None and s.numCompletedTasks)
    assert 0 < ran <= 14, ran


def test_accepted_findings_of_a_hot_block_are_not_copied(spark):
    rnd = random.Random(3)
    rows = [(i, 7, int(linkage.math.log(n + 1) / linkage.math.log(1.25)), n, i > 400) for i in range(1, 406) for n in [rnd.randrange(90, 260)]]
    held = spark.createDataFrame(rows, "finding_id long, block long, band int, total int, fresh boolean").selectExpr("*", "1L as spelled", "array('x') as vals", "1L as sig")
    got = linkage.tiles(held, 10).select("i", "j", "finding_id", "fresh").collect()
    known = Counter(r.finding_id for r in got if not r.fresh)
    assert known and set(known.values()) == {1}
    at = {}
    for r in got:
        at.setdefault(r.finding_id, set()).add((r.i, r.j))
    band = {r[0]: r[2] for r in rows}
    near = [(a, b) for b in range(401, 406) for a in range(1, b) if abs(band[a] - band[b]) <= 1]
    assert near and all(at[a] & at[b] for a, b in near)

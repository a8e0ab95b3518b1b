import random

import pytest
from plain import damaged, repaired

from tallyframe.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def plan_by_rows(symbols):
    """The same plan with one matrix step per row and no runs."""
    back = [("", "II", "I", "")]
    back = [[(3 * len(x), x) for x in back[0]]]
    for symbol in reversed(symbols):
        use = [min((c + back[-1][q][0], x + back[-1][q][1]) for x, c, q in R.edits(symbol, p)) for p in range(4)]
        nxt = R.NEXT
        back.append([min(use[p], (3 + use[nxt[p]][0], "I" + use[nxt[p]][1]), (6 + use[nxt[nxt[p]]][0], "II" + use[nxt[nxt[p]]][1])) for p in range(4)])
    return back[-1][0]


@pytest.mark.parametrize("seed", range(20))
def test_runs_give_the_plan_of_single_rows(seed):
    rng = random.Random(seed)
    runs = []
    for _ in range(rng.randrange(0, 12)):
        symbol = (rng.choice("suax"), rng.randrange(3))
        if not runs or runs[-1][0] != symbol:
            runs.append((symbol, rng.choice([1, 1, 2, 3, 5, 70, 1000])))
    assert R.plan(runs) == plan_by_rows([s for s, n in runs for _ in range(n)])


def test_a_very_long_run():
    cost, audit = R.plan([(("u", R.SOUND), 1 << 17)])
    assert cost == 3 * (1 << 16) and audit == "KR" * (1 << 16)


def rows():
    rng = random.Random(2)
    texts = ["Yes.", "no", "What?", "", " \n", None, "Go on! ", "x" * 50000 + ".", "a | b"]
    out = []
    for conv in range(60):
        n = rng.randrange(1, 9)
        out += [(conv, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]), rng.choice(texts), "x") for t in range(n) if rng.random() < 0.9]
    out += [(None, 0, "user", "Hi.", "x"), (None, None, "assistant", "Yo.", "x"), (900, None, "user", "q?", "x"), (900, None, "user", "q?", "x")]
    out += [(901, 3, "user", "b.", "x"), (901, 3, "assistant", "a.", "x"), (901, 9, "user", "c", "x"), (-902, 0, "user", "d.", "x")]
    return out + [out[0]] * 2


def test_against_a_search_over_scripts(spark):
    source = rows()
    found = {r.conv_id: tuple(r)[1:] for r in R.repair_conversations(R.damage(spark.createDataFrame(source, SCHEMA))).collect()}
    left = damaged(r[:4] for r in source)
    assert set(found) == {r[0] for r in source}
    for conv, got in found.items():
        assert got == repaired([r for r in left if r[0] == conv]), conv


def test_repaired_rows_alternate(spark):
    damaged_rows = R.damage(spark.createDataFrame(rows(), SCHEMA))
    by = {}
    for r in R.repair(damaged_rows, R.plans(damaged_rows)).collect():
        by.setdefault(r.conv_id, []).append((r.place, r.role))
    for turns in by.values():
        turns.sort()
        assert [p for p, _ in turns] == list(range(1, len(turns) + 1))
        roles = "".join(role[0] for _, role in turns)
        assert roles.removeprefix("s") == "ua" * (len(roles.removeprefix("s")) // 2)


def test_empty_table(spark):
    assert R.repair_conversations(R.damage(spark.createDataFrame([], SCHEMA))).collect() == []

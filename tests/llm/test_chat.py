"""Snapshot collapse against Python on turn lists."""

import random

from ragscope.llm.chat import collapse_and_render


def brute(rows):
    convs, alone = {}, []
    for c, turn, role, text in rows:
        if c is None:
            alone.append((turn, role, text))
        else:
            convs.setdefault(c, set()).add((turn, role, text))
    key = lambda t: tuple((x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(t))
    lists = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in convs.items()}
    lists.update({("alone", t): [t[1:]] for t in set(alone)})
    out = []
    groups = {}
    for c, l in lists.items():
        groups.setdefault(tuple(l), []).append(c)
    for l, ids in groups.items():
        if any(len(o) > len(l) and o[: len(l)] == l for o in groups):
            continue
        first = min((i for i in ids if not isinstance(i, tuple)), default=None)
        out.append((first, len(l), len(ids), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in l)))
    return sorted(out, key=str)


def test_collapse(spark):
    rng = random.Random(5)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 1000])) for _ in range(rng.randint(1, 9))] for _ in range(30)]
    rows = []
    for c in range(200):
        b = rng.choice(base)
        rows += [(c, i, *t) for i, t in enumerate(b[: rng.randint(1, len(b))])]
    rows += rows[:20] + [(None, 0, "user", "x"), (None, 0, "user", "y"), (None, None, None, None), (500, None, "user", "z"), (501, 1, "user", "p"), (501, 1, "user", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(4)
    out = collapse_and_render(df).collect()
    assert sorted(((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in out), key=str) == brute(rows)
    assert collapse_and_render(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    plan = collapse_and_render(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))

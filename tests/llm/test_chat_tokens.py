import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from findlight.llm import chat_tokens as ct


def want(rows):
    """rows: (conv, turn, role, text)."""
    by, out = defaultdict(list), {}
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    for c, turns in by.items():
        turns.sort()
        all_turns = "".join(f"{r}\n{t}\n" for _, _, r, _, t in turns)
        loss = "".join(t for _, _, r, _, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(got):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_a_table_and_the_planted_conversation(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    got = ct.op7_chat_tokens(spark, sf).collect()
    assert digest(got) == want(rows) and len(got) == len(want(rows))
    assert all(r.formatted_chars > r.loss_chars for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = con.sql(ct.OP7_SQL)
    columns = sql.columns
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(sql.limit(10**6).fetchall())


def test_escapes_come_back():
    rng = random.Random(1)
    bits = [*ct.CONTROLS, "\\", "\\\\", "<", "turn>", "### ", "é", "\n", "<turn"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert ct.unescape(ct.escape(t)) == t
        shown = ct.escape(t)
        for c in ct.CONTROLS:
            for at in (i for i in range(len(shown)) if shown.startswith(c, i)):
                before = len(shown[:at]) - len(shown[:at].rstrip("\\"))
                assert before % 2 == 1


@pytest.mark.parametrize("part_ids", [1 << 20, 40])
def test_edges(spark, part_ids):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "dup"), (1, 1, "assistant", "dup"), (2, None, "assistant", ""), (None, 3, "assistant", "no id"), (3, 0, "assistant", "y " * 200_000), (4, 5, "tool", "<|endoftext|><turn>")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} </turn> \\") for i in range(500)]
    convs = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    made = ct.formatted(convs, part_ids=part_ids)
    assert digest(ct.read_back(made).collect()) == want(rows)
    if part_ids == 40:
        assert max(r.part for r in made.collect()) > 50
    assert ct.read_back(ct.formatted(convs.limit(0))).collect() == []

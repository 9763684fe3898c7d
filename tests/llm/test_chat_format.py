"""Chat formatting against plain loops."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import chat_format as C
from marginalia.llm.common import table

TEXT = st.lists(st.sampled_from([*"\\#< />:\nab", "</turn>", "### "]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_escape_round_trip(turns):
    formatted = "".join(C.format_turn(r, t)[0] for r, t in turns)
    assert list(C.parse_turns(formatted)) == turns
    for role, text in turns:
        turn, a, b = C.format_turn(role, text)
        assert C.unescape(turn[a:b]) == text


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    chats = C.format_paths(C.linear_messages(df))
    return sorted((tuple(r)[:5] for r in C.digests(chats).collect()), key=str)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", C.EXTRA_TEXT), (-7, 1, "assistant", C.EXTRA_TEXT)]
    result = C.op6_chat_format(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in result), key=str) == want(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (2, None, "assistant", "y\\"), (2, 3, "assistant", ""), (None, 1, "a: b", "</turn>\n### "), (3, 1, "assistant", "long " * 100000), (3, 2, "user", "z" * 300000), (3, 3, "assistant", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as c", "2 as message", "3 as position", "4 as score")
    assert got(df) == want(rows)
    assert got(df.limit(0)) == []


def test_long_conversation(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    assert got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == want(rows)


def test_trees_rank_paths(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(6):
        for m in range(1, 40):
            rows.append((conv, m, None if m == 1 or rng.random() < 0.05 else rng.randrange(1, m), "user", f"m{m}", rng.random()))
    rows.append((9, 1, 77, "user", "orphan", 0.5))
    df = spark.createDataFrame(rows, "conv_id long, message long, parent long, role string, text string, score double")
    expected = {}
    for conv in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in nodes.values()}
        found = []
        for leaf in nodes.keys() - inner:
            path = [leaf]
            while nodes[path[-1]][2] in nodes:
                path.append(nodes[path[-1]][2])
            found.append((sum(nodes[m][5] for m in path) / len(path), len(path), leaf, path[::-1]))
        for rank, x in enumerate(sorted(found, key=lambda x: (-round(x[0], 12), -x[1], -x[2]))[:3]):
            expected[conv, rank] = [f"m{m}" if conv < 9 else "orphan" for m in x[3]]
    result = {}
    for r in C.format_paths(df, best=3).collect():
        result.setdefault((r["conv_id"], r["path_rank"]), []).extend(t for _, t in C.parse_turns(r["formatted"]))
    assert result == expected

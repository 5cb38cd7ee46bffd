from llm_rows import by_row

from check_oracle import compare, connect
from tracewell.llm import chat
from tracewell.llm.queries import ORACLE_SQL, QUERIES

ROWS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bo", "Hello ann"), (1, 3, "cy", None), (1, 3, "cy", None),
        (1, None, None, "who?"), (2, 0, "system", "alone"), (None, 5, "ann", "x"), (None, 4, "bo", "y"), (3, 1, "ann", "é" * 50)]


def by_hand(rows, part):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3] or "")))
        for me in {r[2] for r in turns} - {None, "system"}:
            for k in range(0, len(turns), part):
                text, masks = "", []
                for _, _, who, said in turns[k:k + part]:
                    role = "system" if who == "system" else "assistant" if who == me else "user" + (f" name={who}" if who else "")
                    text += f"{chat.OPEN}{role}\n"
                    if who == me:
                        masks.append((len(text), len(text) + len(said or "") + len(chat.CLOSE)))
                    text += f"{said or ''}{chat.CLOSE}\n"
                out.append((conv, me, k // part, k, min(part, len(turns) - k), text, masks))
    return sorted(out, key=repr)


def test_by_hand(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, perspective string")
    for part in (64, 2):
        got = [(r.conv_id, r.perspective, r.part, r.first_turn, r.n_turns, r.text, [tuple(m) for m in r.masks])
               for r in chat.rotate(df, part=part).collect()]
        assert sorted(got, key=repr) == by_hand(ROWS, part)
    assert chat.rotate(df.limit(0)).count() == 0


def test_one_conversation_spans_partitions(spark):
    rows = [(7, i, "ab"[i % 2], f"t{i}") for i in range(1000)] + [(7, 5, "b", "t5")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_row(chat.rotate(df), "perspective", "part", "first_turn", "n_turns", "text")
    assert got == sorted([(x[1], x[2], x[3], x[4], x[5]) for x in by_hand(rows, chat.PART)], key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op5_perspective_rotation"](spark, sf), connect(sf), ORACLE_SQL["op5_perspective_rotation"]) is None

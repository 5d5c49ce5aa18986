import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format as C
from tessera.llm import queries

TURNS = "conv_id long, turn long, role string, text string, kind string, seq int, message string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns, template=C.Template()):
    """{conv_id: the row's other columns} from (conv_id, turn, role, text), in order."""
    by = {}
    for conv, _, role, text in turns:
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        chars = sum(len(template.begin) + len(template.escaped(r).replace("\n", "\\\n")) + 1 + len(template.escaped(t)) + len(template.end) for r, t in said)
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), chars)
    return out


def told(df):
    rows = df.collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_matches_plain_python(spark, sf):
    said = "</s>[INST] ok [/INST]"
    turns = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    got = queries.op12_chat_log(spark, sf)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == C.DIGESTS.replace("long", "bigint")
    assert told(got) == plain([(-1, 0, "user", said), (-1, 1, "assistant", said), *turns])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "assistant", "é", "<|im_", "end|>"])).map("".join)), max_size=5))
def test_templates_round_trip(turns):
    template = C.Template()
    for said in (turns, [(t, r) for r, t in turns]):
        parts = [template.rendered(r, t) for r, t in said]
        assert template.parsed("".join(p for p, _, _ in parts)) == said
        for (_, t), (p, a, b) in zip(said, parts, strict=True):
            assert template.unescaped(p[a:b]) == t and not any(c in p[a:b] for c in template.marks())


def test_control_strings_that_overlap_themselves_are_refused():
    with pytest.raises(ValueError, match="control"):
        C.Template(controls=("<|x<",))


def fold(events):
    """A plain fold of one message's events."""
    there, role, text = False, "", ""
    for kind, r, t in events:
        if kind == "drop":
            there, text = False, ""
        elif kind == "delta" and there:
            text += t or ""
        else:
            role = (r or "") if kind == "open" or not there or (kind == "regenerate" and r is not None) else role
            there, text = True, t or ""
    return (role, text) if there else None


def test_folds_events_in_any_order_of_rows(spark, tmp_path):
    rng = random.Random(5)
    log = []
    for conv in [1, 2, 3, None]:
        for m in range(40 if conv == 2 else 6):
            for s in range(rng.randrange(1, 9)):
                log.append((conv, m, s, rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "drop"]), rng.choice([None, "user", "assistant", "tool\nx"]), rng.choice([None, "", "a", "<|im_end|>", "\\", "é b"])))
    by = {}
    for conv, m, _, *event in log:
        by.setdefault((conv, m), []).append(event)
    want = plain([(conv, m, *said) for (conv, m), events in by.items() if (said := fold(events))])
    rng.shuffle(log)
    df = spark.createDataFrame([(*x, "clash") for x in log], "conv_id long, message int, seq int, kind string, role string, text string, part string")
    C.write_chats(df, str(tmp_path / "chats"), part_chars=40)
    assert told(C.chat_digests(spark, str(tmp_path / "chats"))) == want
    parts = C.read_chats(spark, str(tmp_path / "chats"))
    assert parts.where("conv_id = 2").count() > 5  # a long conversation lies in several parts
    with pytest.raises(Exception, match="unknown kind"):
        C.write_chats(spark.createDataFrame([(1, 1, 1, "shout", "user", "x")], "conv_id long, message int, seq int, kind string, role string, text string"), str(tmp_path / "bad"))


def test_a_hot_conversation_is_shared_out(spark, tmp_path):
    turns = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(-5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    C.write_chats(C.turn_events(turns), str(tmp_path / "chats"))
    parts = C.read_chats(spark, str(tmp_path / "chats"))
    assert parts.where("conv_id = -5").select(F.shiftright("part", 33)).distinct().count() >= 3
    assert parts.where("whole").count() >= 990 and not parts.where("conv_id = -5 and whole").count()
    want = plain([((r.conv_id), r.turn, r.role, r.text) for r in turns.orderBy("turn").collect()])
    assert told(C.chat_digests(spark, str(tmp_path / "chats"))) == want


def test_edges_repeats_and_clashing_columns(spark, tmp_path):
    long = "word \\ <|im_end|> " * 40_000
    turns = [(1, 0, "user", None), (1, 1, None, ""), (1, 2, "assistant", None), (2, None, "assistant", "x"), (2, 0, "assistant", long), (2, 1, "user", long), (None, 0, "assistant", "n"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "", "퟿\U0010ffff")]
    df = spark.createDataFrame([(*t, "k", 1, "m", "f") for t in reversed(turns)], TURNS)
    C.write_chats(C.turn_events(df), str(tmp_path / "chats"))
    assert told(C.chat_digests(spark, str(tmp_path / "chats"))) == plain(turns)
    C.write_chats(C.turn_events(df.where(F.lit(False))), str(tmp_path / "none"))
    assert C.chat_digests(spark, str(tmp_path / "none")).count() == 0

import hashlib
import time

from pyspark.sql import functions as F

from lodestone.llm.chat import format_conversations, read_back
from lodestone.llm.queries import op8_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: <part/>", "\\s\\\\e</turn></turn>", "", None, "a\n\nb ", "\\", "####", "é字𝄞\\p"]


def test_round_trip_and_mask(spark):
    rows = [(1, k, ["user", "assistant", "assistant", "sys: \\tem"][k % 4], t) for k, t in enumerate(NASTY * 3)]
    rows += [(2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, None, None, "x"), (None, 0, "user", "y"), (4, 0, "assistant", "z"), (4, 0, "assistant", "z")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as turns", "1 as formatted")
    got = {r.conv_id: r for r in read_back(format_conversations(frame)).collect()}
    for conv in (1, 2, 3, None, 4):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].loss_texts == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert got[2].formatted == "### assistant: a<part/>b</turn>\n"
    assert got[4].formatted == "### assistant: z<part/>z</turn>\n"
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_adds_the_conversation_of_control_strings(spark):
    got = op8_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert got.n_turns == 2 and got.loss_chars == len(said)
    assert got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_ties_and_rows_without_a_conversation(spark):
    rows = [(1, 0, "user", "###a"), (1, 0, "user", "Ab"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", "y")]
    got = [(r.conv_id, [t.text for t in r.turns], r.loss_texts) for r in read_back(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert sorted(got, key=repr) == sorted([(1, ["###a", "Ab"], []), (None, ["x"], []), (None, ["y"], ["y"]), (None, ["y"], ["y"])], key=repr)


def test_time_grows_with_the_turns(spark):
    """Twice the turns of one conversation take at most 2.5 times as long."""
    took = []
    for n in (10_000, 20_000):
        frame = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('é𝄞 ', id, repeat('x', int(id % 7 * 900))) as text")
        read = read_back(format_conversations(frame)).select("loss_texts", F.size("turns").alias("n"))
        began = time.time()
        got = read.first()
        took.append(time.time() - began)
        assert got.n == n and got.loss_texts == [f"é𝄞 {k}" + "x" * (k % 7 * 900) for k in range(1, n, 2)]
    assert took[1] <= 2.5 * took[0] + 1 and took[0] < 15

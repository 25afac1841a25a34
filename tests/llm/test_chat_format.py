import hashlib

from lorespark.llm import chat_format
from lorespark.llm.queries import IMITATION

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "#####</turn></turn>\n### User: x"), (1, 2, "assistant", "\\h \\e \\b \\\\"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (3, 1, "User", "not the usual: role"), (3, 1, None, "no role"), (3, None, "a: \\r###", "  "),
    (4, 0, "user", "twice"), (4, 0, "user", "twice"), (4, 1, "assistant", "é\U0001f600" * 3000), (None, 0, "assistant", "lost"), (-7, 0, "user", IMITATION), (-7, 1, "assistant", IMITATION),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_everything_is_read_back(spark):
    frame = spark.createDataFrame([(*turn, "clash") for turn in reversed(TURNS)], SCHEMA)
    examples = chat_format.format_conversations(frame).cache()
    found = {row.conv_id: row for row in chat_format.digests(examples).collect()}
    key = lambda turn: tuple((part is not None, part or "" if index else part or 0) for index, part in enumerate(turn))
    for conv in {turn[0] for turn in TURNS}:
        turns = sorted(((number, role or "", text or "") for one, number, role, text in TURNS if one == conv), key=key)
        replies = [text for _, role, text in turns if role == "assistant"]
        row = found[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert (row.loss_chars, row.loss_sha256) == (len("".join(replies)), sha("".join(replies)))
        mine = examples.filter(examples.conv_id.eqNullSafe(conv)).orderBy("example").collect()
        assert len(mine) == len(replies) + (turns[-1][1] != "assistant")
        assert row.formatted_chars == sum(len(one.formatted) for one in mine)
        for one in mine:
            assert one.formatted.count("</turn>") == one.formatted.count("</turn>\n")
            assert mine[-1].formatted.startswith(one.formatted)
            assert one.loss_start is None or one.formatted[one.loss_start + one.loss_length :] == "</turn>\n"
    examples.unpersist()


def test_empty_table(spark):
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []

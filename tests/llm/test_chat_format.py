import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.chat_format import GrammarError, format_conversations, parse, read_back, render, unescape

HARD = st.text(alphabet=st.sampled_from(list("\\#/<>tur n:\n ")), max_size=12)
PIECES = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "#", " ", ":", "</turn>\n", "a", "### user:\n"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(HARD, PIECES), st.one_of(HARD, PIECES)), max_size=4))
def test_round_trip(turns):
    text = render(turns)
    back, spans = parse(text)
    assert back == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_plain_text_is_not_escaped():
    assert render([("user", r"\alpha #1 \n")]) == "### user:\n\\alpha #1 \\n</turn>\n"
    for broken in ("x", "### user:\nno end", "### a ### b:\nx</turn>\n", "### u:\nx</turn>y"):
        with pytest.raises(GrammarError):
            parse(broken)


def test_table(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", said), (2, 1, "assistant", None), (None, 0, None, "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "é" * 30_000), (4, 1, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS formatted").repartition(3)
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (len(said), sha(said)) and got[3].n_turns == 2 and got[4].loss_chars == 30_000
    assert got[None].turns_sha256 == sha("\nx\n") and got[None].loss_chars == 0
    assert read_back(format_conversations(df.limit(0))).count() == 0

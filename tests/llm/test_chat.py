import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stranda.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, formatted string"
nasty = st.text(alphabet="<|\\>imsatrend_\nxé", max_size=40)


@given(nasty)
@settings(max_examples=400)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


@given(st.lists(st.tuples(nasty, nasty), max_size=6))
@settings(max_examples=200)
def test_spans_cover_the_texts(turns):
    assert C.parse(C.render(turns)) == turns
    made = C.Rendered(C.render, turns)
    assert made.text == C.render(turns) and not made.rewrites
    for (_, text), span in zip(turns, made.spans, strict=True):
        assert C.unescape(made.text[span[2] : span[3]]) == text


def test_templates_that_rewrite_history_are_found():
    moves_system = lambda turns: "".join(t for r, t in turns if r == "system") + "".join(f"[{r}]{t}\n" for r, t in turns if r != "system")
    made = C.Rendered(moves_system, [("user", "hi"), ("assistant", "yo"), ("system", "be good"), ("user", "ok")])
    assert made.rewrites == [2] and made.spans[2] is None and made.spans[3] is not None
    drops_old = lambda turns: "".join(f"[{r}]{t}\n" for r, t in turns[-1:])
    assert C.Rendered(drops_old, [("user", "a"), ("user", "b"), ("user", "c")]).rewrites == [1, 2]


def test_rewrites_are_found_however_far_back_they_reach(spark):
    def drops_second_of_many(turns):
        return "".join(f"[{r}]{t}\n" for k, (r, t) in enumerate(turns) if k != 1 or len(turns) < 700)

    turns = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", 0, "") for i in range(705)]
    row = C.format_conversations(spark.createDataFrame(turns, SCHEMA), drops_second_of_many).collect()
    assert len(row) == 1 and row[0].rewrites == 1 and row[0].formatted == drops_second_of_many([t[2:4] for t in turns])
    assert [row[0].formatted[a:b] for a, b in zip(row[0].loss_starts, row[0].loss_ends, strict=True)][-2:] == ["turn 701", "turn 703"]


def test_a_template_wrongly_declared_additive_is_an_error(spark):
    def numbered(turns):
        return "".join(f"{k}{r}:{t}\n" for k, (r, t) in enumerate(turns))

    numbered.additive = True
    with pytest.raises(ValueError, match="additive"):
        C.Added(numbered, [("user", "a"), ("user", "b")], {})


@given(st.lists(st.tuples(nasty, nasty), max_size=6))
@settings(max_examples=100)
def test_additive_rendering_agrees_with_all_prefixes(turns):
    one, other = C.Rendered(C.render, turns), C.Added(C.render, turns, {})
    assert (one.text, one.spans, one.rewrites) == (other.text, other.spans, other.rewrites)


@pytest.mark.parametrize("additive", [False, True])
def test_each_successive_prefix_is_rendered_whole(spark, tmp_path, additive):
    calls = str(tmp_path / "calls")

    def watched(turns):
        with open(calls, "a") as f:
            f.write(f"{len(turns)}\n")
        return C.render(turns)

    watched.additive = additive
    turns = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", 0, "") for i in range(300)]
    rows = C.format_conversations(spark.createDataFrame(turns, SCHEMA), watched).orderBy("part").collect()
    assert "".join(r.formatted for r in rows) == C.render([t[2:4] for t in turns])
    with open(calls) as f:
        assert set(range(1, 301)) <= {int(n) for n in f}


def test_an_additive_template_that_rewrites_far_back_is_an_error():
    def drops_second_of_many(turns):
        return "".join(f"[{r}]{t}\n" for k, (r, t) in enumerate(turns) if k != 1 or len(turns) < 700)

    drops_second_of_many.additive = True
    turns = [("user", f"turn {i}") for i in range(705)]
    C.Added(drops_second_of_many, turns[:699], {})
    with pytest.raises(ValueError, match="additive"):
        C.Added(drops_second_of_many, turns, {})


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.render(turns)))
    return out


ROWS = [
    (1, 0, "user", C.HOSTILE),
    (1, 1, "assistant", C.HOSTILE),
    (1, 2, "assistant", None),
    (2, None, None, "x"),
    (2, 0, "assistant", "é<|\\"),
    (3, 5, "user", "same"),
    (3, 5, "user", "same"),
    (3, 5, "assistant", ""),
    (None, 0, "assistant", "nobody's"),
    (4, 0, "assistant", "l" * 200_000),
] + [(5, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(40)]


@pytest.mark.parametrize("segment", [C.SEGMENT, 3, 1])
def test_digests_match_plain_ones(spark, segment):
    df = spark.createDataFrame([(*r, 9, "clash") for r in reversed(ROWS)], SCHEMA)
    got = C.digests(C.format_conversations(df, segment=segment)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == plain(ROWS)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.format_conversations(none)).count() == 0

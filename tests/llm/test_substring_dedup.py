import random
import re

import pytest

from millrace.llm.substring_dedup import SENTENCE_WORDS, substring_dedup

P = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu. Xi omicron pi rho sigma tau upsilon. Phi chi psi omega one two. Three four five six seven."


def brute(rows, run=3, least=25):
    """Texts after removal, by slices of strings."""
    parsed = []
    for d, t in rows:
        out, begin, n = [], None, 0
        for m in re.finditer(r"[^\x20\x09-\x0d]+", t or "", re.A):
            if begin is None:
                begin, words = m.start(), []
            words.append(m[0].lower())
            gap = re.match(r"[\x20\x09-\x0d]*", t[m.end() :])[0]
            if len(words) == SENTENCE_WORDS or m[0][-1] in ".!?" or "\n" in gap:
                out.append((begin, tuple(words)))
                begin = None
        if begin is not None:
            out.append((begin, tuple(words)))
        parsed.append(out)
    first = {}
    for (d, _), s in sorted(zip(rows, parsed, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        for i in range(len(s) - run + 1):
            first.setdefault(tuple(w for _, w in s[i : i + run]), (d, i))
    result = []
    for (d, t), s in zip(rows, parsed, strict=True):
        gone = set()
        for i in range(len(s) - run + 1):
            if first[tuple(w for _, w in s[i : i + run])] != (d, i):
                gone.update(range(i, i + run))
        starts = [b for b, _ in s] + [len(t or "")]
        left, pos, i, n = [], 0, 0, 0
        while i < len(s):
            j = i
            while j in gone:
                j += 1
            if j > i and sum(len(w) for _, w in s[i:j]) >= least:
                left.append(t[pos : starts[i]])
                pos, n = starts[j], n + j - i
            i = max(j, i + 1)
        result.append((d, None if t is None else "".join(left) + t[pos:], n))
    return sorted(result, key=repr)


@pytest.mark.parametrize("least", [0, 25])
def test_against_brute_force(spark, least):
    other = "Nothing to see here at all. Move on please now. Thank you very much."
    rows = [
        (3, f"Start of three. {P} End of three."), (1, f"{P}\n{other}"), (2, f"{other} {P} {P}"), (4, P), (4, P), (5, None), (6, ""), (7, "One. Two. Three. One. Two. Three."),
        (8, "word " * 400), (9, f"éÉ. {P.upper()}"), (None, P), (10, "One. Two. Three."), (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z\n" * 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS rank", "3 AS first").repartition(3)
    got = substring_dedup(df, least_words=least, by_content=False).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == brute(rows, least=least)
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == 0 and by[3].first_in == [1] and by[4].text == "" and by[7].n_removed == (0 if least else 3) and by[10].n_removed == (0 if least else 3)
    assert "".join(by[3].removed).startswith("Alpha beta") and by[3].text == "Start of three. End of three."


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_passages_are_found_wherever_they_begin(spark, tmp_path):
    from millrace.llm.queries import op1_substring_dedup

    r = random.Random(3)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, doc = [], 0
    for sizes in [(60,), (51,), (27, 24), (12, 12, 12, 15), (13, 13, 13, 12), (25, 26), (12, 39), (7, 30, 14), (300,)] * 12:
        passage = [x for n in sizes for x in [*new(n - 1), new(1)[0] + "."]]
        passage[-1] = passage[-1].rstrip(".")
        for _ in range(2):
            rows.append((doc, " ".join([*new(r.randrange(1, 12)), *passage, *new(r.randrange(1, 12))]) + "."))
            doc += 1
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(got[d].n_removed == 0 for d in range(0, doc, 2))
    assert [d for d in range(1, doc, 2) if not got[d].n_removed] == []
    assert all(len(" ".join(got[d].removed).split()) >= 25 for d in range(1, doc, 2))
    assert all(got[d].first_in == [d - 1] for d in range(1, doc, 2))


def test_query_removes_short_stretches_and_scripts_without_spaces(spark, tmp_path):
    from millrace.llm.queries import op1_substring_dedup

    short, lines = "Alpha beta gamma. Delta epsilon. Zeta eta theta.", "春眠不覚暁\n処処聞啼鳥\n夜来風雨声\n花落知多少\n"
    rows = [(1, f"{short} One more here."), (2, f"Begin of two. {short} End of two."), (3, lines), (4, f"題\n{lines}終"), (5, "Alpha beta gamma. Delta epsilon.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[d].n_removed for d in range(1, 6)] == [0, 3, 0, 4, 0]
    assert got[2].text == "Begin of two. End of two." and got[4].text == "題\n終" and got[4].first_in == [3]


def test_documents_without_an_id_are_documents_of_their_own(spark):
    other = "Nothing to see here at all. Move on please now. Thank you very much."
    rows = [(None, f"{other} First tail."), (None, f"{other} Second tail."), (None, f"{other} Second tail."), (None, f"Third head. {P}"), (1, P)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = sorted(r.text for r in got if r.doc_id is None)
    assert sum(other in x for x in left) in (1, 2) and "Third head. " in left and next(r for r in got if r.doc_id == 1).n_removed == 0
    assert all(r.first_in == ([1] if "Third" in r.text else []) for r in got if r.doc_id is None)


def test_frequent_runs_are_joined_as_well(spark, monkeypatch):
    import millrace.llm._skew as skew
    import millrace.llm.substring_dedup as m

    rows = [(i, f"Text {i}. {P} More of {i}. Other {i % 7}. Seven {i % 7}. Eight {i % 7}.") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows_of = lambda: sorted(map(tuple, substring_dedup(df).select("doc_id", "text", "n_removed", "first_in").collect()))
    whole = rows_of()
    monkeypatch.setattr(m, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    assert rows_of() == whole and sum(n for _, _, n, _ in whole) >= 119 * 5


def test_other_columns_are_ignored_whatever_their_names(spark):
    rows = [(1, f"{P} One tail."), (2, f"{P} Two tail."), (2, f"{P} Two tail."), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    odd = df.selectExpr("*", "1 AS run", "'x' AS place", "2 AS key", "3 AS first", "4 AS n_removed", "array(5) AS removed", "6 AS words")
    out, plain = substring_dedup(odd), substring_dedup(df)
    assert out.columns == plain.columns == ["doc_id", "text", "n_sentences", "n_removed", "removed", "first_in"]
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect())) and out.agg({"n_removed": "max"}).first()[0] > 0


def test_sizes_of_sentences_and_parts_are_the_callers(spark):
    import random

    import pytest

    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = [(i, f"{' '.join(r.choice(words) for _ in range(5 + i))} {passage} {' '.join(r.choice(words) for _ in range(5))}.") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = lambda **options: sum(len(" ".join(x.removed).split()) for x in substring_dedup(df, **options).collect())
    plain, longer, coarse = gone(), gone(part_words=45), gone(sentence_words=20)
    assert plain > 11 * 35 and longer <= plain and gone(part_words=100) == 0 and coarse > 0
    for bad in (0, 23):
        with pytest.raises(ValueError, match="sentence_words"):
            substring_dedup(df, sentence_words=bad)

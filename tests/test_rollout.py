from pyspark.sql import functions as F

from millrace.operators.rollout import NumberGame, SearchTurns, TurnRollouts, completed_from, episodes_of


def games(spark, path, most=None):
    """Ten players that count upwards from their number; the third never says one, the fifth falls silent."""
    episodes = spark.createDataFrame([(p, 6) for p in range(10)], "player int, gold int")
    rows = [(p, turn, "no number" if p == 3 else f"Guess: {p + turn}") for p in range(10) for turn in range(12) if not (p == 5 and turn == 0)]
    known = spark.createDataFrame(rows, "player int, turn int, completion string")
    return TurnRollouts(str(path), completed_from(known, ["player", "turn"]), NumberGame(most=8), most), episodes


def test_episodes_end_one_by_one(spark, tmp_path):
    loop, episodes = games(spark, tmp_path)
    steps = loop.run(episodes)
    got = {r.player: (r.turns, r.total_reward, r.unanswered) for r in episodes_of(steps, ["player"]).collect()}
    want = {p: (7 - p, 1.0, False) for p in (0, 1, 2, 4, 6)} | {p: (8, 0.0, False) for p in (7, 8, 9)} | {3: (8, -8.0, False), 5: (1, 0.0, True)}
    assert got == want
    last = steps.where("player = 4 AND turn = 2").first()
    assert last.prompt == "Guess the number.\nGuess: 4\nToo low\nGuess: 5\nToo low\n" and last.done
    assert steps.where("turn = 3").count() == 7  # players 4, 5 and 6 have left


def test_a_run_that_stops_goes_on(spark, tmp_path):
    whole = games(spark, tmp_path / "whole")
    want = sorted(map(str, whole[0].run(whole[1]).collect()))
    for _ in range(3):
        loop, episodes = games(spark, tmp_path / "parts", most=2)
        loop.run(episodes)
    assert 0 < loop.live(spark) < 10
    # a round that was cut short is done again
    for f in (tmp_path / "parts" / "steps" / "round=5").glob("*SUCCESS*"):
        f.unlink()
    loop, episodes = games(spark, tmp_path / "parts")
    assert sorted(map(str, loop.run(episodes).collect())) == want and loop.live(spark) == 0


def test_no_episodes(spark, tmp_path):
    loop, episodes = games(spark, tmp_path)
    assert loop.run(episodes.limit(0)).count() == 0


def test_searches_fail_or_answer(spark, tmp_path):
    episodes = spark.createDataFrame([(k, f"question {k}", ["Eiffel Tower"]) for k in range(6)], "id int, question string, gold array<string>")
    turns = [(0, 0, "look", ["search"], "a"), (0, 1, "Answer: the eiffel  Tower!", None, None), (1, 0, "look", [], "a"), (2, 0, "look", ["search"], "unknown"), (3, 0, "Answer: no", None, None), (4, 0, "look", ["search"], "a"), (4, 1, "look", ["search"], "a"), (4, 2, "look", ["search"], "a")]
    known = spark.createDataFrame(turns, "id int, turn int, completion string, tools array<string>, query string").withColumn("parsed", F.lit(True))
    results = spark.createDataFrame([("a", ["one", "two"])], "query string, documents array<string>")
    loop = TurnRollouts(str(tmp_path), completed_from(known, ["id", "turn"]), SearchTurns(results, most_calls=2))
    steps = loop.run(episodes)
    got = {r.id: (r.turns, r.total_reward, r.unanswered) for r in episodes_of(steps, ["id"]).collect()}
    assert got == {0: (2, 1.0, False), 1: (1, 0.0, False), 2: (1, 0.0, False), 3: (1, 0.0, False), 4: (3, 0.0, False), 5: (1, 0.0, True)}
    assert steps.where("id = 0 AND turn = 1").first().prompt == "question 0\nlook\none\ntwo\n"
    assert {r.id for r in steps.where("failed").collect()} == {1, 2, 4}

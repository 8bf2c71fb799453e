from clipgrain.plans import queries


def test_every_turn_gives_tokens(spark, tmp_path):
    turns = [(1, 0, "user", "tad"), (1, 1, "assistant", "sad"), (1, 2, "user", None), (3, 0, "user", "t a"), (3, 7, "user", "s"), (None, 2, "user", "a")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {}
    for r in queries.queries()["transcript_tokens"](spark, str(tmp_path)).orderBy("conv_id", "turn", "position").collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append(r["symbol"])
    assert found == {(1, 0): ["t", "a", "d"], (1, 1): ["s", "a", "d"], (3, 0): ["t", "a"], (3, 7): ["s"], (None, 2): ["a"]}

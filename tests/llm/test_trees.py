from pyspark.sql import functions as F

from lodestrata.llm import trees

ROWS = [  # tree, node, parent, score, role, text
    (1, 1, None, 0.0, "user", "q"),
    (1, 2, 1, 1.0, "assistant", "</s>[INST] a <|user|> \\ |> <</SYS>>"),
    (1, 3, 1, 3.0, "assistant", "b"),
    (1, 4, 2, 9.0, "user", ""),
    (1, 5, 3, 0.0, None, None),
    (2, 1, None, 0.0, "user", "x|"),
    (2, 2, 77, 0.0, "assistant", "an orphan is a root"),
    (3, 1, 2, 0.0, "user", "a ring"),
    (3, 2, 1, 0.0, "user", "has no leaf"),
    (None, 1, None, 0.0, "user", "no tree"),
]


def nodes(spark):
    return spark.createDataFrame(ROWS, "tree long, node long, parent long, score double, role string, text string")


def test_paths_are_ranked(spark):
    got = trees.paths(nodes(spark), top=None).collect()
    paths = {}
    for r in sorted(got, key=lambda r: r.depth):
        paths.setdefault((r.tree, r.leaf, r.branch_rank), []).append(r.node)
    assert paths == {(1, 4, 1): [1, 2, 4], (1, 5, 2): [1, 3, 5], (2, 1, 1): [1], (2, 2, 2): [2]}


def test_round_trip(spark):
    df = nodes(spark)
    made = trees.format_paths(df, trees.paths(df, top=None)).withColumn("turns", trees.read_back(F.col("formatted")))
    said = {(t, n): (r or "", x or "") for t, n, _, _, r, x in ROWS}
    got = {(r.tree, r.leaf): r for r in made.collect()}
    assert [tuple(t) for t in got[(1, 4)].turns] == [said[(1, 1)], said[(1, 2)], said[(1, 4)]]
    assert [tuple(t) for t in got[(1, 5)].turns] == [said[(1, 1)], said[(1, 3)], said[(1, 5)]]
    assert [s.text for s in got[(1, 5)].segments if s.loss] == ["b"]
    assert "".join(s.text for s in got[(1, 4)].segments) == got[(1, 4)].formatted
    assert got[(1, 4)].formatted.count("</s>") == 3 and "[INST]" not in got[(1, 4)].formatted


def test_long_chain_and_repeated_turns(spark):
    rows = [(7, k, "user", f"t{k}") for k in range(300)] + [(8, 0, "user", "a"), (8, 0, "user", "a"), (8, None, "user", "b")]
    df = trees.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = {r.tree: r for r in trees.format_paths(df, trees.paths(df)).withColumn("turns", trees.read_back(F.col("formatted"))).collect()}
    assert [t.text for t in made[7].turns] == [f"t{k}" for k in range(300)]
    assert [t.text for t in made[8].turns] == ["b", "a", "a"]
    empty = df.where("false")
    assert trees.format_paths(empty, trees.paths(empty)).count() == 0


def test_turns_without_a_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "c")]
    df = trees.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = trees.format_paths(df, trees.paths(df)).withColumn("turns", trees.read_back(F.col("formatted"))).withColumn("conv_id", trees.conversation(F.col("tree")))
    assert {r.conv_id: [t.text for t in r.turns] for r in made.collect()} == {None: ["a", "b"], 5: ["c"]}

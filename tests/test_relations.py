"""Relations of names from text, by hand."""

from strandloom.operators import relations as r

NAMES = [("v", n, True) for n in ("HyperFrames", "Nova", "Higgsfield", "OpenBoard", "Runway")] + [("w", "HyperFrames", True)]


def tables(spark, texts, accepted=()):
    t = spark.createDataFrame([("v", i, x) for i, x in enumerate(texts)], "video string, pos int, text string")
    n = spark.createDataFrame(NAMES, "video string, name string, verified boolean")
    return t, n, spark.createDataFrame([("v", *a) for a in accepted], "video string, raw string, canonical string")


def graph(spark, *tables_):
    return {(x["product"], x["brand"]): x["weight"] for x in r.explicit_relations(*tables_).collect()}


def test_attributions_count_and_nearness_does_not(spark):
    t = tables(spark, ["Hyper Frames made by Nova here", "hyperframes from Novah now", "OpenBoard and Nova", "HyperFrames", "is", None, "built by Runway ML too", "OpenBoard by someone", "OpenBoard by Zed"], [("Runway ML", "Runway")])
    # the last row's brand is no name; the third row's tail reaches the attribution four rows on
    assert graph(spark, *t) == {("HyperFrames", "Nova"): 6, ("HyperFrames", "Runway"): 3, ("OpenBoard", "Runway"): 3}


def test_reach_and_own_name(spark):
    t = tables(spark, ["HyperFrames " + "x" * 200 + " by Nova", "OpenBoard by OpenBoard " + "y" * 200, "Higgsfield by Higsfield then"])
    assert graph(spark, *t) == {}


def test_unique_owner_and_composites(spark):
    t = tables(spark, ["Hyper Frames by Nova it is", "the Zed hyper frames", "OpenBoard by Nova or", "OpenBoard by Runway or", "my open board"])
    rel = r.explicit_relations(*t)
    assert {(x["product"], x["brand"]) for x in r.owner(rel).collect()} == {("HyperFrames", "Nova")}
    phrases = spark.createDataFrame([("v", "Zed hyper frames"), ("v", "my open board"), ("v", "unheard hyper frames"), ("w", "Zed hyper frames")], "video string, raw string")
    assert [tuple(x) for x in r.composite_names(phrases, rel, t[0], t[1]).collect()] == [("v", "Zed hyper frames", "Nova's HyperFrames")]

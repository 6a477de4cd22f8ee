from flightperf.llm import decontam as D

ITEM = "Yesterday Tom bought 12 kg of apples for 30 dollars, and then Tom sold 5 kg of them to Ann at the market."


def leaks(spark, docs, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r for r in D.leaks(docs, bench).collect()}


def doc(i, text):
    return (i, text, "en", "a", 1)


def test_templates(spark):
    df = spark.createDataFrame([("We met Ann, who had 3.5 kg (7 lb) here. Then Bob left",)], "text string")
    got = df.select(D.template("text").alias("t"), D.raw_tokens("text").alias("r")).first()
    n, u, p = D.NUM, D.UNIT, D.NAME
    assert got["t"] == ["we", "met", p, "who", "had", n, u, n, u, "here", "then", p, "left"]
    assert got["r"] == ["we", "met", "ann", "who", "had", "3.5", "kg", "7", "lb", "here", "then", "bob", "left"]


def test_exact_and_reparameterised_questions_leak(spark, table):
    docs = table([
        doc(1, "Intro words come first. " + ITEM + " More follows."),
        doc(2, "Yesterday Eve bought 9 lb of apples for 4 euros, and then Eve sold 2 lb of them to Joe at the market."),
        # slots that do not agree: Tom is Eve once and Max once
        doc(3, "Yesterday Eve bought 9 lb of apples for 4 euros, and then Max sold 2 lb of them to Joe at the market."),
        doc(4, "Yesterday was a day of apples, and at the market nobody sold any of them."),
        doc(5, None), doc(6, ""), doc(1, "Intro words come first. " + ITEM + " More follows."),
        doc(None, ITEM.upper().title() if False else ITEM)])
    got = leaks(spark, docs, [(10, ITEM), (10, ITEM), (11, None), (12, ""), (None, "an unrelated item about nothing else at all")])
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert got[(1, 10)]["n_windows"] == got[(1, 10)]["item_windows"] and got[(2, 10)]["n_slots"] > 0


def test_part_of_an_item_needs_half_its_windows(spark, table):
    words = ITEM.split()
    docs = table([doc(1, " ".join(words[:18])), doc(2, " ".join(words[:8]))])
    assert set(leaks(spark, docs, [(1, ITEM)])) == {(1, 1)}


def test_short_items_must_agree_in_their_slots(spark, table):
    docs = table([doc(1, "so Tom has 5 pies"), doc(2, "so Eve has 7 pies")])
    assert set(leaks(spark, docs, [(1, "so Tom has 5")])) == {(1, 1)}


def test_shuffled_and_broadcast_windows_agree(spark, table):
    docs = table([doc(1, ITEM), doc(2, "x " + ITEM), doc(3, "nothing")])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    a, b = (sorted(map(tuple, D.leaks(docs, bench, broadcast_windows=n).collect())) for n in (0, 10**6))
    assert a == b and len(a) == 2


def test_drop_leaks_keeps_the_rest(spark, table, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = edge_docs.unionByName(table([doc(50, ITEM)]))
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == edge_docs.count()
    assert D.drop_leaks(no_docs, bench).count() == 0
    assert D.drop_leaks(docs, bench.where("false")).count() == docs.count()


def test_plan_has_no_python(spark, table):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = D.drop_leaks(table([doc(1, ITEM)]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_that_start_sentences_are_slots(spark, table):
    item = "Tom has 12 apples. Ann has 5 apples.\nBob gives 3 apples to Tom."
    docs = table([
        doc(1, "Eve has 7 apples. Joe has 9 apples.\nMax gives 2 apples to Eve."),
        doc(2, "Eve has 7 apples. Joe has 9 apples.\nMax gives 2 apples to Joe."),     # Tom is Eve and Joe
        doc(3, "It says: \"Eve has 7 apples. (Joe) has 9 apples.\nMax gives 2 apples to Eve.\""),
        doc(4, "Once Eve has 7 apples. Joe has 9 apples.\nMax gives 2 apples to Eve."),
        doc(5, item)])
    got = leaks(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (3, 1), (4, 1), (5, 1)}
    assert all(r["n_windows"] == r["item_windows"] == 10 for r in got.values())


def test_sentence_starts_in_other_case_still_match(spark, table):
    """Reading a sentence's first word as a name loses no match of the word itself."""
    item = "Baking bread takes flour.\nBaking bread takes water."
    docs = table([doc(1, "we know that baking bread takes flour; baking bread takes water."),
                  doc(2, "The pond is blue.\nWe saw ducks and fish there.")])
    assert set(leaks(spark, docs, [(1, item)])) == {(1, 1)}


def test_placeholders_alone_are_no_evidence(spark, table):
    sums = "Compute 3 + 4 * 5 - 6 / 2"
    names = "we saw Tom, Ann, Bob, Eve, Joe, Max and"
    docs = table([
        doc(1, "Results by year: 10 11 12 13 14 15 16 17"),
        doc(2, "compute 7 + 8 * 9 - 1 / 5"),                    # the same sum of other numbers
        doc(3, "so 3 4 5 6 2 it was"),                          # the same numbers
        doc(4, "with Una, Pia, Lea, Ida, Kim, Ben, Jon, Sam or"),
        doc(5, "then we saw Una, Pia, Lea, Ida, Kim, Ben and")])
    got = leaks(spark, docs, [(1, sums), (2, names)])
    assert set(got) == {(2, 1), (3, 1), (5, 2)}
    assert got[(2, 1)]["n_windows"] == 2 and got[(5, 2)]["n_windows"] == got[(5, 2)]["item_windows"] == 5


def test_scattered_windows_do_not_add_up(spark, table):
    item = "the old grey mill stands by a slow cold river near our quiet town"
    words = item.split()
    filler = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("pa", "ko", "mi", "ru", "te"))
    scattered = f" {filler} ".join(" ".join(words[i:i + 5]) for i in range(10))
    near = " ".join(words[:7]) + " indeed so " + " ".join(words[7:])
    assert set(leaks(spark, table([doc(1, scattered), doc(2, near), doc(3, f"{filler} {item} {filler}")]), [(1, item)])) == {(2, 1), (3, 1)}


def test_placeholders_of_the_text_itself_stand_apart(spark):
    rows = [(f"a{D.NUM}b 7kg of {D.UNIT}{D.NAME} x",), ("7kg, 8 Kg and 1.5  miles",), (f"see Ann{D.START}5 or",)]
    got = [r.t for r in spark.createDataFrame(rows, "text string").select(D.template("text").alias("t")).collect()]
    assert got[0] == ["a", D.NUM, "b", D.NUM, D.UNIT, "of", D.UNIT, D.NAME, "x"]
    assert got[1] == [D.NUM, D.UNIT, D.NUM, D.NAME, "and", D.NUM, D.UNIT]


def test_each_token_of_a_window_is_hashed_once(spark):
    text = "one plain text of words that holds no slots " * 3
    rows = spark.createDataFrame([(text,)], "text string").select(
        "text", D.template("text").alias("tpl"), D.template("text").alias("named"))
    found = D.windows(rows, 5)
    words = text.split()
    assert found.count() == len(words) - 4 and found.select("window").distinct().count() == len({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(slice(tpl" not in plan

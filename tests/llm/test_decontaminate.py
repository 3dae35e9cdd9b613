"""Template matching on planted passages."""

from recoflux.llm import decontaminate as D

ITEMS = [
    (1, "Alice bought 12 apples for 3.50 dollars each and then sold 5 of them to Bob at the market before noon"),
    (2, "the train from Paris travels 120 km in 2 hours so how many km will it travel in 7 hours without a stop"),
    (3, "short item"),
    (None, "words of an item that has no id at all but leaks in a document somewhere"),
    (5, None),
    (6, ""),
]


def run(spark, docs):
    b = spark.createDataFrame([(*x, "z") for x in ITEMS], "item_id long, text string, k1 string")
    return {r.doc_id: (r.contaminated, list(r["items"])) for r in D.decontaminate(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, hash int"), b).collect()}


def test_planted_passages(spark):
    train = "So: the train from {} travels {} km in {} hours so how many km will it travel in 7 hours without a stop, they asked."
    docs = [
        (1, "before that. " + ITEMS[0][1] + " and after"),
        (2, ITEMS[0][1].replace(" ", "\n ")),
        (3, train.format("Rome", 450, "3")),  # other numbers, another name
        (4, "the train from Rome travels 100 km in 7 hours and while nothing else is the same as it was"),
        (5, "quite another text about apples and trains that leaks nothing of the items at all"),
        (6, "short item"),
        (7, "here is a short item in a longer text"),
        (8, None),
        (9, ""),
        (10, "x " + ITEMS[3][1]),
        (11, "the train from Paris travels 120 km in 2 hours " + "and other words " * 9),
    ]
    got = run(spark, docs)
    assert got[1] == got[2] == (True, [1])
    assert got[3] == (True, [2])
    assert [got[i][0] for i in (4, 5, 7, 8, 9, 11)] == [False] * 6
    assert got[6] == (True, [3]) and got[10] == (True, [])


def test_slots_must_agree(spark):
    one = "a jar holds 4 red balls and 4 blue balls so how many balls are in the 4 jars of the shelf"
    b = spark.createDataFrame([(1, one)], "item_id long, text string")
    docs = [(1, one.replace("4", "9")), (2, one.replace("4", "9", 1).replace("4", "8", 1))]
    got = {r.doc_id: r.contaminated for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == {1: True, 2: False}


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 3)
    assert run(spark, [(1, ITEMS[0][1]), (1, ITEMS[0][1])]) == {1: (True, [1])}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, ITEMS[0][1]), (1, ITEMS[0][1]), (1, ITEMS[0][1])], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r.contaminated for r in D.decontaminate(docs, b).collect()] == [True] * 3
    assert D.decontaminate(docs.limit(0), b).collect() == []
    assert not any(r.contaminated for r in D.decontaminate(docs, b.limit(0)).collect())
    assert D.drop_leaks(docs, b).collect() == [] and D.drop_leaks(docs, b.limit(0)).count() == 3


def leaked(spark, items, docs):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: list(r["items"]) for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}


def test_short_items_and_near_copies(spark):
    short, eight = "What is the capital of France?", "Which river flows through the old town hall"
    long = "a farmer keeps hens in the yard behind the barn and sells all their eggs each week"
    near = long.replace("barn", "shed")  # ten equal tokens, another one, six equal tokens
    docs = [(1, "they asked us: " + short + " and then left"), (2, "they asked What is the capital of France and then left"), (3, "we know what is the matter"), (4, "he wondered Which river flows through the old town hall today"), (5, "so " * 9 + near + " and on"), (6, "what is the capital of")]
    assert leaked(spark, [(1, short), (2, eight), (3, long)], docs) == {1: [1], 2: [1], 3: [], 4: [2], 5: [3], 6: []}


def test_items_of_numbers_and_names(spark):
    numbers = "Evaluate 12 + 7 * 45 - 33 / 8 + 91 - 4 * 27 + 60 - 15"
    names = "The president George Washington met John Adams and Thomas Jefferson near Mount Vernon"
    brief = "Evaluate 12 + 7 * 45"
    docs = [(1, "now " * 20 + numbers + " and more"), (2, "they say that " + names + " once"), (3, numbers.replace("1", "3").replace("4", "6") + " x"), (4, "please do: " + brief), (5, "please do: evaluate 13 + 8 * 46")]
    assert leaked(spark, [(1, numbers), (2, names), (3, brief)], docs) == {1: [1, 3], 2: [2], 3: [], 4: [3], 5: []}

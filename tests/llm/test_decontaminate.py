import hashlib
import random

from lorekeep.llm import decontaminate
from tests_words import tokens


def plain(text, items):
    w, hit, names = tokens(text), set(), set()
    for item, body in items:
        v = tokens(body)
        m = min(10, len(v))
        own = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in own:
                hit.update(range(i, i + m))
                names.add(item)
    named = sorted(str(x) for x in names if x is not None)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


def check(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1], items)) for r in rows), key=str)


def made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(8)
    for words in (["a", "b", "É"], [f"w{i}" for i in range(40)]):  # the first has many equal hashes in a window
        items = [(i, made(rng, words, rng.randint(10, 30))) for i in range(8)] + [(3, "w1 w1 w1"), (None, made(rng, words, 12)), (99, None), (98, " ;; ")]
        rows = [(0, None), (1, ""), (2, "..."), (3, "É"), (None, items[0][1])]
        for i in range(4, 60):
            body = [made(rng, words, rng.randint(0, 40))]
            for _ in range(rng.randint(0, 3)):
                part = (rng.choice(items)[1] or "").split()
                a = rng.randint(0, len(part))
                body += ["-- " + " ".join(part[a : a + rng.randint(8, 14)]).upper().replace("É", "é"), made(rng, words, 3)]
            rows.append((i, ", ".join(body)))
        rows += [rows[-1], (rows[-1][0], "x " + items[1][1])]
        check(spark, [(*r, "q", "q") for r in rows], items)


def test_short_items(spark):
    items = [(1, "one"), (2, "Two three"), (3, "four five six seven"), (4, "a b c d e f g h i"), (5, "a b c d e f g h i j k")]
    rows = [(1, "one one x two THREE two", "", ""), (2, "four five six", "", ""), (3, "four five six seven four five six seven", "", ""), (4, "a b c d e f g h i j", "", ""), (5, "b c d e f g h i j k l", "", "")]
    check(spark, rows, items)


def test_empty_tables(spark):
    check(spark, [(1, "a b c", "", "")], [])
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 0
